"""Each stage of the pipeline against a plain version over its own input, and the run as a whole."""

import duckdb
import pytest
from test_minhash import plain as plain_duplicates
from tests_llm_brute import kept, repeats

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from flowlens.llm import bpe, quality  # noqa: E402
from flowlens.llm.lineage import written  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows(df):
    return {r.doc_id: r.asDict() for r in df.collect()}


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, at, seen = docs.columns, docs, []
    for name, stage in corpus_pipeline.STAGES:
        before, out = rows(at), stage(spark, at, SF)
        if name != "packing":
            assert out.columns == columns
            out = written(out)
        after = out.collect() if name == "packing" else rows(out)
        seen.append(name)
        if name == "quality_rules":
            con = duckdb.connect()
            con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
            names = [d[0] for d in con.sql(quality.ORACLE_SQL).description]
            want = {r[0] for r in con.sql(quality.ORACLE_SQL).fetchall() if r[names.index("kept")]}
            assert set(after) == want and all(after[k] == before[k] for k in after)
        elif name == "language_id":
            assert len(after) > 0.99 * len(before)
            assert sum(after[k]["lang"] == before[k]["lang"] for k in after) > 0.99 * len(after)
        elif name == "minhash_dedup":
            want = plain_duplicates([(k, r["text"]) for k, r in before.items()], 5)
            assert set(after) == {k for k, (_, component) in want.items() if k == component}
        elif name == "substring_dedup":
            want = repeats([(k, r["text"]) for k, r in before.items()], 20, True)
            assert set(after) == {k for k, (units, gone) in want.items() if not all(gone)}
            for k, r in after.items():
                units, gone = want[k]
                assert r["text"] == (kept(units, gone, True) if any(gone) else before[k]["text"]) and r["n_chars"] == len(r["text"])
        else:
            tokens = bpe.load(bpe.default_vocabulary())
            assert sum(r.length for r in after) == sum(len(tokens.encode(r["text"])) // 4 + 1 for r in before.values())
        at = out
    assert seen == ["quality_rules", "language_id", "minhash_dedup", "substring_dedup", "packing"]


def test_run_and_hostile_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "x", 0), (9002, None, None, None, None), (None, "word " * 60, "en", None, 3), (7, "again " * 3, "fr", "x", 1)], docs.schema)
    docs.limit(60).unionByName(odd).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert out.count() > 0
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_minhash_stage_keeps_one_of_each_group(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(1, a), (1, b), (2, b + " more"), (None, c), (None, c), (None, c + " more"), (None, a), (None, d), (5, d), (5, d)]
    df = spark.createDataFrame([(i, t, "en", f"s{n}", 1) for n, (i, t) in enumerate(rows)], docs.schema)
    got = sorted((r.doc_id or 99, r.text.split(" more")[0]) for r in corpus_pipeline.minhash_dedup(spark, df, SF).collect())
    assert got == [(1, a), (1, b), (5, d), (99, c)]
