import random
from collections import Counter

import duckdb
import pytest
from tests_llm_brute import WORD

from flowlens.llm import quality


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if seen[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def make_docs():
    rng = random.Random(9)
    vocab = ["a", "Bb", "ccc", "é🙂", "#1", "x|y", "\x85z", "\xa0"]
    texts = ["".join(rng.choice(vocab) + rng.choice([" ", "\n", "\t", "\r\n", "\x0b", "  "]) for _ in range(rng.randrange(0, 150))) for _ in range(120)]
    texts += ["", None, " \n ", "a b", "a a a a", "a b c a b c", "line\nline\nline\n\n\n x", "WORD " * 80, "w" * 3000, " ".join(f"w{i}" for i in range(30000)), "a b " * 8000]
    return list(enumerate(texts)) + [(3, texts[3])]


def test_features_and_verdict(spark):
    docs = make_docs()
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id bigint, text string, n_words int").repartition(3)
    rows = quality.apply_rules(df, sample_rows=50).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        got = (r.quality_n_words, r.quality_word_chars, r.quality_n_symbols, r.quality_n_dup_lines, r.quality_n_repeat_words)
        assert got == plain(texts[r.doc_id]), texts[r.doc_id]
        assert r.quality_base_failed == (got[0] < 50 or 100 * got[4] > 50 * got[0])
        assert r.n_words == 5
        assert r.quality_kept == (r.quality_failed is None)
    assert quality.apply_rules(df.limit(0)).count() == 0


def test_sql_agrees(spark, tmp_path):
    df = spark.createDataFrame(make_docs(), "doc_id bigint, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.sql(quality.ORACLE_SQL).fetchall())
    p = "quality_"
    names = ["doc_id", f"{p}n_words", f"{p}word_chars", f"{p}n_symbols", f"{p}n_dup_lines", f"{p}n_repeat_words", f"{p}base_failed", f"{p}kept"]
    assert sorted(map(tuple, quality.apply_rules(df).select(names).collect())) == want


@pytest.mark.parametrize("order", [1, -1])
def test_verdict_does_not_depend_on_order(spark, order):
    df = quality.with_features(spark.createDataFrame(make_docs(), "doc_id bigint, text string"))
    first = {r[0]: r[1] is None for r in df.select("doc_id", quality.cascade(quality.RULES[::order])).collect()}
    assert first == {r[0]: r[1] is None for r in df.select("doc_id", quality.cascade(quality.RULES)).collect()}


def test_given_columns_named_like_results(spark):
    docs = make_docs()
    plain = spark.createDataFrame(docs, "doc_id bigint, text string")
    clash = spark.createDataFrame([(*d, 7, "x", "y") for d in docs], "doc_id bigint, text string, quality_n_words int, quality_box string, w string")
    want = {r.doc_id: r.quality_kept for r in quality.apply_rules(plain).collect()}
    out = quality.apply_rules(clash)
    assert {r.doc_id: r.quality_kept for r in out.collect()} == want and out.columns.count("quality_n_words") == 1 and "quality_box" not in out.columns
