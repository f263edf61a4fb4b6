"""Flat token files against plain reading."""

import random

import numpy as np
import pytest

from flowlens.llm import token_counts as t

SF = "/root/testdata/sf0.001"


def plain(tokens, end_id):
    """(start, n_tokens, ended) of each document of one file."""
    out, start = [], 0
    for i, x in enumerate(tokens):
        if x == end_id:
            out.append((start, i - start, True))
            start = i + 1
    return out + ([(start, len(tokens) - start, False)] if start < len(tokens) else [])


@pytest.mark.parametrize("block,chunk,dtype", [(1, 1, "<u2"), (4, 2, "<u4"), (7, 3, "<u2"), (1 << 20, 1024, "<i4")])
def test_scan_stitches_blocks(spark, tmp_path, block, chunk, dtype):
    rng = random.Random(block)
    cases = [[], [9], [9, 9, 9], [1, 2, 3], [1, 9, 2], [1, 9], [1] * 40 + [9] + [2] * 30, [rng.choice([1, 2, 3, 4, 9]) for _ in range(90)]]
    for i, tokens in enumerate(cases):
        (tmp_path / f"{i}.bin").write_bytes(np.array(tokens, dtype).tobytes() + b"\x09" * (i % 2))  # a byte that is no whole id
    got = {}
    for r in t.count_tokens(spark, str(tmp_path), 9, dtype, block, chunk).collect():
        got.setdefault(int(r.path.rsplit("/")[-1].split(".")[0]), []).append((r.ordinal, r.start, r.n_tokens, r.ended))
    for i, tokens in enumerate(cases):
        assert sorted(got.get(i, [])) == [(k, *x) for k, x in enumerate(plain(tokens, 9))], i


@pytest.mark.parametrize("roll", [64, 1 << 28])
def test_documents(spark, roll):
    pytest.importorskip("public_tokenizers")
    encoding = t.load(t.default_vocabulary())
    docs = [(i, "word <|endoftext|> é\n" * (i % 5)) for i in range(40)] + [(1, "again"), (1, "again"), (None, "no id"), (77, None), (78, "x" * 50000)]
    df = spark.createDataFrame([(*d, "n", 1) for d in docs], "doc_id bigint, text string, name string, id int").repartition(3)
    got = t.token_counts(df, roll=roll).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(encoding.encode_ordinary(x or ""))) for i, x in docs)
    assert t.token_counts(df.limit(0)).count() == 0


def test_query(spark):
    pytest.importorskip("public_tokenizers")
    from flowlens.llm import queries

    encoding = t.load(t.default_vocabulary())
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r.n_tokens for r in queries.QUERIES["op2_token_counts"](spark, SF).collect()}
    assert got == {d.doc_id: len(encoding.encode_ordinary(d.text or "")) for d in docs}


def test_long_white_space_is_one_piece():
    encoding = t.load(t.default_vocabulary())
    for n in (9_999, 10_000, 30_001):
        for text in (" " * n, "a" + " " * n, "a" + " " * n + "b c", "\n" * n + "b", "x" + " \n" * (n // 2) + "9", " " * n + "é" + "\t" * n):
            assert t.encode_whole(encoding, text) == encoding.encode_ordinary(text), (n, text[:3])
    long = "word" + " " * 1_500_000 + "word"
    assert encoding.decode(t.encode_whole(encoding, long)) == long


def test_ids_that_do_not_fit_are_refused():
    encoding = t.load(t.default_vocabulary())
    t.check_ids(encoding, t.END_ID, t.DTYPE)
    with pytest.raises(ValueError, match="is a token"):
        t.check_ids(encoding, 5, t.DTYPE)
    with pytest.raises(ValueError, match="do not fit"):
        t.check_ids(encoding, t.END_ID, "u1")
