"""The registered queries over whole tables: against their SQL, or against plain versions of their contracts."""

import hashlib
import zlib

import pytest
from oracle import connect, rows_of_duckdb, rows_of_spark

from flowlens.llm import bpe, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    names, rows = rows_of_spark(queries.QUERIES[name](spark, SF))
    want_names, want, _ = rows_of_duckdb(con, queries.ORACLE_SQL[name])
    assert names == want_names and rows == want and rows


def test_bytes_against_a_plain_scan(spark, con):
    docs = con.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    seen, want = set(), {}
    for doc, text in docs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            window = hash(raw[i : i + 100]), raw[i : i + 8]
            if window in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(window)
        spans = sum(g and not before for g, before in zip(gone, b"\0" + gone, strict=False))
        want[doc] = len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op9_suffix_dedup(spark, SF).collect()}
    assert got == want


def test_tokens_and_packing_against_the_library(spark, con):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(bpe.default_vocabulary())
    theirs.no_truncation()
    theirs.no_padding()
    ids = {doc: theirs.encode(text or "", add_special_tokens=False).ids for doc, text in con.sql("SELECT doc_id, text FROM documents").fetchall()}
    packed = lambda x: b"".join(i.to_bytes(4, "little") for i in x)
    want = {d: (len(x), hashlib.sha256(packed(x)).hexdigest(), hashlib.sha256(theirs.decode(x, skip_special_tokens=False).encode()).hexdigest()) for d, x in ids.items()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op7_bpe(spark, SF).collect()} == want
    pieces, sequences = {}, {}
    for r in queries.op10_packing(spark, SF).collect():
        whole = [*ids[r.doc_id], 2]
        assert r.doc_tokens == len(whole) and r.ids_crc32 == zlib.crc32(packed(whole[r.start : r.start + r.length]))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, parts in pieces.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[doc]) + 1
    assert pieces.keys() == ids.keys()
    used = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        used += at
    assert len(sequences) <= -(-used // 4096) * 1.02 + 1  # little padding


def test_language_held_out_accuracy(spark, con):
    lang = dict(con.sql("SELECT doc_id, lang FROM documents WHERE lang IS NOT NULL").fetchall())
    rows = queries.op6_language_id(spark, SF).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.doc_id in lang and r.lang_pred != "und"]
    assert held and sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.9 * len(held)


def test_pages_have_their_text(spark, con):
    rows = queries.op3_html_extract(spark, SF).collect()
    assert len(rows) == con.sql("SELECT count(*) FROM pages").fetchall()[0][0]
    assert all(r.n_chars == len(r.text) and "<" not in r.text[:1] for r in rows)
