import random
import zlib

import pytest

from flowlens.llm import bpe, packing


@pytest.mark.parametrize("histogram", [{}, {5: 3}, {16: 2, 1: 40}, {3: 1000}, {7: 11, 9: 11, 2: 5, 1: 1}, {i: 17 - i for i in range(1, 17)}])
def test_plan_places_everything_once(histogram):
    patterns = packing.plan(histogram, 16)
    placed = {}
    for pattern, count in patterns:
        assert sum(pattern) <= 16 and count > 0
        for length in pattern:
            placed[length] = placed.get(length, 0) + count
    assert placed == histogram
    if histogram:  # longest first into the roomiest pack leaves at most one pack under half full
        assert sum(count for pattern, count in patterns if sum(pattern) * 2 < 16) <= 1


def test_pieces(spark):
    pytest.importorskip("public_tokenizers")
    tokens, rng = bpe.load(bpe.default_vocabulary()), random.Random(2)
    texts = [" ".join(rng.choice(["the", "Of", "xyzzy", "é"]) for _ in range(rng.choice([0, 1, 5, 40, 63, 64, 200]))) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (5000, None), (5000, None), (None, "a")], "doc_id bigint, text string").repartition(5)
    rows = packing.pack(df, size=64).collect()
    ids = {i: tokens.encode(t) + b"\2\0\0\0" for i, t in [*enumerate(texts), (None, "a")]}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.doc_id != 5000:
            by_doc.setdefault(r.doc_id, []).append(r)
    assert sum(r.doc_id == 5000 for r in rows) == 2
    for doc, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids[doc]) // 4)
            assert r.ids_crc32 == zlib.crc32(ids[doc][4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids[doc]) // 4
    assert set(by_doc) == set(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r.length for r in rows)
    assert 64 * len(by_sequence) < 1.05 * total + 64
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert packing.pack(df.limit(0)).count() == 0
