import random

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from tests_llm_brute import kept, repeats as plain

from flowlens.llm import blobs, repeats, substring_dedup, suffix_dedup, textbytes as tb
from flowlens.llm.repeats import Spec


def make_docs(seed, n=60):
    rng = random.Random(seed)
    vocab = [w for w in "a bb ccc dd é eau über the of and to  x".split(" ")]
    phrase = [" ".join(rng.choice(vocab) for _ in range(60)) for _ in range(3)]
    docs = []
    for i in range(n):
        words = [rng.choice(vocab) + rng.choice(["", "1", "z"]) for _ in range(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 3)):
            words.insert(rng.randrange(0, len(words) + 1), rng.choice(phrase))
        docs.append((i * 3, rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    docs += [(1000, docs[5][1]), (1001, docs[5][1]), (1002, None), (1003, ""), (1004, "x " * 300), (1005, "ab" * 400), (None, docs[6][1]), (-7, docs[7][1])]
    return docs


@pytest.mark.parametrize("hot", [256, 1])
@pytest.mark.parametrize("words", [True, False])
def test_against_plain(spark, words, hot):
    docs = make_docs(3)
    df = spark.createDataFrame([(*d, 1, "c") for d in docs], "doc_id bigint, text string, target int, blob string").repartition(5)
    run = substring_dedup.remove_repeated_words if words else suffix_dedup.remove_repeated_bytes
    got = {r.doc_id: r for r in run(df, hot=hot).collect()}
    window = 20 if words else 100
    want = plain(docs, window, words)
    assert len(got) == len(want)
    for key, (units, gone) in want.items():
        r = got[key]
        assert (r.dedup_n_units, r.dedup_n_removed) == (len(units), sum(gone)), key
        assert (r.dedup_kept if words else bytes(r.dedup_kept)) == kept(units, gone, words), key
        spans = [i for s in r.dedup_removed for i in range(s.start, s.end)]
        assert spans == [i for i, g in enumerate(gone) if g]
        assert all(a.end < b.start for a, b in zip(r.dedup_removed, r.dedup_removed[1:], strict=False))
        assert r.blob == "c" and r.target == 1


def test_repeated_rows_and_empty(spark):
    text = " ".join(f"w{i % 37}" for i in range(90))
    df = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id bigint, text string").repartition(3)
    rows = substring_dedup.remove_repeated_words(df).collect()
    alone = plain([(1, text)], 20, True)[1][1]
    assert sorted(r.dedup_n_removed for r in rows if r.text == text and r.doc_id == 1) == [sum(alone)] * 2
    assert [r.dedup_n_removed for r in rows if r.doc_id == 2] == [90]
    for run in (substring_dedup.remove_repeated_words, suffix_dedup.remove_repeated_bytes):
        assert run(df.limit(0)).count() == 0


@pytest.mark.parametrize("need", [2, 7, 40, 10**6])
def test_suffix_order(need):
    rng = np.random.default_rng(need)
    for n in [*range(1, 12), 200, 301, 502]:
        s = rng.integers(1, 4, n)
        if n > 100:
            s[50:90] = s[0:40]
        rank = suffix_dedup.suffix_order(s, need)
        assert sorted(rank) == list(range(n))
        order = np.argsort(rank)
        cut = [tuple(s[i : i + need]) for i in order]
        assert cut == sorted(cut)


def test_fm_index_counts():
    rng = np.random.default_rng(1)
    s = np.concatenate([rng.integers(1, 5, 300), [0]])
    index = substring_dedup.FMIndex(s, 5, 20)
    text = s.tolist()
    ends = np.arange(25, 290)
    length, _ = substring_dedup.matching_statistics(index, s, ends, 20)
    for e, got in zip(ends, length, strict=True):
        want = 0
        for m in range(1, 21):
            pattern = text[e - m + 1 : e + 1]
            if sum(text[i : i + m] == pattern for i in range(len(text) - m + 1)) < 2:
                break
            want = m
        assert got == want


def test_spec_reach():
    assert Spec("byte", 100, 32, 5).reach == 69


def run_here(docs, spec, index, render):
    """The steps of remove_repeats in this process, as Spark deals them: [(id, gone)]."""

    def grouped(batches):
        table = pa.concat_tables([b if isinstance(b, pa.Table) else pa.Table.from_batches([b]) for b in batches])
        return {t: table.filter(pa.compute.equal(table["target"], t)) for t in set(table["target"].to_pylist())}

    ids = pa.array([i for i, _ in docs], pa.int64())
    texts = pa.array([t for _, t in docs], pa.string())
    cut = [b for i in range(0, len(docs), 7) for b in repeats._segments(spec)(iter([pa.RecordBatch.from_arrays([ids[i : i + 7], texts[i : i + 7]], names=["id", "text"])]))]
    found = [repeats._copies(spec)(g) for g in grouped(cut).values()]
    blocks = repeats.block_of(np.asarray(ids), spec.parts)
    none = blobs.table(["target", "blob"], [pa.int32(), pa.binary()], [])
    by_block = {b: pa.table({"id": ids.filter(pa.array(blocks == b)), "text": texts.filter(pa.array(blocks == b))}) for b in range(spec.parts)}
    of = grouped(found)
    contents = [repeats._contents(spec)(by_block[b], of.get(b, none)) for b in range(spec.parts)]
    again = [repeats._shard(spec, index)(g) for g in grouped(contents).values()]
    of = grouped(found + again)
    out = {}
    for b in range(spec.parts):
        rows = repeats._finish(spec, ["id"], render)(by_block[b], of.get(b, none)).to_pylist()
        out |= {r["id"]: (r["n_units"], [i for s in r["removed"] for i in range(s["start"], s["end"])]) for r in rows}
    return out


@pytest.mark.parametrize("hot", [256, 1])
@pytest.mark.parametrize("forged", ["none", "spans", "units"])
@pytest.mark.parametrize("words", [True, False])
def test_hashes_that_collide_remove_nothing(monkeypatch, words, hot, forged):
    """Equal hashes of different spans, or of different words, are what a forger can make: results stay those of the texts."""
    docs = [d for d in make_docs(5, 25) if d[0] is not None]
    if forged == "spans":
        monkeypatch.setattr(tb, "span_hash", lambda prefix, starts, ends: np.zeros(len(starts), dtype=np.uint64))
    if forged == "units":
        true = tb.word_hashes
        monkeypatch.setattr(tb, "word_hashes", lambda *a: true(*a) % np.uint64(3))
    spec = Spec("word" if words else "byte", 20 if words else 100, 6 if words else 32, 3, hot)
    module = substring_dedup if words else suffix_dedup
    got = run_here(docs, spec, module.shard_repeats, module._render)
    want = plain(docs, spec.window, words)
    assert got == {i: (len(units), [k for k, g in enumerate(gone) if g]) for i, (units, gone) in want.items()}


def test_equal_hashes_in_one_block_of_two_texts():
    """Two texts that share a gram but no window, as segments of one anchor."""
    rng = np.random.default_rng(2)
    gram = rng.integers(97, 123, 32, dtype=np.uint8).tobytes()
    docs = [(i, (rng.integers(97, 123, 60, dtype=np.uint8).tobytes() + gram + rng.integers(97, 123, 60, dtype=np.uint8).tobytes()).decode()) for i in (1, 2)]
    got = run_here(docs, Spec("byte", 100, 32, 1), suffix_dedup.shard_repeats, suffix_dedup._render)
    assert got == {1: (152, []), 2: (152, [])}
