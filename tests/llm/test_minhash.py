import random

import numpy as np
import pyarrow as pa
import pytest
from tests_llm_brute import WORD

from flowlens.llm import minhash_dedup as m
from flowlens.llm.components import components, contracted
from flowlens.llm.lineage import Tables


def shingles(text, k):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def plain(docs, k):
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def make_docs(seed):
    rng = random.Random(seed)
    vocab = [f"W{i}" for i in range(300)] + ["É", "straße"]
    docs, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 30, 200]))]
        for _ in range(rng.choice([1, 2, 25])):
            words = list(base)
            for _ in range(rng.randrange(0, max(1, len(words) // 40) + 1)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            text = rng.choice([" ", "\n", "  "]).join(words)
            docs.append((n * 7 % 1009, text if rng.random() < 0.7 else text.lower()))
            n += 1
    return docs + [(2000, None), (2001, ""), (2002, " \n"), (2003, docs[0][1]), (2004, docs[0][1])]


@pytest.mark.parametrize("rounds", [2, 1, 0])
def test_against_plain(spark, rounds):
    docs = make_docs(5)
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id bigint, text string, id int, rep string").repartition(4)
    rows = m.near_duplicates(df, shingle=4, rounds=rounds).collect()
    want = plain(docs, 4)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_shingles, r.component_id) == want[r.doc_id], r
        assert r.kept == (r.doc_id == r.component_id)


def test_repeated_null_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, "x y")], "doc_id bigint, text string")
    rows = sorted((r.doc_id or -1, r.component_id) for r in m.near_duplicates(df, shingle=4).collect())
    assert rows == [(-1, 1), (1, 1), (1, 1), (3, 3)]
    assert m.near_duplicates(df.limit(0)).count() == 0


def test_texts_under_one_id_are_documents(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    near = b + " more"
    rows = [(1, a), (1, b), (1, b), (2, near), (None, c), (None, c + " more"), (None, d), (None, a), (None, None), (9, d)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = m.near_duplicates(df, hash_col="tag")
    texts = {r.tag: r.text for r in df.selectExpr("xxhash64(text) tag", "text").distinct().collect()}
    seen = sorted((r.doc_id or 99, texts[r.tag] or "", r.n_shingles, r.component_id) for r in got.collect())
    want = [(1, a, 56, 1), (1, b, 56, 1), (1, b, 56, 1), (2, near, 57, 1), (9, d, 56, 9), (99, "", 0, None), (99, a, 56, 1), (99, c, 56, None), (99, c + " more", 57, None), (99, d, 56, 9)]
    assert seen == want
    kept = [(r.doc_id, texts[r.tag]) for r in got.where("kept").collect()]
    assert [x for x in kept if x[0]] == [x for x in kept if x in [(1, a), (1, b), (9, d)]] and len(kept) == 6
    assert sum(x in kept for x in [(None, c), (None, c + " more")]) == 1 and (None, None) in kept


def test_signature_is_circulant():
    table = m.shifted_permutation()
    assert sorted(table[:, 0][: m.PLACES].tolist()) == list(range(m.PLACES))
    assert np.array_equal(table[5, 3:10], table[8, :7])


def test_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (102, 100)] + [(200 + i, 200) for i in range(1, 30)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 103)} | {i: 200 for i in range(200, 230)}


@pytest.mark.parametrize("percent", [7, 30, 50, 60, 70, 80, 90, 100])
def test_plan_follows_the_similarity(percent):
    bands, rows = m.plan(percent)
    assert bands * rows <= m.COORDINATES and (1 - (percent / 100) ** rows) ** bands <= 5e-8


def test_bitmaps_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 100, 3000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3).astype(np.uint64)])
        apart = sum(int(x).bit_count() for x in (m.parities(a) ^ m.parities(b)).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b))


def test_words_that_follow_a_rule_have_hashes_of_their_own():
    words = ["A"]
    while len(words[-1]) < 4096:  # each the last one and its complement
        words.append(words[-1] + words[-1].translate(str.maketrans("AB", "BA")))
    words += [w.translate(str.maketrans("AB", "BA")) for w in words]
    part = next(m.tb.text_slices(pa.array(words)))
    assert len(set(m.tb.word_hashes(part, m.tb.words(part)).tolist())) == len(words)
    assert len(set(m.tb.text_hashes(part).tolist())) == len(words)


def test_crowd_of_copies_too_far_apart_and_exact_similarity(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(150):  # most of these are linked with none, some with a few
        words = list(base)
        for at in rng.sample(range(300), rng.randrange(4, 16)):
            words[at] = f"x{i}y{at}"
        rows.append((i, " ".join(words)))
    # 100 shared of 125 shingles: 0.8 exactly; 99 of 124 is below it
    rows += [(1000 + j, " ".join([*(f"s{k}" for k in range(103)), *(f"{j}t{k}" for k in range(extra))])) for j, extra in ((0, 0), (1, 25))]
    rows += [(2000 + j, " ".join([*(f"u{k}" for k in range(102)), *(f"{j}v{k}" for k in range(extra))])) for j, extra in ((0, 0), (1, 25))]
    want = plain(rows, 4)
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=4, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert want[1001][1] == 1000 and want[2001][1] == 2001


def test_lower_similarity_finds_all_pairs(spark):
    # of two texts of 200 words, 153 windows of 1 word are shared: 153 / 247 = 0.62
    rows = [(2 * i + side, " ".join(f"{i}w{k}" if k < 153 else f"{i}s{side}w{k}" for k in range(200))) for i in range(60) for side in (0, 1)]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=1, percent=60).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got) and len(got) == 120


def test_edited_copies_meet_their_original_before_the_prefix_filter(spark, monkeypatch):
    base = [f"b{i}" for i in range(150)]
    text = lambda edits, *more: " ".join([f"x{w}" if i in edits else w for i, w in enumerate(base)] + list(more))
    closest = [text((), f"y{i}") for i in range(40)]
    marks = [m.signature(own, 128) for own in m.shingle_sets(next(m.tb.text_slices(pa.array([text(()), *closest]))), 4)]
    same = [c for c, mark in zip(closest, marks[1:], strict=True) if (mark == marks[0]).all()]  # in all buckets of the original
    assert len(same) >= 5
    rng = random.Random(2)
    # four edits: 131 of 163 shingles are shared with the original, 131 of 164 with those closest to it
    far = [rng.sample(range(4 + 36 * k, 38 + 36 * k), 1)[0] for _ in range(60) for k in range(4)]
    rows = [(1000, text(())), *enumerate(same), *((100 + i, text(far[4 * i : 4 * i + 4])) for i in range(60))]
    still = []
    monkeypatch.setattr(m._Open, "meet_by_prefix", lambda self, f=m._Open.meet_by_prefix: still.append(self.open_buckets().select("label").distinct().count()) or f(self))
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), shingle=4, percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain(rows, 4) and len({r.component_id for r in got}) == 1
    assert still == [0]  # nothing is left for pairs that grow with the square of the copies


def test_settled_links_are_not_contracted_again(spark, monkeypatch):
    written = []
    monkeypatch.setattr(Tables, "write", lambda self, df, f=Tables.write: written.append(1) or f(self, df))
    stars = spark.createDataFrame([(i, i % 3) for i in range(3, 40)] + [(2, 30)], "a bigint, b bigint")
    assert len(contracted(stars.where("a <> 2"), Tables(spark)).collect()) == 37 and len(written) == 1
    assert {tuple(r) for r in contracted(stars, Tables(spark)).collect()} == {(i, 0 if i % 3 != 1 else 1) for i in range(2, 40)}
    assert contracted(stars.where("a < 0"), Tables(spark)).count() == 0


def test_later_rounds_read_only_texts_of_open_buckets_and_signatures_go(spark, monkeypatch):
    rng, sizes, written = random.Random(3), [], []
    monkeypatch.setattr(Tables, "write", lambda self, df, f=Tables.write: written.append(df.columns) or f(self, df))
    alone = [[rng.randrange(10**6) for _ in range(60)] for _ in range(30)]
    docs = [(2 * i + c, " ".join(map(str, base + [c]))) for i, base in enumerate(alone) for c in (0, 1)]  # linked in the first round
    monkeypatch.setattr(m._Open, "absorb", lambda self, pairs, text, f=m._Open.absorb: sizes.append(text.count()) or f(self, pairs, text))
    out = m.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.doc_id: r.component_id for r in out.collect()} == {d: d - d % 2 for d, _ in docs}
    assert sizes[0] == 60 and sizes[1:] == [0, 0, 0]
    assert [c for c in written if "text" in c] == [["rep", "label", "text"]] * 2  # of open buckets only
    kept = {f.rpartition("/")[0] for f in out.inputFiles()}
    assert len(kept) == 1 and spark.read.parquet(*kept).columns == ["id", "tag", "n_shingles", "low", "kept"]


def test_texts_that_no_join_asks_for_are_not_dealt(spark):
    """One pair of near copies among long texts: with no small side to broadcast, the others stay where they are read."""
    rng, written = random.Random(3), lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    docs = [(i, " ".join(f"{rng.getrandbits(64):x}" for _ in range(1000))) for i in range(300)]
    docs.append((300, docs[7][1] + " end"))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4).localCheckpoint()
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        rows = m.near_duplicates(df).where("NOT kept").collect()
        dealt = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert [(r.doc_id, r.component_id) for r in rows] == [(300, 7)]
    assert dealt < sum(len(t) for _, t in docs) / 5
