import math

import numpy as np
import pytest

from flowlens.llm import embedding_dedup as e


def plain(rows, threshold=0.93):
    fit = [(i, v, label) for i, v, label in rows if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    root, count = {}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for k, (i, v, label) in enumerate(fit):
        for j, w, other in fit[k + 1 :]:
            if label == other and len(v) == len(w):
                a, b = np.array(v, dtype=float), np.array(w, dtype=float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                    count[i], count[j] = count.get(i, 0) + 1, count.get(j, 0) + 1
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: (count.get(i, 0), find(i)) for i, _, _ in rows}


def make_rows(seed=1, size=16):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for group in range(14):
        centre = rng.standard_normal(size)
        for _ in range(int(rng.choice([1, 2, 60]))):
            v = centre + rng.standard_normal(size) * rng.choice([0, 0.05, 0.22])
            rows.append((n * 5 % 2003, [float(np.float32(x)) for x in v * rng.choice([1, 1, 3])], group % 3 if rng.random() < 0.95 else None))
            n += 1
    return rows + [(3001, None, 1), (3002, [0.0] * size, 1), (3003, [float("nan")] * size, 1), (3004, [None] * size, 1), (3005, [1.0, 2.0], 1), (3006, [2.0, 4.0], 1), (3007, [], 1), (3008, [float("inf")] * size, 1)]


@pytest.mark.parametrize("crowd", [1024, 7])
def test_against_plain(spark, crowd):
    rows = make_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id bigint, embedding array<float>, label int, rep string").repartition(4)
    got = e.near_duplicate_vectors(df, crowd=crowd).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id) == want[r.vec_id], r
        assert r.kept == (r.vec_id == r.component_id)
    assert e.near_duplicate_vectors(df.limit(0)).count() == 0


def pairs_at(size, cosine, n=1500, seed=5):
    rng = np.random.default_rng(seed)
    a, side = rng.standard_normal((2, n, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return a, cosine * a + math.sqrt(1 - cosine**2) * side


@pytest.mark.parametrize(("size", "directions"), [(2, 1000), (3, 1000), (4, 4000), (8, 10**6), (16, 10**6), (16, 4096**2), (32, 4096**2), (64, 1000), (64, 51_000), (128, 4096**2), (64, 10**8), (768, 10**6)])
def test_recall_at_the_threshold(size, directions):
    a, b = pairs_at(size, 0.93, 600 if directions > 10**6 else 1500)
    code = e.product_code(size, directions, e.THRESHOLD, e.PER_VECTOR)
    met = [len(np.intersect1d(x, y)) > 0 for x, y in zip(code.decode(a), code.decode(b), strict=True)]
    assert np.mean(met) > 0.985
    assert len(code.codes) == (1 if size < 24 else 2 if directions <= 4096**2 else 3)


@pytest.mark.parametrize(("size", "directions", "blocks"), [(10, 40, 1), (24, 1600, 2), (30, 4096**2 + 1, 3)])
def test_list_decoding_finds_all_filters(size, directions, blocks):
    rng = np.random.default_rng(6)
    code = e.ProductCode(size, directions, 30)
    if blocks == 3:
        code.words, code.codes = 12, [c[:12] for c in code.codes]
        code.threshold = e.cap_height(size, 30 / 12**3)
    unit = rng.standard_normal((50, size))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    turned = unit @ code.rotation
    assert len(code.codes) == blocks
    for i, found in enumerate(code.decode(unit)):
        scores = np.zeros(1)
        for first, last, words in zip(code.edges[:-1], code.edges[1:], code.codes, strict=True):
            scores = (scores[:, None] + (turned[i, first:last] @ words.T)[None, :]).ravel()
        every = np.flatnonzero(scores >= code.threshold)
        assert np.array_equal(found, every) if len(every) * 2 >= 30 else len(found) == 30


@pytest.mark.parametrize(("size", "n"), [(2, 400), (4, 3000), (8, 4000)])
def test_dense_links_of_few_components(spark, size, n):
    vectors = np.random.default_rng(size).standard_normal((n, size)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in e.near_duplicate_vectors(df).collect()}
    wide = vectors.astype(float)
    close = wide @ wide.T / np.outer(np.linalg.norm(wide, axis=1), np.linalg.norm(wide, axis=1)) >= e.THRESHOLD
    want = close.sum(axis=1) - 1
    assert sum(got.values()) >= 0.995 * want.sum() and all(got[i] <= w for i, w in enumerate(want.tolist()))


def test_repeated_and_null_ids_are_vectors_of_their_own(spark):
    rows = [(None, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.1, 0.0], 1), (None, [0.0, 0.0, 1.0], 1), (9, [1.0, 0.05, 0.0], 1), (5, [0.0, 1.0, 0.0], 2), (5, [0.0, 1.0, 0.1], 2), (5, [1.0, 0.0, 0.0], 2), (6, [0.0, 1.0, 0.05], 2)]
    got = e.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"))
    found = sorted((r.vec_id or -1, r.n_links, r.component_id or -1) for r in got.collect())
    assert found == [(-1, 0, -1), (-1, 2, 9), (-1, 2, 9), (5, 0, 5), (5, 2, 5), (5, 2, 5), (6, 2, 5), (9, 2, 9)]
