import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import hard_negatives as hn

DDL = "vec_id bigint, embedding array<float>, label int"


def plain(rows, is_anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    fit = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, v, label) in enumerate(fit):
        if not is_anchor(i):
            continue
        score = lambda w, v=v: sum(a * b for a, b in zip(v, w, strict=True))
        others = sorted((-score(w), j, other) for m, (j, w, other) in enumerate(fit) if m != n and len(w) == len(v))
        for p, j, _ in [x for x in others if x[2] == label][:positives]:
            near = [x for x in others if x[2] != label and low * -p <= 100 * -x[0] <= high * -p][:negatives]
            out += [(i, j, rank + 1, x[1], -p, -x[0]) for rank, x in enumerate(near)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("size", "spread", "block"), [(3, 0.3, hn.BLOCK), (2, 1.0, 2000), (40, 1.0, hn.BLOCK)])
def test_against_brute_force(spark, monkeypatch, size, spread, block):
    monkeypatch.setattr(hn, "BLOCK", block)
    rng = np.random.default_rng(size)
    centres = rng.standard_normal((5, size)) * 2
    rows = [(int(i), [float(np.float32(round(x, 1))) for x in centres[rng.integers(5)] + rng.standard_normal(size) * spread], int(rng.integers(4))) for i in rng.permutation(900)]
    rows += rows[:25] + [(30, None, 1), (60, [None] * size, 1), (90, [math.nan] * size, 1), (120, [math.inf] * size, 1), (150, rows[0][1], None), (None, rows[0][1], 1), (180, [1.0], 1), (210, [], 1)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], DDL + ", row string, score string").repartition(3)
    want = plain(rows, lambda i: i % 30 == 0)
    assert got(hn.mine(df, F.col("vec_id") % 30 == 0)) == want and len(want) > 300


def test_small_and_empty(spark):
    assert hn.mine(spark.createDataFrame([], DDL), F.col("vec_id") == 0).count() == 0
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.5, 0.0], 2), (3, [0.5, 0.0], 3), (4, [-1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, DDL)
    assert got(hn.mine(df, F.col("vec_id") == 0)) == [(0, 1, 1, 2, 65536, 32768), (0, 1, 2, 3, 65536, 32768)]
    assert hn.mine(df, F.col("vec_id") == 4).count() == 0  # its one positive has a negative score, whose window is empty
    assert hn.mine(df, F.lit(None).cast("boolean")).count() == 0
    assert got(hn.mine(df.withColumn("label", F.concat(F.lit("k"), "label")), F.col("vec_id") == 0)) == got(hn.mine(df, F.col("vec_id") == 0))


def test_leaves_outside_the_annulus_are_skipped():
    rng = np.random.default_rng(1)
    vectors = np.concatenate([rng.integers(-20, 20, (400, 2)) + c for c in ([0, 1000], [1000, 0], [500, 500], [-900, 0])])
    top = float((vectors.astype(float) ** 2).sum(axis=1).max())
    tree = hn.Tree.unpack(hn.Tree.build(vectors, np.arange(1600), np.arange(1600), np.zeros(1600, np.int64), top).pack())
    low, high = tree.leaves(hn.augmented(tree.vectors, top), np.array([[1000.0, 0.0, 0.0]]))
    edges = hn.Tree.edges(1600, tree.depth)
    away = np.sqrt(((hn.augmented(tree.vectors, top) - np.array([1000.0, 0, 0])) ** 2).sum(axis=1))
    for leaf in range(len(edges) - 1):
        part = away[edges[leaf] : edges[leaf + 1]]
        assert low[0, leaf] - 1e-6 <= part.min() and part.max() <= high[0, leaf] + 1e-6
    scores = []
    search = hn.Search(np.array([[1000, 0]]), np.array([-5]), np.array([0]), np.array([[450_000]]), np.array([[600_000]]), 10, True)
    plain_score = search._score
    search._score = lambda tree, mine, begin, end, *rest: (scores.append(end - begin), plain_score(tree, mine, begin, end, *rest))
    search.visit(tree)
    want = sorted((-s, i) for i, s in enumerate((vectors @ [1000, 0]).tolist()) if 450_000 <= s <= 600_000)[:10]
    assert list(zip(-search.best[0, 0], search.who[0, 0], strict=True)) == want
    assert sum(int(n.sum()) for n in scores) < 900
