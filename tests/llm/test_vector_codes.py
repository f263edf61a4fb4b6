import math

import numpy as np
import pytest

from flowlens.llm import vector_codes as vc


def nearest(book, v):
    return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), e) for e, c in enumerate(book))


def plain(rows, parts, entries, rounds, scale):
    """{row: (code, error)} of [(id, vector)], one length."""
    fit = [(i, k, [math.floor(scale * x) for x in v]) for k, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not fit:
        return {}
    size = len(fit[0][2])
    cut = lambda v: [v[size * p // parts : size * (p + 1) // parts] for p in range(parts)]
    first = sorted(fit, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[cut(v)[p] for _, _, v in first] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            near = {}
            for _, _, v in fit:
                near.setdefault(nearest(books[p], cut(v)[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(near[e]) for c in zip(*near[e], strict=True)] if e in near else old for e, old in enumerate(books[p])]
    out = {}
    for _, k, v in fit:
        best = [nearest(books[p], cut(v)[p]) for p in range(parts)]
        out[k] = bytes(e for _, e in best), sum(d for d, _ in best)
    return out, books


@pytest.mark.parametrize(("n", "size", "parts", "entries"), [(700, 8, 4, 8), (90, 7, 3, 200), (40, 2, 4, 5)])
def test_against_plain(spark, n, size, parts, entries):
    rng = np.random.default_rng(n)
    centres = rng.standard_normal((6, size))
    rows = [(int(i), [float(np.float32(x)) for x in np.round(centres[i % 6] + rng.standard_normal(size) * 0.2, 1)]) for i in rng.permutation(n)]
    rows += rows[:20] + [(None, rows[0][1]), (5, None), (6, [None] * size), (7, [float("nan")] * size), (8, [float("inf")] * size)]
    df = spark.createDataFrame([(i, v, "a" if k % 3 else None, "x") for k, (i, v) in enumerate(rows)], "vec_id bigint, embedding array<float>, label string, size string").repartition(3)
    coded, books = vc.compress(df, parts=parts, entries=entries, scale=10)
    want, want_books = plain(rows, parts, entries, 2, 10)
    assert sorted((r.id is None, r.id or 0, bytes(r.code), r.error) for r in coded.collect()) == sorted((rows[k][0] is None, rows[k][0] or 0, *x) for k, x in want.items())
    assert vc.entry_values(books[size], size) == [x for p in want_books for e in p for x in e]
    sums = {}
    for k, (_, error) in want.items():
        sums[k % 3 > 0] = sums.get(k % 3 > 0, 0) + error
    assert {(r.label is not None, r.label_error) for r in vc.with_label_error(coded).collect()} == set(sums.items())
    back = vc.decode(coded, books, 10).collect()
    given = {(i, tuple(math.floor(10 * x) for x in v)) for i, v in (rows[k] for k in want)}
    for r in back[:50]:
        values = [math.floor(10 * x) for x in r.vector]
        assert len(values) == size and any(i == r.id and sum((a - b) ** 2 for a, b in zip(values, v, strict=True)) == r.error for i, v in given)


def test_subtrees_go_at_once():
    """Entries far apart: the tree is decided near its root, with the same sums as point by point."""
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-5, 5, (1, 3000, 4)) + c for c in (0, 1000, 2000)], axis=1)
    book = np.array([[[0] * 4, [1000] * 4, [2000] * 4, [1000] * 4]])
    forest = vc.Forest.unpack(vc.Forest.build(points).pack())
    sums, counts, chosen = forest.assign(book, True)
    assert counts.tolist() == [[3000, 3000, 3000, 0]]  # the equal entry with the higher index gets nothing
    want = np.argmin(((points[0][:, None, :] - book[0][None]) ** 2).sum(axis=2), axis=1)
    assert (chosen[0] == want[forest.order[0]]).all()
    for e in range(3):
        assert (sums[0, e] == points[0][want == e].sum(axis=0)).all()


def test_empty_lengths_and_large(spark):
    ddl = "vec_id bigint, embedding array<double>, label int"
    coded, books = vc.compress(spark.createDataFrame([], ddl))
    assert coded.count() == 0 and not books and vc.with_label_error(coded).count() == 0
    rows = [(1, [0.5] * 32, 1), (2, [0.25] * 16, 1), (3, [], 2), (4, [0.5] * 32, None)]
    coded, books = vc.compress(spark.createDataFrame(rows, ddl))
    assert {(r.id, r.size, bytes(r.code), r.error) for r in coded.collect()} == {(1, 32, bytes(16), 0), (2, 16, bytes(16), 0), (3, 0, bytes(16), 0), (4, 32, bytes(16), 0)}
    assert sorted(books) == [0, 16, 32]
    with pytest.raises(ValueError, match="too large"):
        vc.compress(spark.createDataFrame([(1, [1e300] * 16, 1)], ddl))
