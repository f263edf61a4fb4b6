"""Graphs with long chains, rings and random edges, against plain searches."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import graph, pointsto


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src bigint, dst bigint")


def nodes(spark, items):
    return spark.createDataFrame([(i,) for i in items], "node bigint")


def values(df):
    return sorted(tuple(r) for r in df.collect())


def ahead(pairs, start):
    """{node: depth}"""
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    depth, front = {s: 0 for s in start}, list(start)
    while front:
        found = []
        for a in front:
            for b in after.get(a, ()):
                if b not in depth:
                    depth[b] = depth[a] + 1
                    found.append(b)
        front = found
    return depth


def made(seed):
    """Random edges with chains, rings, caterpillars and loops."""
    rng = random.Random(seed)
    pairs, n = [], 40
    for _ in range(45):
        pairs.append((rng.randrange(n), rng.randrange(n)))
    for k in range(6):
        a, length = 1000 * (k + 1), rng.randrange(1, 40)
        pairs += [(rng.randrange(n), a), *((a + i, a + i + 1) for i in range(length))]
        if k % 2:
            pairs.append((a + length, rng.randrange(n)))
        if k == 4:
            pairs += [(a + i, a + 500 + i) for i in range(length)]
    pairs += [(9000 + i, 9000 + (i + 1) % 7) for i in range(7)] + [(9100, 9101), (9101, 9100), (9200, 9200), (9101, 9200)]
    return pairs + pairs[:9]


@pytest.mark.parametrize("seed", range(2))
def test_against_plain_searches(spark, monkeypatch, seed):
    monkeypatch.setattr(graph, "PATIENCE", 2 + seed)
    pairs = made(seed)
    every = {x for p in pairs for x in p}
    e = edges(spark, pairs)
    assert values(graph.reach(e, nodes(spark, [3, 17]))) == sorted(ahead(pairs, [3, 17]).items())
    cl = {(a, c) for a in every for b in {y for x, y in pairs if x == a} for c in ahead(pairs, [b])}
    if seed:
        return
    scc = {a: min([a] + [b for b in every if (a, b) in cl and (b, a) in cl]) for a in every}
    assert values(graph.strong_components(e)) == sorted(scc.items())
    assert values(graph.closure(e)) == sorted(cl)
    some = [0, 5, 1000, 9003, 77777]
    assert values(graph.closure(e, nodes(spark, some))) == sorted(p for p in cl if p[0] in some)
    facts = spark.createDataFrame([(a, a % 3) for a in sorted(every) if a % 5 == 0] + [(88888, 1)], "node bigint, fact bigint")
    want = {(a, f) for f in range(3) for a in every for b in every if b % 5 == 0 and b % 3 == f and (a == b or (a, b) in cl)} | {(88888, 1)}
    assert values(graph.bottom_up(e, facts)) == sorted(want)


def test_a_long_chain_and_a_ring(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    found = graph.reach(chain, nodes(spark, [0]))
    assert found.agg(F.count("*"), F.max("depth"), F.sum(F.col("node") - F.col("depth"))).first() == (n + 1, n, 0)
    ring = spark.range(10_000).select(F.col("id").alias("src"), ((F.col("id") + 1) % 10_000).alias("dst"))
    assert graph.strong_components(ring).groupBy("scc").count().collect() == [(0, 10_000)]
    assert graph.reach(ring, nodes(spark, [5])).agg(F.count("*"), F.max("depth")).first() == (10_000, 9_999)
    facts = spark.createDataFrame([(7, 1), (8, 2)], "node bigint, fact bigint")
    assert graph.bottom_up(ring, facts).groupBy("fact").count().orderBy("fact").collect() == [(1, 10_000), (2, 10_000)]


def test_a_deep_closure_takes_few_rounds(spark):
    chain = [(i, i + 1) for i in range(300)]
    assert graph.closure(edges(spark, chain)).count() == 300 * 301 // 2


def solved(addr, copy, load, store):
    pts, flow = set(addr), set(copy)
    while True:
        more = {(t, o) for t, f in flow for v, o in pts if v == f}
        through = {(t, o) for t, f in load for v, o in pts if v == f} | {(o, f) for t, f in store for v, o in pts if v == t}
        if more <= pts and through <= flow:
            return pts
        pts, flow = pts | more, flow | through


@pytest.mark.parametrize("seed", range(2))
def test_points_to_against_plain(spark, monkeypatch, seed):
    monkeypatch.setattr(pointsto, "PATIENCE", seed)
    rng = random.Random(seed)
    pick = lambda n: [(rng.randrange(25), rng.randrange(25)) for _ in range(n)]
    addr, copy, load, store = pick(10), pick(14), pick(8), pick(8)
    two = lambda rows, a, b: spark.createDataFrame([*rows, (None, 3), (4, None), *rows[:2]], f"`{a}` bigint, `{b}` bigint")
    got = pointsto.points_to(two(addr, "var", "obj"), two(copy, "to", "from"), two(load, "to", "from"), two(store, "to", "from"))
    want = solved(addr, copy, load, store)
    assert values(got.select("var", "obj")) == sorted(want)
    of = lambda v: {o for w, o in want if w == v}
    pairs = [(a, b) for a in range(25) for b in range(25) if a < b]
    assert values(pointsto.aliases(got)) == [p for p in pairs if of(p[0]) & of(p[1])]
    apart = pointsto.must_not_alias(got, spark.createDataFrame(pairs[::3], "a bigint, b bigint"))
    assert values(apart) == [p for p in pairs[::3] if not of(p[0]) & of(p[1])]
    out, front = set(), of(3) | of(4)
    while front - out:
        out |= front
        front = {o for v in front for o in of(v)}
    assert values(pointsto.escaped(got, spark.createDataFrame([(3,), (4,)], "var bigint"))) == sorted((o,) for o in out)


def test_a_ring_of_copies_is_one_variable(spark):
    """2,000 variables that copy each other in a ring, 50 addresses: the loop holds 50 facts, not 100,000."""
    n = 2000
    copy = spark.range(n).select(F.col("id").alias("to"), ((F.col("id") + 1) % n).alias("from"))
    addr = spark.range(50).select((F.col("id") * 7).alias("var"), (F.col("id") + 10_000).alias("obj"))
    none = copy.where("false")
    found = pointsto.points_to(addr, copy, none, none)
    assert found.agg(F.count("*"), F.count_distinct("var"), F.count_distinct("obj")).first() == (50 * n, n, 50)
