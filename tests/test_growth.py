"""Results, and the shape of plans, of steps whose cost grew faster than their input."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.functions import scalars as fn
from flowlens.operators import bitsets, dataflow, graph, pointsto, sets, taint
from flowlens.plans import catalog, graphs, registry  # noqa: F401  the first two register their queries


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_virtual_calls_write_their_rows_where_they_are_made(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 2)
    sites = [(i, i % 3, i % 2) for i in range(20)] + [(0, 2, 0), (0, 2, 0), (50, None, 1), (51, 1, None), (52, 9, 0)]
    inherits, tables = [(0, 1), (0, 2), (1, 3)], [(c, s, 100 * c + f) for c in range(4) for s in range(2) for f in range(5)] + [(3, 0, 7), (1, 0, 7)]
    below = {0: {0, 1, 2, 3}, 1: {1, 3}, 2: {2}}
    want = {(site, f) for site, c, s in sites for d, t, f in tables if d in below.get(c, ()) and s == t}
    df = graph.virtual_calls(spark.createDataFrame(sites, "site long, cls long, slot long"), spark.createDataFrame(inherits, "base long, sub long"), spark.createDataFrame(tables, "cls long, slot long, fn long"))
    assert values(df) == sorted(want, key=repr)
    assert "Join" not in plan(df) and "Aggregate" not in plan(df)


def test_bit_counts_of_members_far_apart(spark):
    rows = [(o, i) for o in ("a", "b", None) for i in (-1, -64, 0, 63, 64, 2**40, 2**40, None)] + [("c", None)]
    df = sets.bit_counts(spark.createDataFrame(rows, "o string, i long"), "o", "i")
    assert values(df) == sorted([("a", 6), ("b", 6), ("c", 0), (None, 6)], key=repr)
    assert "bitmap" not in plan(df)  # 4 KB for each member far from the others


def test_double_hash_without_decimals(spark):
    items = [None, b"", b"a", b"ab", bytes(range(256)) * 3, b"\xff" * 40, None, b"xyz"]

    def plain(b):
        add = mul = 0
        for x in b:
            add, mul = (add * 11 + x) % 2**64, (mul * 7) % 2**64 ^ x
        return f"{add}{mul}"

    df = spark.createDataFrame([(i, b and bytearray(b)) if b else (i, b) for i, b in enumerate(items)], "i int, b binary").select("i", fn.double_hash(F.col("b")).alias("h"))
    assert values(df) == [(i, None if b is None else plain(b)) for i, b in enumerate(items)]
    assert "decimal" not in plan(df)


@pytest.mark.parametrize("seed", range(6))
def test_points_to_settles_neighbours_first(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(pointsto, "BLOCK_BITS", 3)
    monkeypatch.setattr(pointsto, "CHUNK_BITS", 1)
    reach = (0, 1, 40)[seed % 3]  # all names of a statement in one block, in this one or the next, anywhere
    base = lambda: 8 * rng.randrange(-3, 5)
    some = lambda n: [(b + rng.randrange(8), b + rng.randrange(8) + 8 * rng.randrange(-reach, reach + 1) if rng.random() < 0.2 else b + rng.randrange(8)) for b in (base() for _ in range(n))]
    addr, copy, load, store = some(20), some(20), some(15), some(15)
    facts, links = set(addr), set(copy)
    while True:
        more = {(t, o) for f, t in ((b, a) for a, b in links) for v, o in facts if v == f}
        edges = {(t, o) for t, f in load for v, o in facts if v == f} | {(o, f) for t, f in store for v, o in facts if v == t}
        if more <= facts and edges <= links:
            break
        facts, links = facts | more, links | edges
    rounds = []
    monkeypatch.setattr(pointsto.Known, "with_", lambda self, *m, f=pointsto.Known.with_: rounds.append(1) or f(self, *m))
    two = lambda rows, a, b: spark.createDataFrame(rows + [(None, 1)], f"{a} long, {b} long")
    got = pointsto.points_to(two(addr, "var", "obj"), two(copy, "to", "from"), two(load, "to", "from"), two(store, "to", "from"))
    assert values(got) == sorted(facts, key=repr)
    assert reach or not rounds  # nothing is left for the loop


def test_aliases_are_met_by_words(spark):
    pts = spark.createDataFrame([(1, o) for o in range(64)] + [(2, 63), (3, 64), (4, -1)], "var long, obj long")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 1), (5, 1), (1, 2)], "a long, b long")
    assert values(pointsto.must_not_alias(pts, pairs)) == sorted([(1, 3), (2, 3), (4, 1), (5, 1)], key=repr)
    named = lambda df: df.select(*[F.concat(F.lit("n"), F.col(c).cast("string")).alias(c) for c in df.columns])
    assert pointsto.must_not_alias(named(pts), named(pairs)).count() == 4


def test_bit_sets_side_by_side(spark):
    rows = [("x", i, k) for i, k in [(-65, "a"), (-1, "b"), (0, "b"), (5, "a"), (5, "b"), (63, "b"), (64, "a"), (2**40 + 63, "b"), (9, "c"), (7, None), (None, "a")]] + [(None, 3, "a"), ("y", 1, "c"), ("z", -3, "a")]
    df = bitsets.side_by_side(spark.createDataFrame(rows, "o string, i long, k string"), "o", "i", a=F.col("k") == "a", b=F.col("k") == "b")
    got = df.groupBy("owner").agg(*[F.sum(F.bit_count(c)) for c in "ab"], *[F.sum(bitsets.total(F.col("word"), F.col(c))) for c in "ab"])
    assert values(got) == [("x", 3, 5, 4, 67 + 2**40 + 63), ("z", 1, 0, -3, None)]
    assert "Join" not in plan(got)


def test_a_query_alone_writes_what_it_needs_twice():
    assert registry._shared(["constraint_gen"]) == {"stmt": {"constraint_gen", "pointing"}} and registry._shared(["points_to"]) == {}


def test_labels_join_fields_once(spark):
    config = spark.createDataFrame([(1, 2, 5), (1, 2, 5), (2, None, None), (2, 0, 1), (3, 9, 12)], "loc_id long, off_lo int, off_hi int")
    fields = spark.createDataFrame([(1, 1, 2, 11), (1, 4, 5, 14), (1, 5, 6, 15), (2, 7, 8, 27), (2, None, None, 28), (3, 1, 2, 31), (4, 1, 2, 41)], "loc_id long, off_lo int, off_hi int, elem_id long")
    df = taint.label_elements(config, fields)
    assert values(df) == [(14,), (27,), (28,)]
    assert plan(df).count("Join") == 1


def test_held_values_meet_in_parts_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(taint, "ROWS", 100)
    held = spark.range(1200).select((F.col("id") % 7).alias("fn"), F.concat(F.lit("p"), F.col("id") % 300).alias("elem_id"))
    tainted = spark.range(0, 600, 3).select(F.concat(F.lit("p"), "id").alias("elem_id"))
    df = taint.mediators(held, tainted)
    assert values(df) == [(f, len({i % 300 for i in range(1200) if i % 7 == f and i % 3 == 0})) for f in range(7)]
    assert plan(df).count("RepartitionByExpression [elem_id") == 2 and ", 13" in plan(df)


def test_calls_and_returns_are_computed_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(rows):
        def run(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        return spark.createDataFrame(rows, "site long, src string, dst string").coalesce(1).mapInArrow(run, "site long, src string, dst string")

    flow = spark.createDataFrame([("f", "r")], "src string, dst string")
    sources = spark.createDataFrame([("a",)], "node string")
    df = dataflow.context_reach(flow, counted([(1, "a", "f"), (2, "b", "f")]), counted([(1, "r", "x"), (2, "r", "y")]), sources)
    assert values(df) == sorted([("a", None), ("x", None), ("f", 1), ("r", 1)], key=repr)
    assert read.value == 4


def test_facts_that_reach_far_are_dealt_as_they_are_found(spark):
    """Definitions that go through a chain of blocks: a round deals what it finds, not all that was found before."""
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    n, length = 3000, 14
    defs = spark.range(n).select(F.lit(0).alias("block"), F.lit(0).alias("pos"), "id", F.xxhash64("id").alias("loc"), F.lit(True).alias("strong"))
    uses = spark.range(n).select(F.lit(length).alias("block"), F.lit(0).alias("pos"), (F.col("id") + n).alias("id"), F.xxhash64("id").alias("loc"))
    flow = spark.range(length).select(F.col("id").cast("int").alias("src"), (F.col("id") + 1).cast("int").alias("dst"))
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        df = dataflow.reaching_definitions(flow, defs, uses)
        assert df.where("def_id + 3000 = use_id").count() == df.count() == n
        dealt = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert dealt < 80 * n * length
