"""Results that must not pass through one row, one group or the driver."""

import random
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import functions as F

from flowlens.operators import graph, sets
from flowlens.plans import catalog, graphs, registry  # noqa: F401
from flowlens.sources import readers
from flowlens.streaming import traces


def test_stream_dict_stays_on_executors(spark):
    df = registry.QUERIES["stream_dict"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" not in plan and "stream-" in "".join(df.inputFiles())


def test_one_user_moves_one_row_for_each_node():
    n = 1000
    batch = pa.RecordBatch.from_pydict({"user_id": [1] * n, "node": [None if i % 3 == 2 else "ab"[i % 3] for i in range(n)], "event_id": list(range(n, 0, -1))})
    rows = [r for b in traces._firsts(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["node"] or "", r["first"]) for r in rows) == [("", 2), ("a", 1), ("b", 3)]


def test_fault_map_lines_are_bounded(spark, monkeypatch):
    part = spark.range(20000).select(F.lit(7).alias("p_size"), F.col("id").alias("p_partkey"))
    seen = []
    monkeypatch.setattr(readers, "read_fault_map", lambda lines, f=readers.read_fault_map: seen.append(lines) or f(lines))
    rows = catalog.explode_list(SimpleNamespace(part=part)).collect()
    assert sorted((r.version, r.line_no) for r in rows) == [(7, i) for i in range(-1, 20000)]
    assert max(len(r.line) for r in seen[0].collect()) < 4096 * 6 + 20


def _components(edges):
    """A plain search from every node."""
    after, nodes = {}, {x for e in edges for x in e}
    for a, b in edges:
        after.setdefault(a, set()).add(b)

    def reached(start):
        seen, todo = {start}, [start]
        while todo:
            for nxt in after.get(todo.pop(), ()):
                if nxt not in seen:
                    seen.add(nxt)
                    todo.append(nxt)
        return seen

    reach = {n: reached(n) for n in nodes}
    return {n: min(m for m in reach[n] if n in reach[m]) for n in nodes}


def test_strong_components_against_a_plain_search(spark):
    rng = random.Random(5)
    rings = [(3, 1), (1, 2), (2, 3), (1, 11), (11, 10), (10, 12), (12, 11), (12, 20), (20, 20), (20, 30), (31, 30), (0, 3)]
    for edges in (rings, [(rng.randrange(16), rng.randrange(16)) for _ in range(24)]):
        df = spark.createDataFrame([*edges, (None, 5), edges[0]], "src bigint, dst bigint")
        assert dict(graph.strong_components(df).collect()) == _components(edges)
    assert graph.strong_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_interned_sets_are_numbered_in_order(spark):
    rows = [(i, j) for i in range(60) for j in range(7) if (i % 13 + 1) >> j & 1] + [(99, None)]
    out = sets.intern(spark.createDataFrame(rows, "o bigint, item int"), "o", "item").collect()
    want = {}
    for o, j in rows:
        if j is not None:
            want.setdefault(o, set()).add(j)
    number = {s: i + 1 for i, s in enumerate(sorted({tuple(sorted(s)) for s in want.values()}))}
    assert {r.o: r.set_id for r in out} == {o: number[tuple(sorted(s))] for o, s in want.items()}
