"""Data flow, call contexts and constraint generation, against plain versions and one fixture for each rule."""

import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import bitsets, constraints, dataflow, fixpoint, pointsto, taint


def values(df):
    return sorted(tuple(r) for r in df.collect())


def plain_reaching(flow, defs, uses):
    """Walks from every definition until something kills it."""
    out = set()
    for block, pos, loc, d, _ in defs:
        seen, front = set(), [(block, pos)]
        while front:
            b, p = front.pop()
            kill = min((q for x, q, y, _, strong in defs if x == b and y == loc and strong and q > p), default=None)
            out |= {(d, u) for x, q, y, u in uses if x == b and y == loc and q > p and (kill is None or q <= kill)}
            if kill is None:
                for a, c in flow:
                    if a == b and c not in seen:
                        seen.add(c)
                        front.append((c, -1))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_reaching_definitions_against_plain(spark, seed):
    rng = random.Random(seed)
    flow = [(rng.randrange(9), rng.randrange(9)) for _ in range(13)]
    places = [(b, p) for b in range(9) for p in range(6)]
    defs = [(b, p, rng.choice("xyz"), 100 + i, rng.random() < 0.7) for i, (b, p) in enumerate(rng.sample(places, 22))]
    uses = [(b, p, rng.choice("xyz"), 500 + i) for i, (b, p) in enumerate(rng.sample(places, 25))]
    got = dataflow.reaching_definitions(
        spark.createDataFrame([*flow, (None, 1), flow[0]], "src int, dst int"), spark.createDataFrame([*defs, (None, 0, "x", 1, True), (1, 0, None, 2, True)], "block int, pos int, loc string, id int, strong boolean"),
        spark.createDataFrame([*uses, (1, 3, None, 3)], "block int, pos int, loc string, id int"),
    )
    assert values(got) == plain_reaching(flow, defs, uses)


def test_stores_through_pointers(spark):
    """*p = 1 kills what p alone points to; *q = 2 kills neither of two."""
    pointing = spark.createDataFrame([("p", "x"), ("q", "x"), ("q", "y")], "var string, obj string")
    stores = spark.createDataFrame([(1, 5, "p", 11), (1, 7, "q", 12)], "block int, pos int, var string, id int")
    named = dataflow.through_pointers(stores, pointing)
    assert values(named) == [(1, 5, "x", 11, True), (1, 7, "x", 12, False), (1, 7, "y", 12, False)]
    plain = spark.createDataFrame([(1, 1, "x", 9, True), (1, 2, "y", 10, True)], "block int, pos int, loc string, id int, strong boolean")
    uses = spark.createDataFrame([(1, 6, "x", 50), (1, 8, "x", 51), (1, 8, "y", 52)], "block int, pos int, loc string, id int")
    flow = spark.createDataFrame([], "src int, dst int")
    assert values(dataflow.reaching_definitions(flow, plain.unionByName(named), uses)) == [(10, 52), (11, 50), (11, 51), (12, 51), (12, 52)]


def test_calls_return_where_they_were_called(spark):
    """Two callers of one function, one of them tainted; and a call within the callee."""
    three = "site string, src string, dst string"
    flow = spark.createDataFrame([("f", "g_arg"), ("g_res", "f_res"), ("g", "g_out"), ("a_out", "sink1"), ("b_out", "sink2")], "src string, dst string")
    calls = spark.createDataFrame([("s1", "a", "f"), ("s2", "b", "f"), ("s3", "g_arg", "g"), ("s4", "lost", None)], three)
    returns = spark.createDataFrame([("s1", "f_res", "a_out"), ("s2", "f_res", "b_out"), ("s3", "g_out", "g_res")], three)
    assert values(dataflow.summaries(flow, calls, returns)) == [("a", "a_out"), ("b", "b_out"), ("g_arg", "g_res")]
    got = dataflow.context_reach(flow, calls, returns, spark.createDataFrame([("a",)], "node string"))
    found = {(r.node, r.site) for r in got.collect()}
    assert {n for n, s in found if s is None} == {"a", "a_out", "sink1"}
    assert ("g", "s3") in found and ("f", "s1") in found and not {n for n, _ in found} & {"b_out", "sink2"}
    # a source inside the function goes out to every caller
    inside = dataflow.context_reach(flow, calls, returns, spark.createDataFrame([("g",)], "node string"))
    assert {"sink1", "sink2"} <= {r.node for r in inside.collect()}


def solve(spark, insts, operands, points=(), sources=("key",), implicit=False, control=None, elements=None, params=None, results=None):
    """Tainted values; instructions are (inst, op, result, block, fn), operands (inst, pos, value)."""
    made = constraints.generate(
        spark.createDataFrame(insts, "inst int, op string, result string, block int, fn string"), spark.createDataFrame(operands, "inst int, pos int, value string"), spark.createDataFrame(list(points), "var string, obj string"),
        None if elements is None else spark.createDataFrame(elements, "obj string, elem string"), None if control is None else spark.createDataFrame(control, "block int, cond string"),
        None if params is None else spark.createDataFrame(params, "fn string, pos int, value string"), None if results is None else spark.createDataFrame(results, "fn string, value string"),
    )
    assert made.columns == ["lhs", "rhs", "kind", "section"]
    return {r.elem_id for r in taint.least_solution(made, spark.createDataFrame([(s,) for s in sources], "elem_id string"), implicit=implicit).collect()} - set(sources)


RULES = {
    "values flow, constants and addresses do not": (dict(insts=[(1, "binop", "a", 1, None), (2, "addr", "p", 1, None), (3, "copy", "c", 1, None)], operands=[(1, 0, "key"), (1, 1, None), (2, 0, "key"), (3, 0, "p")]), {"a"}),
    "fields behind a pointer are separate": (
        dict(insts=[(1, "store", None, 1, None), (2, "load", "r", 1, None), (3, "load", "s", 1, None)], operands=[(1, 0, "pb"), (1, 1, "key"), (2, 0, "pb"), (3, 0, "pc")], points=[("pb", "c.b"), ("pc", "c.c")]), {"c.b", "r"}),
    "an index that is not constant reaches all elements": (
        dict(insts=[(1, "store", None, 1, None), (2, "load", "r", 1, None)], operands=[(1, 0, "px"), (1, 1, "key"), (2, 0, "p2")], points=[("px", "x"), ("p2", "x[2]")], elements=[("x", "x[0]"), ("x", "x[1]"), ("x", "x[2]")]), {"x[0]", "x[1]", "x[2]", "r"}),
    "constant indexes are separate": (
        dict(insts=[(1, "store", None, 1, None), (2, "load", "r", 1, None)], operands=[(1, 0, "p1"), (1, 1, "key"), (2, 0, "p2")], points=[("p1", "x[1]"), ("p2", "x[2]")], elements=[("x", "x[1]"), ("x", "x[2]")]), {"x[1]"}),
    "a heap array has one element": (dict(insts=[(1, "store", None, 1, None), (2, "load", "r", 1, None)], operands=[(1, 0, "p1"), (1, 1, "key"), (2, 0, "p2")], points=[("p1", "heap"), ("p2", "heap")]), {"heap", "r"}),
    "a known function passes what its body passes": (
        dict(insts=[(1, "call", "r", 1, "f"), (2, "store", None, 2, None)], operands=[(1, 0, "pp"), (1, 1, "key"), (2, 0, "c"), (2, 1, "d")], points=[("pp", "p"), ("c", "p")], params=[("f", 0, "c"), ("f", 1, "d")], results=[("f", "zero")]), {"d", "p"}),
    "an unknown function passes arguments to pointers and result": (dict(insts=[(1, "call", "z", 1, "g")], operands=[(1, 0, "px"), (1, 1, "key")], points=[("px", "x")], params=[("f", 0, "c")], results=[("f", "zero")]), {"x", "z"}),
    "an unknown function reads what its pointers reach": (dict(insts=[(1, "call", "z", 1, "g")], operands=[(1, 0, "px"), (1, 1, "py")], points=[("px", "key"), ("py", "y")]), {"y", "z"}),
    "a branch taints what it decides, on demand": (
        dict(insts=[(1, "copy", "i", 2, None), (2, "store", None, 2, None), (3, "copy", "j", 3, None)], operands=[(1, 0, "one"), (2, 0, "p"), (2, 1, "one"), (3, 0, "one")], points=[("p", "x")], control=[(2, "key")], implicit=True), {"i", "x"}),
    "implicit flows are off by default": (dict(insts=[(1, "copy", "i", 2, None)], operands=[(1, 0, "one")], control=[(2, "key")]), set()),
    "nested branches": (dict(insts=[(1, "compare", "c2", 2, None), (2, "copy", "x", 3, None)], operands=[(1, 0, "one"), (2, 0, "one")], control=[(2, "key"), (3, "c2")], implicit=True), {"c2", "x"}),
    "a phi takes all values that meet": (dict(insts=[(1, "phi", "v", 4, None)], operands=[(1, 0, "one"), (1, 1, "key")]), {"v"}),
}


@pytest.mark.parametrize("name", RULES)
def test_constraint_rule(spark, name):
    given, want = RULES[name]
    assert solve(spark, **given) == want


def test_offsets(spark):
    steps = spark.createDataFrame([("p", "q", 4), ("q", "r", 4), ("p", "r", 8), ("p", "s", 3), ("q", "s", 0), ("s", "t", 1), ("p", "i", 0), ("i", "j", 8), ("j", "i", 0), ("r", "u", None), (None, "v", 1)], "src string, dst string, offset long")
    got = {(r.root, r.node): r.offset for r in constraints.pointer_offsets(spark.createDataFrame([("p",), ("q",), (None,)], "root string"), steps).collect()}
    assert got == {("p", "p"): 0, ("p", "q"): 4, ("p", "r"): 8, ("p", "s"): None, ("p", "t"): None, ("p", "i"): None, ("p", "j"): None, ("p", "u"): None, ("q", "q"): 0, ("q", "r"): 4, ("q", "s"): 0, ("q", "t"): 1, ("q", "u"): None}


def test_a_global_that_an_argument_reaches_escapes(spark):
    pointing = spark.createDataFrame([("a", "G"), ("G", "heap"), ("ptr", "local")], "var string, obj string")
    assert values(pointsto.escaped(pointing, spark.createDataFrame([("a",)], "var string"))) == [("G",), ("heap",)]


def test_bit_sets(spark):
    two = lambda rows: spark.createDataFrame(rows, "owner string, item bigint")
    rows = [("v", 5), ("v", 5), ("v", 63), ("v", 64), ("v", -1), ("w", 2**40), ("v", None), (None, 3)]
    v = bitsets.packed(two(rows), "owner", "item")
    assert values(bitsets.members(v)) == [("v", -1), ("v", 5), ("v", 63), ("v", 64), ("w", 2**40)] and values(bitsets.counts(v)) == [("v", 4), ("w", 1)]
    assert values(bitsets.tested(v, two([("v", 5), ("v", 17), ("v", -1), ("x", 5)]))) == [("v", -1, True), ("v", 5, True), ("v", 17, False), ("x", 5, False)]
    less = bitsets.difference(v, bitsets.packed(two([("v", 5), ("v", 6), ("w", 2**40)]), "owner", "item"))
    assert values(bitsets.members(less)) == [("v", -1), ("v", 63), ("v", 64)]
    more, new = bitsets.test_and_set(less, two([("v", 17), ("v", 17), ("v", 63)]))
    assert values(new) == [("v", 17)] and values(bitsets.test_and_set(more, two([("v", 17)]))[1]) == []
    assert values(bitsets.members(bitsets.intersection(more, v))) == [("v", -1), ("v", 63), ("v", 64)]
    assert bitsets.counts(bitsets.packed(two([]), "owner", "item")).count() == 0


def test_reaching_definitions_in_buckets(spark, monkeypatch):
    """Facts, kills and flow lie in several buckets; names and structs are keys as good as numbers; no table is left."""
    monkeypatch.setattr(fixpoint.Dealt, "ROWS", 5)
    rng = random.Random(7)
    flow = [(rng.randrange(9), rng.randrange(9)) for _ in range(13)]
    places = [(b, p) for b in range(9) for p in range(6)]
    defs = [(b, p, rng.choice("xyz"), 100 + i, rng.random() < 0.7) for i, (b, p) in enumerate(rng.sample(places, 22))]
    uses = [(b, p, rng.choice("xyz"), 500 + i) for i, (b, p) in enumerate(rng.sample(places, 25))]
    name = lambda df, *cols: df.withColumns({c: F.concat(F.lit("b"), F.col(c).cast("string")) for c in cols}).withColumns({c: F.struct(F.col(c)) for c in df.columns if c == "id"})
    got = dataflow.reaching_definitions(
        name(spark.createDataFrame(flow, "src int, dst int"), "src", "dst"), name(spark.createDataFrame(defs, "block int, pos int, loc string, id int, strong boolean"), "block"),
        name(spark.createDataFrame(uses, "block int, pos int, loc string, id int"), "block"),
    )
    assert values(got.select("def_id.id", "use_id.id")) == plain_reaching(flow, defs, uses)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("round_")]
