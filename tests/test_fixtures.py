"""Small inputs with known results."""

import random
import struct
from decimal import Decimal

import pytest

from flowlens.functions import scalars as fn
from flowlens.operators import coverage, faults, graph, joins, pointsto, profiles, sequences, sets, taint
from flowlens.operators.fixpoint import RoundLimitError
from flowlens.sources import readers, sinks
from pyspark.sql import functions as F


def edges(spark, pairs, kind="bigint"):
    return spark.createDataFrame(pairs, f"src {kind}, dst {kind}")


def nodes(spark, items, kind="bigint"):
    return spark.createDataFrame([(i,) for i in items], f"node {kind}")


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_sections(spark):
    text = ["a <: b", "default:", "c <: d", "note", "implicit:", "e <: f", "other:", "g <: h", "source-sink:", "i <: j"]
    df = spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(text)], "file int, line_no bigint, line string")
    got = {r.line: (r.explicit, r.implicit) for r in sequences.sections(df, ["file"]).collect()}
    assert got == {"c <: d": (True, True), "e <: f": (False, True), "g <: h": (False, True), "i <: j": (True, True)}


def test_skip_pairs(spark):
    rng, rows, want = random.Random(1), [], []
    for file in range(60):
        marks = ["x M a M M b M M M c d".split(), [rng.choice("Mab") for _ in range(rng.randrange(0, 25))]][file > 0]
        skip = False
        for i, m in enumerate(marks):
            rows.append((file, i, m))
            if skip:
                skip = False
            elif m == "M":
                skip = True
            else:
                want.append((file, i))
    df = spark.createDataFrame(rows, "file int, line_no int, line string")
    assert values(sequences.skip_pairs(df, F.col("line") == "M", ["file"]).select("file", "line_no")) == want
    assert [r.line for r in sequences.skip_pairs(df.where("file = 0"), F.col("line") == "M", ["file"]).orderBy("line_no").collect()] == ["x", "b", "d"]


def test_first_seen_and_trace(spark):
    df = spark.createDataFrame([(1, 0, "f13"), (1, 1, "f59"), (1, 2, "f13")], "run int, seq int, node string")
    assert [r.id for r in sequences.first_seen_ids(df, "node", ["run"], ["seq"], "id").orderBy("seq").collect()] == [0, 1, 0]
    text = spark.createDataFrame([(1, "0 = (f,1,3)"), (2, ",0"), (3, "1 = (f,5,9)"), (4, ",1,0")], "line_no bigint, line string")
    dictionary, events = readers.read_trace(text)
    assert values(dictionary) == [(0, "f", 1, 3), (1, "f", 5, 9)]
    assert values(events) == [(2, 0, 0), (4, 0, 1), (4, 1, 0)]


def test_violations(spark):
    names = spark.createDataFrame([("S", "*SummSource*"), *((x, x) for x in ["A", "B", "C", "D", "CONST[1]", "CONST[2]"])], "name string, label string")
    e = edges(spark, [("S", "A"), ("A", "CONST[1]"), ("B", "CONST[2]"), ("C", "D"), ("D", "CONST[1]")], "string")
    assert values(graph.violations(names, e)) == [("A", "CONST[1]"), ("B", "CONST[2]"), ("C", "CONST[1]")]


def test_reachability_on_hard_graphs(spark):
    chain = edges(spark, [(i, i + 1) for i in range(120)])
    assert graph.reach(chain, nodes(spark, [0])).agg(F.max("depth")).first()[0] == 120
    cycle = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 4), (5, 1), (None, 2), (1, 2)])
    assert values(graph.closure(cycle).where("src = dst").select("src")) == [(1,), (2,), (3,), (4,)]
    assert graph.reach(cycle, nodes(spark, [])).count() == 0
    with pytest.raises(RoundLimitError):
        graph.reach(chain, nodes(spark, [0]), max_rounds=5)
    assert values(graph.strong_components(cycle)) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    assert values(graph.can_reach(cycle, edges(spark, [(5, 3), (3, 5), (9, 9)]))) == [(5, 3), (9, 9)]
    assert values(graph.contract(cycle, graph.strong_components(cycle))) == [(5, 1)]


def test_ladder_paths(spark):
    rungs, pairs = 6, []
    for i in range(0, rungs, 2):
        pairs += [(i, i + 1)] + ([(i, i + 2), (i + 1, i + 3)] if i + 2 < rungs else [])
    found = graph.simple_paths(edges(spark, pairs), nodes(spark, [0]), nodes(spark, [rungs - 1]))
    assert values(found) == [([0, 1, 3, 5],), ([0, 2, 3, 5],), ([0, 2, 4, 5],)]
    with pytest.raises(RoundLimitError):
        graph.simple_paths(edges(spark, pairs), nodes(spark, [0]), nodes(spark, [5]), max_paths=1)


def test_call_graph_keeps_repeated_edges(spark):
    lines = spark.createDataFrame([('"main" -> "test_function";',), ('"main" -> "test_function";',), ('"main" [shape=record,label="{main}"];',)], "line string")
    names, calls = readers.read_dot(lines)
    assert values(calls) == [("main", "test_function", 2)]
    assert values(names) == [("main", "main")]
    assert values(graph.adjacency(nodes(spark, ["f", "g"], "string"), edges(spark, [("f", "g"), ("f", "g")], "string"))) == [("< root >", "f g"), ("f", "g")]


def test_points_to_with_loads_and_stores(spark):
    pair = lambda rows, a, b: spark.createDataFrame(rows, f"`{a}` string, `{b}` string")
    # p = &x; q = &y; r = &p; *r = q; s = *r
    got = pointsto.points_to(pair([("p", "x"), ("q", "y"), ("r", "p")], "var", "obj"), pair([], "to", "from"), pair([("s", "r")], "to", "from"), pair([("r", "q")], "to", "from"))
    assert values(got) == [("p", "x"), ("p", "y"), ("q", "y"), ("r", "p"), ("s", "x"), ("s", "y")]
    assert values(pointsto.aliases(got)) == [("p", "q"), ("p", "s"), ("q", "s")]


def test_dominators_and_control_dependence(spark):
    e = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 2, 4), (1, 3, 5), (1, 4, 5), (1, 5, 2), (1, 5, 6)], "fn bigint, src bigint, dst bigint")
    entry = lambda n: spark.createDataFrame([(1, n)], "fn bigint, entry bigint")
    dom = graph.dominators(e, entry(1))
    assert values(dom.where("node = 5").select("dom")) == [(1,), (2,), (5,)]
    assert values(graph.control_dependence(e, entry(6)).select("node", "controls")) == [(2, 3), (2, 4), (5, 2), (5, 5)]


@pytest.mark.parametrize(
    ("seed", "want"),
    [("key", {"b0", "b1", "b11"}), ("key5", {"heap"})],
)
def test_taint_field_sensitivity(spark, seed, want):
    """Array elements with constant places are told apart; a heap array has one element for all."""
    c = spark.createDataFrame(
        [("key", "arr0", "default", "default"), ("key", "arr1", "default", "default"), ("key", "arr11", "default", "default"), ("other", "arr2", "default", "default"), ("key5", "heap", "default", "default")],
        "lhs string, rhs string, kind string, section string",
    )
    sites = spark.createDataFrame([("b0", "arr0"), ("b1", "arr1"), ("b2", "arr2"), ("b11", "arr11"), ("heap", "heap")], "branch_id string, elem_id string")
    sources = spark.createDataFrame([(seed,)], "elem_id string")
    assert {r.branch_id for r in taint.report(sites, taint.least_solution(c, sources)).collect()} == want


def test_taint_whitelist_chain_and_implicit(spark):
    c = spark.createDataFrame([("key", "a", "default", "default"), ("key", "b", "default", "default"), ("b", "c", "default", "default"), ("a", "d", "default", "default"), ("a", "e", "default", "implicit")], "lhs string, rhs string, kind string, section string")
    source, listed = spark.createDataFrame([("key",)], "elem_id string"), spark.createDataFrame([("b",)], "elem_id string")
    got = lambda cons, **k: {r.elem_id for r in taint.least_solution(cons, source, **k).collect()}
    assert got(c) == {"key", "a", "b", "c", "d"}
    assert got(c, implicit=True) == {"key", "a", "b", "c", "d", "e"}
    assert got(taint.without_whitelist(c, listed)) == {"key", "a", "d"}
    every = spark.createDataFrame([(x,) for x in ["key", "a", "b", "c", "d"]], "elem_id string")
    assert values(taint.greatest_solution(c, spark.createDataFrame([("d",)], "elem_id string"), every)) == [("b",), ("c",)]


def test_labels_by_field(spark):
    fields = spark.createDataFrame([(1, 0, 4, 10), (1, 4, 8, 11), (1, 8, 12, 12), (2, 0, 4, 20), (2, 4, 8, 21)], "loc_id int, off_lo int, off_hi int, elem_id int")
    config = spark.createDataFrame([(1, 8, 12), (2, None, None)], "loc_id int, off_lo int, off_hi int")
    assert values(taint.label_elements(config, fields)) == [(12,), (20,), (21,)]
    accesses = spark.createDataFrame([(1, 0, 8), (2, 60, 70), (3, 500, 600)], "id int, lo int, hi int")
    regions = spark.createDataFrame([(0, 64), (400, 1000)], "lo int, hi int")
    assert values(taint.check_accesses(accesses, regions).select("id")) == [(2,)]


RANKS = {
    "edge_const": ("1x3 4x2 5x2 6x4 7x1 8x1 9x3 10x2 11x1 12x1 13x3 14x1 16x1 17x1 19x1 23x2 24x1 25x1 37x1 42x1", 33, 20),
    "node_freq": ("1x3 2x5 3x1 4x1 5x1 10x2 13x2 14x1 15x5 16x2 17x2 18x1 19x5 20x1 22x1 23x2 28x1 37x1", 37, 18),
}


@pytest.mark.parametrize("name", RANKS)
def test_rank_curve(spark, name):
    text, n, points = RANKS[name]
    ranks = [int(r) for part in text.split() for r, k in [part.split("x")] for _ in range(int(k))]
    curve = values(faults.rank_curve(spark.createDataFrame([(str(r), 57) for r in ranks], "rank_raw string, total int")))
    assert len(ranks) == n and len(curve) == points
    assert curve[0] == (1 / 57, 3 / n) and curve[-1][1] == 1.0
    lost = values(faults.rank_curve(spark.createDataFrame([*((str(r), 57) for r in ranks), (">60", 60)], "rank_raw string, total int")))
    assert lost[0] == (1 / 60, 3 / n)


def counters(spark, *inputs):
    rows = [(name, f, h, i + 1, Decimal(v)) for name, records in inputs for f, h, vs in records for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "input string, fn string, hash int, pos int, v decimal(20,0)")


def merged(df):
    out = {}
    for r in profiles.merge_counters(df).orderBy("pos").collect():
        out.setdefault((r.fn, r.hash), []).append(r.error or int(r.v))
    return out


def test_profile_merge(spark):
    a, b = [("foo", 3, [1, 2, 3])], [("foo", 3, [7, 5, 3])]
    assert merged(counters(spark, ("a", a), ("b", b))) == merged(counters(spark, ("a", b), ("b", a))) == {("foo", 3): [8, 7, 6]}
    assert merged(counters(spark, ("a", a), ("b", [("foo", 3, [2, 3, 5]), ("bar", 3, [7, 11, 13])]))) == {("foo", 3): [3, 5, 8], ("bar", 3): [7, 11, 13]}
    lengths = counters(spark, ("a", [("foo", 1024, [1, 2, 4, 8])]), ("b", [("foo", 1024, [2, 4, 8])]), ("c", [("foo", 1024, [4, 8, 16, 32])]))
    assert merged(lengths) == {("foo", 1024): [5, 10, 20, 40]}
    assert values(profiles.length_errors(lengths)) == [("b", "foo", 1024)]
    assert merged(counters(spark, ("a", [("foo", 1, [1])]), ("b", [("foo", 2, [2])]))) == {("foo", 1): [1], ("foo", 2): [2]}
    assert merged(counters(spark, ("a", [("foo", 1, [2**63, 1])]), ("b", [("foo", 1, [2**63, 1])]))) == {("foo", 1): ["counter overflow", 2]}


def test_profile_text(spark):
    text = {"good": "# c\nfoo\n1024\n2\n3\n18446744073709551615\n\nbar\n5\n1\n7", "hash": "foo\nx\n1\n1", "none": "foo\n1\n0", "word": "foo\n1\n1\n1 x", "short": "foo\n1\n3\n1"}
    df = spark.createDataFrame([(f, i + 1, x) for f, t in text.items() for i, x in enumerate(t.split("\n"))], "file string, line_no bigint, line string")
    got = profiles.parse_profile_text(df, ["file"]).collect()
    assert sorted((r.fn, int(r.hash), r.pos, int(r.v)) for r in got if r.file == "good") == [("bar", 5, 1, 7), ("foo", 1024, 1, 3), ("foo", 1024, 2, 2**64 - 1)]
    assert {r.file: r.error for r in got if r.file != "good"} == {"hash": "bad hash", "none": "no counts", "word": "bad counter", "short": "wrong number of counters"}


def test_sample_text(spark):
    text = ["main:184019:0", " 4: 534", " 9.1: 2064 _Z3bar:1471 _Z3fooi:631", " -1: 5", " 3: x"]
    df = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file string, line_no int, line string")
    rows = profiles.parse_samples(df, ["file"])
    assert values(profiles.merge_samples(rows.unionByName(rows))) == [("main", 4, 0, 1068), ("main", 9, 1, 4128)]
    assert values(profiles.merge_calls(rows.unionByName(rows)).select("callee", "n")) == [("_Z3bar", 2942), ("_Z3fooi", 1262)]
    assert sorted(e for e in (r.error for r in rows.collect()) if e) == ["malformed line", "negative number"]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("wide", [True, False])
def test_raw_profiles(spark, tmp_path, order, wide):
    magic = int.from_bytes(bytes([255]) + b"lprof" + (b"r" if wide else b"R") + bytes([129]), "big")
    names, pointer = b"foobar", "Q" if wide else "I"
    raw = struct.pack(order + "7Q", magic, 1, 2, 3, len(names), 0x1000, 0x2000)
    raw += struct.pack(order + "IIQ" + pointer * 2, 3, 1, 123, 0x2000, 0x1000) + struct.pack(order + "IIQ" + pointer * 2, 3, 2, 2**64 - 1, 0x2003, 0x1008)
    (tmp_path / "p.raw").write_bytes(raw + struct.pack(order + "3Q", 19, 55, 65) + names)
    (tmp_path / "bad.raw").write_bytes(b"nonsense")
    got = {r.fn: (r.hash, r.counters, r.error) for r in readers.read_raw_profiles(spark, str(tmp_path)).collect()}
    assert got == {"foo": (123, [19], None), "bar": (2**64 - 1, [55, 65], None), None: (None, None, "bad magic")}


def test_coverage_report(spark):
    rows = [("f", "foo", True), ("f", "foo", False), ("f", "bar", True), ("f", "func", False), ("f", "main", True)]
    got = {(r.file, r.fn): (r.regions, r.missed, r.pct) for r in coverage.rollup(spark.createDataFrame(rows, "file string, fn string, covered boolean")).collect()}
    assert got[("f", "foo")] == (2, 1, 50.0) and got[("f", "func")] == (1, 1, 0.0) and got[(None, None)] == (5, 2, 60.0)
    one = spark.range(1)
    assert one.select(coverage.match_any([]), coverage.match_all([])).first()[:] == (False, True)
    assert one.select(coverage.summary_text(F.lit(32), F.lit(38), "x"), coverage.summary_text(F.lit(0), F.lit(0), "No branches")).first()[:] == ("84.21% of 38", "No branches")


def test_scalars(spark):
    items = F.array(*[F.lit(x) for x in (10, 20, 30, 4, 1, 1231, 20)])
    row = spark.range(1).select(
        fn.pick(items, fn.places("2-4,2,2,0-6")).alias("slice"), fn.bits(F.lit(0b1101), 2, 1).alias("bits"), fn.interval(F.lit(5), F.lit(3)).alias("i"), fn.key_hash(F.lit("foo")).alias("key"),
        fn.substitute(F.lit("RECURSE"), "RECURSE", "NORECURSE").alias("s"), fn.printable(F.lit("aé\n")).alias("shown"), fn.close(F.lit(1.0), F.lit(1.05), relative=0.1).alias("close"),
    ).first()
    assert row["slice"] == [30, 4, 1, 30, 30, 10, 20, 30, 4, 1, 1231, 20]
    assert (row["bits"], row["i"].lo, row["s"], row["shown"], row["close"]) == (2, -(2**63), "NORECURSE", "a\\xC3\\xA9\\x0A", True)
    import hashlib

    assert int(row["key"]) == int.from_bytes(hashlib.md5(b"foo").digest()[:8], "little")
    top = spark.createDataFrame([(2**64 - 1.0, 0.0)], "m double, w double")
    assert profiles.scale_weights(top, "w", F.col("m")).first().scaled == 1
    hashed = spark.createDataFrame([(bytearray(b"ab"),), (None,)], "b binary").select(fn.double_hash(F.col("b")).alias("h"))
    assert {r.h for r in hashed.collect()} == {f"{97 * 11 + 98}{(97 * 7) ^ 98}", None}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r.log").write_text("h1\nh2\nt1\tv1\t3\t57\nt2\tv2\t>4\t60\n")
    rows = values(readers.read_results(spark, str(tmp_path / "in")))
    assert rows == [("t1", "v1", "3", 57), ("t2", "v2", ">4", 60)]
    (tmp_path / "names").write_text("a\n\nb\na\n")
    assert values(readers.read_names(spark, str(tmp_path / "names"))) == [("a",), ("b",)]
    marked = spark.createDataFrame([("x <: y", True, True), ("z <: w", False, True)], "line string, explicit boolean, implicit boolean")
    sinks.write_constraint_sets(marked, str(tmp_path / "out"))
    assert [spark.read.text(str(tmp_path / "out" / k)).count() for k in ("explicit", "implicit")] == [1, 2]
    got = sinks.graph_json(nodes(spark, [1, 2]), edges(spark, [(1, 2)])).collect()
    assert sorted(r.line for r in got) == ['{"node":1,"to":[2]}', '{"node":2,"to":[]}']


def test_log(spark, tmp_path):
    """Truncated when made; a repeated batch counts once; a stream goes on where it stopped."""
    line = lambda *xs: spark.createDataFrame([(x,) for x in xs], "line string")
    at = str(tmp_path / "log")
    assert values(sinks.LogFolder(spark, at).lines()) == []
    sinks.LogFolder(spark, at).append(line("old"), 7)
    log = sinks.LogFolder(spark, at)
    log.append(line("a", "b", "a", None), 0)
    log.append(line("", "c"), 1)
    log.append(line("", "c"), 1)
    assert values(log.lines()) == [(0, "a"), (0, "a"), (0, "b"), (1, ""), (1, "c")]
    (tmp_path / "in").mkdir()
    for number in range(2):
        (tmp_path / "in" / f"{number}.txt").write_text(f"line {number}\n")
        log = sinks.LogFolder(spark, str(tmp_path / "streamed"), truncate=number == 0)
        log.follow(spark.readStream.schema("line string").text(str(tmp_path / "in")), str(tmp_path / "state")).awaitTermination()
    assert values(log.lines()) == [(0, "line 0"), (1, "line 1")]


def test_reports_by_kind_and_mediators(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    tainted = df([("a",), ("b",), ("c",)], "elem_id string")
    sites = df([(1, "a", True), (2, "a", False), (3, "b", False), (4, "x", False), (5, None, True), (6, "c", None)], "site int, elem_id string, pointer boolean")
    listed = df([("a", True), ("b", True), ("c", False), (None, True)], "elem_id string, pointer boolean")
    assert values(taint.report_by_kind(sites, tainted, listed).select("site")) == [(2,), (3,), (6,)]
    held = df([("f", "a"), ("f", "a"), ("f", "b"), ("g", "x"), (None, "a"), ("h", None)], "fn string, elem_id string")
    assert {tuple(r) for r in taint.mediators(held, tainted).collect()} == {(None, 1), ("f", 2)}
    casts = df([("f", 1, "A", "B"), ("f", 2, "A", "A"), ("f", 3, "void", "A"), ("g", 4, "B", "A"), ("g", 5, "A", None), ("f", 6, "C", "A")], "fn string, inst int, src string, dst string")
    embeds = df([("A", "C"), ("C", "B")], "outer string, first string")
    assert values(sets.wild_casts(casts, embeds).select("inst")) == [(1,), (4,)]


def test_overlap_join_counts_each_pair_once(spark):
    rng = random.Random(4)
    a, b = ([(i, lo := rng.randrange(100), lo + rng.randrange(0, 30)) for i in range(40)] for _ in range(2))
    left, right = spark.createDataFrame(a, "x int, a_lo int, a_hi int"), spark.createDataFrame(b, "y int, b_lo int, b_hi int")
    want = sorted((x, y) for x, p, q in a for y, r, s in b if p < q and r < s and p < s and r < q)
    assert values(joins.overlap_join(left, right, "a_lo", "a_hi", "b_lo", "b_hi", 7).select("x", "y")) == want


def test_overlap_join_of_very_long_ranges(spark):
    """One range of 2**40 and many short ones: cells grow with the range, rows do not."""
    rng = random.Random(7)
    a = [(i, lo, lo + rng.choice([1, 5, 90, 2**20, 2**40])) for i in range(60) for lo in [rng.randrange(-1000, 2**41)]] + [(60, 5, 5), (61, None, 3)]
    b = [(i, lo, lo + rng.choice([1, 7, 300, 2**30])) for i in range(60) for lo in [rng.randrange(-1000, 2**41)]] + [(60, 0, 100), (61, 20, 21)]
    left, right = spark.createDataFrame(a, "x int, a_lo bigint, a_hi bigint"), spark.createDataFrame(b, "y int, b_lo bigint, b_hi bigint")
    want = sorted((x, y) for x, p, q in a for y, r, s in b if p is not None and p < q and r < s and p < s and r < q)
    assert values(joins.overlap_join(left, right, "a_lo", "a_hi", "b_lo", "b_hi", 7).select("x", "y")) == want and want
