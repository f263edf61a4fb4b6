"""Queries over relational facts, sequences, profiles, coverage, sets and scalars."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import scalars as fn
from flowlens.operators import bitsets, coverage, faults, joins, profiles, sequences, sets
from flowlens.operators.fixpoint import shared_folder
from flowlens.plans import views
from flowlens.plans.registry import Tables, query, requires
from flowlens.plans.views import with_views
from flowlens.sources import readers, sinks

# --- sources, filters, joins ------------------------------------------------------------------------------


@query("""SELECT n_name AS module, c_custkey AS fn, o_orderkey AS block, count(*)::BIGINT AS n_insts FROM nation JOIN customer ON c_nationkey = n_nationkey
  JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R' GROUP BY ALL""")
def src_scan(t: Tables) -> DataFrame:
    """Module > function > block > instruction, without one kind of instruction."""
    insts = t.lineitem.where("l_returnflag <> 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_insts"))
    blocks = insts.join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")
    fns = blocks.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey").join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    return fns.select(F.col("n_name").alias("module"), F.col("o_custkey").alias("fn"), F.col("o_orderkey").alias("block"), "n_insts")


@query("""SELECT l_orderkey AS bb, min_by(l_partkey, l_linenumber * 100000000 + l_partkey) FILTER (WHERE l_discount > 0.02) AS first_loc,
  max_by(l_partkey, l_linenumber * 100000000 + l_partkey) AS last_loc FROM lineitem GROUP BY 1""")
def first_last(t: Tables) -> DataFrame:
    """First located instruction and last instruction of each block."""
    at = F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_partkey")
    located = F.when(F.col("l_discount") > 0.02, at)
    return t.lineitem.groupBy(F.col("l_orderkey").alias("bb")).agg(F.min_by("l_partkey", located).alias("first_loc"), F.max_by("l_partkey", at).alias("last_loc")).select(
        "bb", "first_loc", "last_loc"
    )


@query("""SELECT c_custkey AS fn_id FROM customer WHERE c_acctbal >= 0 AND c_name <> 'main' AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1-%')""")
def exists_filter(t: Tables) -> DataFrame:
    """Defined functions other than main with a parameter of one type, each once."""
    params = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("params"))
    fns = t.customer.where("c_acctbal >= 0 AND c_name <> 'main'").join(params, "c_custkey")
    return fns.where(F.exists("params", lambda p: p.like("1-%"))).select(F.col("c_custkey").alias("fn_id"))


@query("""SELECT l_partkey AS sym, CASE WHEN t AND NOT f THEN false WHEN NOT t AND f THEN true END AS is_null FROM
  (SELECT l_partkey, bool_or(l_quantity > 45) AS t, bool_or(l_quantity < 5) AS f FROM lineitem GROUP BY 1)""")
def ternary(t: Tables) -> DataFrame:
    flags = t.lineitem.groupBy(F.col("l_partkey").alias("sym")).agg(F.bool_or(F.col("l_quantity") > 45).alias("t"), F.bool_or(F.col("l_quantity") < 5).alias("f"))
    return flags.select("sym", joins.ternary(F.col("t"), F.col("f")).alias("is_null"))


@query("SELECT event_type AS node, count(DISTINCT user_id)::BIGINT AS n_users FROM events GROUP BY 1")
def distinct_count(t: Tables) -> DataFrame:
    return t.events.groupBy(F.col("event_type").alias("node")).agg(F.count_distinct("user_id").alias("n_users"))


@query("SELECT count(*) FILTER (WHERE event_type <> 'error')::BIGINT AS safe, count(*)::BIGINT AS total FROM events")
def count_if(t: Tables) -> DataFrame:
    return t.events.agg(F.count_if(F.col("event_type") != "error").alias("safe"), F.count("*").alias("total"))


@query(with_views("trade", "SELECT src, dst, a.n_name AS src_name, b.n_name AS dst_name FROM trade JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey"))
@requires("trade")
def join_inner(t: Tables) -> DataFrame:
    names = t.nation.select(F.col("n_nationkey").cast("bigint").alias("k"), "n_name")
    out = views.trade(t).join(names.select(F.col("k").alias("src"), F.col("n_name").alias("src_name")), "src").join(names.select(F.col("k").alias("dst"), F.col("n_name").alias("dst_name")), "dst")
    return out.select("src", "dst", "src_name", "dst_name")


@query("SELECT c_custkey, coalesce(n, 0)::BIGINT AS block_order FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def join_left_default(t: Tables) -> DataFrame:
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("block_order"))
    return joins.left_default(t.customer.select("c_custkey"), counts, ["c_custkey"], "block_order", 0)


_SIDES = "SELECT l_partkey AS k, count(*)::BIGINT AS v FROM lineitem WHERE year(l_shipdate) = {} AND l_quantity >= 40 GROUP BY 1"


@query(f"""SELECT coalesce(a.k, b.k) AS k, a.v AS left_value, b.v AS right_value, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' WHEN a.v = b.v THEN 'match' ELSE 'changed' END AS kind
  FROM ({_SIDES.format(1995)}) a FULL JOIN ({_SIDES.format(1996)}) b ON a.k = b.k""")
def full_diff(t: Tables) -> DataFrame:
    side = lambda y: t.lineitem.where((F.year("l_shipdate") == y) & (F.col("l_quantity") >= 40)).groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("v"))
    return joins.full_diff(side(1995), side(1996), ["k"], "v")


@query("""SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW')""")
def semi_anti(t: Tables) -> DataFrame:
    """Exported functions that are not on a block list."""
    key = F.col("o_custkey").alias("c_custkey")
    return t.customer.select("c_custkey").join(t.orders.where("o_orderstatus = 'F'").select(key), "c_custkey", "left_semi").join(t.orders.where("o_orderpriority = '5-LOW'").select(key), "c_custkey", "left_anti")


@query(with_views("tev", "SELECT a.run, a.seq AS test_id, a.node AS output, b.node AS trace FROM tev a JOIN tev b ON a.run = b.run AND a.seq = b.seq + 1"))
def offset_join(t: Tables) -> DataFrame:
    """Output N goes with trace N - 1."""
    e = views.tev(t)
    before = e.select("run", (F.col("seq") + 1).alias("test_id"), F.col("node").alias("trace"))
    return e.select("run", F.col("seq").alias("test_id"), F.col("node").alias("output")).join(before, ["run", "test_id"])


@query("""SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal - 50 < c_acctbal + 50 AND c_acctbal - 50 < s_acctbal + 50""")
def range_join(t: Tables) -> DataFrame:
    """Byte ranges that overlap within one location."""
    s = t.supplier.select("s_suppkey", F.col("s_nationkey").alias("loc"), (F.col("s_acctbal") - 50).alias("a_lo"), (F.col("s_acctbal") + 50).alias("a_hi"))
    c = t.customer.select("c_custkey", F.col("c_nationkey").alias("loc"), (F.col("c_acctbal") - 50).alias("b_lo"), (F.col("c_acctbal") + 50).alias("b_hi"))
    return joins.overlap_join(s, c, "a_lo", "a_hi", "b_lo", "b_hi", 100, ["loc"]).select("s_suppkey", "c_custkey")


@query("SELECT r_regionkey AS i, a::BIGINT AS j, b::BIGINT AS k FROM region, (SELECT unnest([0, 1, 2]) AS a), (SELECT unnest([10, 20]) AS b)")
def cross_product(t: Tables) -> DataFrame:
    """Nested loops over short ranges: each row grows by a constant factor."""
    return t.region.select(F.col("r_regionkey").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("j")).select("i", F.col("j").cast("bigint").alias("j"), F.explode(F.array(F.lit(10), F.lit(20))).alias("k")).select(
        "i", "j", F.col("k").cast("bigint").alias("k")
    )


@query("""SELECT coalesce(p.p_partkey // 7, l_partkey)::BIGINT AS target, count(*)::BIGINT AS uses FROM lineitem LEFT JOIN part p ON p.p_partkey = l_partkey AND p.p_partkey % 7 = 0 AND p.p_size < 25 GROUP BY 1""")
def alias_resolve(t: Tables) -> DataFrame:
    aliases = t.part.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("alias"), F.expr("p_partkey div 7").alias("target"), (F.col("p_size") < 25).alias("internal"))
    return joins.resolve_aliases(t.lineitem.select(F.col("l_partkey").alias("name")), aliases)


@query("""SELECT n_nationkey::BIGINT AS site, s_suppkey AS fn, 'IND_CALL' AS etype FROM nation JOIN supplier ON s_nationkey % 5 = n_regionkey AND s_acctbal > 0
  UNION ALL SELECT s_nationkey::BIGINT, s_suppkey, 'CALL' FROM supplier""")
def indirect_call(t: Tables) -> DataFrame:
    sites = t.nation.select(F.col("n_nationkey").cast("bigint").alias("site"), F.col("n_regionkey").alias("signature"))
    fns = t.supplier.select(F.col("s_suppkey").alias("fn"), (F.col("s_nationkey") % 5).alias("signature"), (F.col("s_acctbal") > 0).alias("address_taken"))
    direct = t.supplier.select(F.col("s_nationkey").cast("bigint").alias("site"), F.col("s_suppkey").alias("fn"), F.lit("CALL").alias("etype"))
    return joins.indirect_calls(sites, fns).unionByName(direct)


# --- sequences ------------------------------------------------------------------------------------------------

_SECTION = "CASE (length(line) // 5) % 4 WHEN 0 THEN 'default:' WHEN 1 THEN 'implicit:' WHEN 2 THEN 'source-sink:' ELSE 'other:' END"


@query(with_views("lines", f""", c AS (SELECT doc_id, line_no, CASE WHEN length(line) % 5 = 0 THEN {_SECTION} ELSE line || ' <: x' END AS line FROM lines),
  s AS (SELECT *, last_value(CASE WHEN line IN ('default:', 'implicit:', 'source-sink:') THEN rtrim(line, ':') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS section FROM c)
  SELECT doc_id, line_no, section, section <> 'implicit' AS explicit, true AS implicit FROM s WHERE line LIKE '%<:%' AND section IS NOT NULL"""))  # fmt: skip
def section_fill(t: Tables) -> DataFrame:
    """Constraint lines by section; headers stand where a line's length is a multiple of five."""
    kind = F.expr("CASE (length(line) div 5) % 4 WHEN 0 THEN 'default:' WHEN 1 THEN 'implicit:' WHEN 2 THEN 'source-sink:' ELSE 'other:' END")
    text = views.lines(t).withColumn("line", F.when(F.length("line") % 5 == 0, kind).otherwise(F.concat("line", F.lit(" <: x"))))
    return sequences.sections(text, ["doc_id"]).select("doc_id", "line_no", "section", "explicit", "implicit")


@query("""SELECT user_id, event_id, macro || ':' || event_id AS entry FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS macro FROM events)
  WHERE event_type = 'click' AND value > 1 AND macro IS NOT NULL""")
def macro_fill(t: Tables) -> DataFrame:
    """Range lines with the macro name last met before them."""
    out = sequences.carry_forward(t.events, F.when(F.col("event_type") == "signup", F.col("event_id")), ["user_id"], ["ts", "event_id"], "macro")
    return out.where("event_type = 'click' AND value > 1 AND macro IS NOT NULL").select("user_id", "event_id", F.concat_ws(":", "macro", "event_id").alias("entry"))


@query(with_views("lines", """, m AS (SELECT *, length(line) % 2 = 0 AS m, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM lines),
  r AS (SELECT *, coalesce(max(CASE WHEN NOT m THEN n END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM m)
  SELECT doc_id, line_no FROM r WHERE NOT m AND (n - 1 - l) % 2 = 0"""))
def skip_pair(t: Tables) -> DataFrame:
    return sequences.skip_pairs(views.lines(t), F.length("line") % 2 == 0, ["doc_id"]).select("doc_id", "line_no")


@query(with_views("tev", """, f AS (SELECT *, min(seq) OVER (PARTITION BY run, node) AS first FROM tev) SELECT run, seq, (dense_rank() OVER (PARTITION BY run ORDER BY first) - 1)::BIGINT AS node_id FROM f"""))
def dict_encode(t: Tables) -> DataFrame:
    return sequences.first_seen_ids(views.tev(t), "node", ["run"], ["seq"], "node_id").select("run", "seq", "node_id")


@query("""SELECT event_id, sum(CASE event_type WHEN 'view' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS level FROM events""")
def nest_level(t: Tables) -> DataFrame:
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "purchase", -1).otherwise(0)
    return sequences.nesting(t.events, step, ["user_id"], ["ts", "event_id"]).select("event_id", "level")


@query("""SELECT user_id, event_id, event_type AS exit_line, trace_line FROM (SELECT *, row_number() OVER w AS n, lead(event_type) OVER w AS trace_line FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n % 2 = 1 AND trace_line IS NOT NULL""")
def trace_pair(t: Tables) -> DataFrame:
    return sequences.pair_with_next(t.events, ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", F.col("event_type").alias("exit_line"), F.col("next_value").alias("trace_line"))


@query(with_views("lines", ", p AS (SELECT doc_id, line_no, string_split(line, ',') AS a FROM lines) SELECT doc_id, line_no, (generate_subscripts(a, 1) - 1)::BIGINT AS seq, length(unnest(a))::BIGINT AS node_id FROM p"))
def trace_explode(t: Tables) -> DataFrame:
    """Comma-separated id streams as rows."""
    out = views.lines(t).select("doc_id", "line_no", F.posexplode(F.split("line", ",")).alias("seq", "token"))
    return out.select("doc_id", "line_no", F.col("seq").cast("bigint").alias("seq"), F.length("token").cast("bigint").alias("node_id"))


@query(with_views("tev", "SELECT run, seq, src, dst FROM (SELECT run, seq, node AS src, lead(node) OVER (PARTITION BY run ORDER BY seq) AS dst FROM tev) WHERE dst IS NOT NULL"))
def trace_edges(t: Tables) -> DataFrame:
    return sequences.trace_edges(views.tev(t), ["run"], ["seq"], "node").select("run", "seq", "src", "dst")


@query(with_views("tev", "SELECT run, src, dst, count(*)::BIGINT AS n FROM (SELECT run, node AS src, lead(node) OVER (PARTITION BY run ORDER BY seq) AS dst FROM tev) WHERE dst IS NOT NULL GROUP BY ALL"))
def trace_compact(t: Tables) -> DataFrame:
    return sequences.compact_trace(views.tev(t), ["run"], ["seq"], "node")


@query("""SELECT p_size::BIGINT AS version, p_partkey AS line_no FROM part UNION ALL SELECT p_size::BIGINT, -1 FROM part GROUP BY 1""")
def explode_list(t: Tables) -> DataFrame:
    """A fault map written as ``{v: (l,...,)}`` lines of at most 4,096 keys and one ``{v: (-1,)}`` for each version, and read again."""
    parts = t.part.select("p_size", "p_partkey")
    text = parts.groupBy("p_size", F.floor(F.col("p_partkey") / 4096)).agg(F.concat_ws("", F.transform(F.array_sort(F.collect_list("p_partkey")), lambda x: F.concat(x.cast("string"), F.lit(",")))).alias("l"))
    text = text.select("p_size", "l").union(parts.select("p_size", F.lit("-1,")).distinct())
    return readers.read_fault_map(text.select(F.format_string("{%d: (%s)}", "p_size", "l").alias("line")))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'SCG' WHEN 'view' THEN 'UB' ELSE 'TB' END AS tag FROM events WHERE event_type IN ('click', 'view', 'error')""")
def tag_filter(t: Tables) -> DataFrame:
    """Lines that begin with one of three tags and a bar."""
    tag = F.when(F.col("event_type") == "click", "SCG").when(F.col("event_type") == "view", "UB").when(F.col("event_type") == "error", "TB").otherwise("x[UB")
    text = t.events.select("event_id", F.concat(F.lit("["), tag, F.lit("]|"), F.col("props")).alias("line"))
    return text.where(F.col("line").rlike(r"^\[(SCG|UB|TB)\]\|")).select("event_id", F.regexp_extract("line", r"^\[(\w+)", 1).alias("tag"))


@query("""SELECT page_id, string_split(string_split(url, '://')[2], '/')[1] AS host, string_split(string_split(url, '?')[1], '#')[1] AS clean FROM pages""")
def str_split(t: Tables) -> DataFrame:
    """Fields by nested splits."""
    return t.pages.select("page_id", F.split(F.split("url", "://")[1], "/")[0].alias("host"), F.split(F.split("url", r"\?")[0], "#")[0].alias("clean"))


# --- profiles -----------------------------------------------------------------------------------------------


def _profile_text(t: Tables) -> DataFrame:
    """Text profiles, one file for each function: name, hash, count, counters and a blank line for each record."""
    p = views.prof(t)
    head = p.groupBy("fn", "hash").agg(F.count("*").alias("n"))
    rows = [head.select("fn", "hash", F.lit(0).alias("o"), F.concat(F.lit("# "), "fn").alias("line")), head.select("fn", "hash", F.lit(1), "fn"), head.select("fn", "hash", F.lit(2), F.col("hash").cast("string")), head.select("fn", "hash", F.lit(3), F.col("n").cast("string"))]
    rows += [p.select("fn", "hash", (F.col("pos") + 3).cast("int"), F.col("v").cast("string")), head.select("fn", "hash", F.lit(1000), F.lit(""))]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    w = Window.partitionBy("file").orderBy("hash", "o")
    return out.select(F.col("fn").alias("file"), "hash", "o", "line").select("file", F.row_number().over(w).cast("bigint").alias("line_no"), "line")


@query(with_views("prof", "SELECT fn, hash::DECIMAL(20, 0) AS hash, row_number() OVER (PARTITION BY fn, hash ORDER BY pos)::BIGINT AS pos, v::DECIMAL(20, 0) AS v FROM prof"))
def prof_parse(t: Tables) -> DataFrame:
    return profiles.parse_profile_text(_profile_text(t), ["file"]).where("error IS NULL").select("fn", "hash", "pos", "v")


_TWO = """, two AS (SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'a' ELSE 'b' END AS input, l_returnflag || l_linestatus AS fn, year(l_shipdate) AS hash, l_linenumber AS pos, count(*) AS v FROM lineitem
  WHERE NOT (l_orderkey % 2 = 1 AND l_linenumber = 7 AND year(l_shipdate) = 1995) GROUP BY ALL)"""


def _two_profiles(t: Tables) -> DataFrame:
    li = t.lineitem.where("NOT (l_orderkey % 2 = 1 AND l_linenumber = 7 AND year(l_shipdate) = 1995)")
    side = F.when(F.col("l_orderkey") % 2 == 0, "a").otherwise("b")
    out = li.groupBy(side.alias("input"), F.concat("l_returnflag", "l_linestatus").alias("fn"), F.year("l_shipdate").alias("hash"), F.col("l_linenumber").alias("pos")).agg(F.count("*").cast("decimal(20,0)").alias("v"))
    return out.withColumn("hash", F.col("hash").cast("bigint")).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"""WITH x AS (SELECT 1){_TWO}, n AS (SELECT *, count(*) OVER (PARTITION BY input, fn, hash) AS len FROM two), f AS (SELECT *, min_by(len, input) OVER (PARTITION BY fn, hash) AS first_len FROM n)
  SELECT fn, hash::BIGINT AS hash, pos::BIGINT AS pos, sum(v)::DECIMAL(38, 0) AS v FROM f WHERE len = first_len GROUP BY ALL""")
def prof_merge(t: Tables) -> DataFrame:
    return profiles.merge_counters(_two_profiles(t)).select("fn", "hash", "pos", "v")


@query(with_views("prof", """, s AS (SELECT fn, pos, sum(v::DECIMAL(38, 0) * 144115188075855872) AS s FROM prof GROUP BY 1, 2)
  SELECT fn, pos, CASE WHEN s <= 18446744073709551615 THEN s END::DECIMAL(38, 0) AS v, CASE WHEN s > 18446744073709551615 THEN 'counter overflow' END AS error FROM s"""))
def prof_overflow(t: Tables) -> DataFrame:
    """Sums beyond an unsigned 64-bit number are errors of their counter."""
    big = F.col("v").cast("decimal(10,0)") * F.lit(144115188075855872).cast("decimal(20,0)")
    rows = views.prof(t).select(F.lit("a").alias("input"), "fn", F.lit(0).alias("hash"), "pos", big.cast("decimal(38,0)").alias("v"))
    return profiles.merge_counters(rows).select("fn", "pos", "v", "error")


@query(with_views("prof", """SELECT fn, hash, max(CASE WHEN pos = 1 THEN v END)::BIGINT AS function_count, sum(CASE WHEN pos > 1 THEN v END)::BIGINT AS block_sum, max(CASE WHEN pos > 1 THEN v END)::BIGINT AS block_max FROM prof GROUP BY 1, 2"""))
def prof_summary(t: Tables) -> DataFrame:
    return profiles.summarise(views.prof(t))


def _sample_text(t: Tables) -> DataFrame:
    p = views.prof(t)
    head = p.groupBy("fn").agg(F.sum("v").alias("total"), F.max("v").alias("top")).select(F.col("fn").alias("file"), F.lit(0).cast("bigint").alias("line_no"), F.concat_ws(":", "fn", "total", "top").alias("line"))
    body = p.select(F.col("fn").alias("file"), (F.col("hash") * 10 + F.col("pos")).alias("line_no"), F.format_string(" %d.%d: %d callee%d:%d", "pos", "hash", "v", "pos", F.col("v") * 2).alias("line"))
    return head.unionByName(body)


@query(with_views("prof", ", h AS (SELECT fn, sum(v)::BIGINT AS total, max(v)::BIGINT AS head FROM prof GROUP BY 1) SELECT fn, total, head, pos AS line, hash AS disc, v AS n FROM prof JOIN h USING (fn)"))
def samp_parse(t: Tables) -> DataFrame:
    return profiles.parse_samples(_sample_text(t), ["file"]).where("error IS NULL").select("fn", "total", "head", "line", "disc", "n")


@query(with_views("prof", "SELECT fn, pos AS line, hash AS disc, 'callee' || pos AS callee, (4 * v)::BIGINT AS n FROM prof"))
def samp_merge(t: Tables) -> DataFrame:
    """Merging a profile with itself doubles it (calls are twice the samples here)."""
    once = profiles.parse_samples(_sample_text(t), ["file"])
    return profiles.merge_calls(once.unionByName(once))


@query(with_views("prof", """, h AS (SELECT fn, sum(v)::BIGINT AS total, max(v)::BIGINT AS head FROM prof GROUP BY 1)
  SELECT encoding, fn, total, head, pos AS line, hash AS disc, v AS n FROM prof JOIN h USING (fn), (VALUES ('text'), ('columns')) e(encoding)"""))
def samp_file(t: Tables) -> DataFrame:
    """Sample profiles written as text, a file for each function, and as columns, and read again."""
    text, columns = _file(t, "samples"), _file(t, "samples")
    lines = _sample_text(t).withColumnRenamed("file", "fn").repartition("fn").sortWithinPartitions("fn", "line_no")
    lines.select("fn", F.col("line").alias("value")).write.partitionBy("fn").text(text)
    found = profiles.parse_samples(readers.read_lines(t.spark, f"{text}/*"), ["file"]).where("error IS NULL")
    sinks.write_profile(found.select("fn", "total", "head", "line", "disc", "n"), columns)
    kept = t.spark.read.parquet(columns).withColumn("encoding", F.lit("columns"))
    return found.select(F.lit("text").alias("encoding"), "fn", "total", "head", "line", "disc", "n").unionByName(kept)


# --- coverage and faults --------------------------------------------------------------------------------------


@query(with_views("cov", """, s AS (SELECT file, fn, count(*)::BIGINT AS regions, count(*) FILTER (WHERE covered)::BIGINT AS hit FROM cov GROUP BY 1, 2)
  SELECT file, fn, regions, hit FROM s WHERE (contains(fn, 'BRASS') OR regexp_matches(fn, '^(ECONOMY|PROMO)')) AND hit * 100 < regions * 50"""))
def cov_filter(t: Tables) -> DataFrame:
    """Filters joined by OR inside a list joined by AND."""
    s = views.cov(t).groupBy("file", "fn").agg(F.count("*").alias("regions"), F.count_if("covered").alias("hit"))
    named = coverage.match_any([coverage.name_contains("BRASS"), coverage.name_matches("^(ECONOMY|PROMO)")])
    return s.where(coverage.match_all([named, coverage.percent_below(F.col("hit"), F.col("regions"), 50)]))


@query(with_views("cov", """SELECT file, fn, grouping(file, fn)::BIGINT AS level, count(*)::BIGINT AS regions, count(*) FILTER (WHERE NOT covered)::BIGINT AS missed,
  count(*) FILTER (WHERE covered) * 100.0::DOUBLE / count(*) AS pct FROM cov GROUP BY ROLLUP (file, fn)"""))
def cov_rollup(t: Tables) -> DataFrame:
    return coverage.rollup(views.cov(t))


@query(with_views("cov", """, s AS (SELECT file, count(*) FILTER (WHERE covered) AS hit, count(*) AS n FROM cov GROUP BY 1) SELECT file, CASE WHEN n > 0 THEN format('{:.2f}% of {}', hit * 100.0::DOUBLE / n, n) ELSE 'No executable lines' END AS summary FROM s"""))
def cov_summary(t: Tables) -> DataFrame:
    s = views.cov(t).groupBy("file").agg(F.count_if("covered").alias("hit"), F.count("*").alias("n"))
    return s.select("file", coverage.summary_text(F.col("hit"), F.col("n"), "No executable lines").alias("summary"))


@query(with_views("cov", "SELECT count(*)::BIGINT AS blocks, count(*) FILTER (WHERE covered)::BIGINT AS visited, count(*) FILTER (WHERE covered) * 100.0::DOUBLE / count(*) AS pct FROM cov"))
def reach_pct(t: Tables) -> DataFrame:
    out = views.cov(t).agg(F.count("*").alias("blocks"), F.count_if("covered").alias("visited"))
    return out.withColumn("pct", coverage.percent(F.col("visited"), F.col("blocks")))


@query("SELECT o_orderkey, (floor(w / (floor(m / 4294967295.0) + 1)) + 1)::BIGINT AS scaled FROM (SELECT o_orderkey, o_orderkey::DOUBLE * 1000000 AS w, max(o_orderkey::DOUBLE * 1000000) OVER () AS m FROM orders)")
def weight_scale(t: Tables) -> DataFrame:
    w = t.orders.select("o_orderkey", (F.col("o_orderkey").cast("double") * 1000000).alias("w"))
    top = w.agg(F.max("w").alias("m"))
    return profiles.scale_weights(w.crossJoin(F.broadcast(top)), "w", F.col("m")).select("o_orderkey", "scaled")


@query("""SELECT p_partkey, (('0x' || array_to_string([substr(md5(p_name), 15 - 2 * i, 2) FOR i IN range(8)], ''))::UBIGINT)::DECIMAL(20, 0) AS key FROM part""")
def md5_key(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fn.key_hash(F.col("p_name")).alias("key"))


_SPECTRUM = """, runs AS (SELECT run, bool_or(failed) AS failed FROM tev GROUP BY 1), hits AS (SELECT DISTINCT run, node FROM tev WHERE node <> 'error'),
  tot AS (SELECT count(*) FILTER (WHERE failed) AS tf FROM runs),
  sp AS (SELECT node, count(*) FILTER (WHERE failed) AS ef, count(*) FILTER (WHERE NOT failed) AS ep FROM hits JOIN runs USING (run) GROUP BY 1),
  sc AS (SELECT node, ef / sqrt(tf * (ef + ep)) AS score FROM sp, tot)"""


@query(with_views("tev", _SPECTRUM + " SELECT node, score, rank() OVER (ORDER BY score DESC)::BIGINT AS rank FROM sc"))
def fault_rank(t: Tables) -> DataFrame:
    e = views.tev(t)
    spectrum = faults.spectra(e.where("node <> 'error'"), e.select("run", "failed").distinct())
    return faults.rank_nodes(faults.scores(spectrum)).select("node", "score", "rank")


@query("""WITH r AS (SELECT p_size AS rank, p_size % 10 = 0 AS lost, p_size + 7 AS total FROM part), n AS (SELECT rank, count(*) AS n FROM r WHERE NOT lost GROUP BY 1)
  SELECT rank / (SELECT max(total) FROM r)::DOUBLE AS x, sum(n) OVER (ORDER BY rank)::DOUBLE / (sum(n) OVER ()) AS y FROM n""")
def fault_cdf(t: Tables) -> DataFrame:
    raw = F.when(F.col("p_size") % 10 == 0, F.concat(F.lit(">"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string"))
    return faults.rank_curve(t.part.select(raw.alias("rank_raw"), (F.col("p_size") + 7).alias("total")))


# --- sets -----------------------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier UNION SELECT n_regionkey FROM nation")
def set_union(t: Tables) -> DataFrame:
    return sets.union_all_distinct(t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select(F.col("s_nationkey").alias("k")), t.nation.select(F.col("n_regionkey").alias("k")))


@query("""SELECT key, min_by(value, src * 1000000 + value) AS value FROM (SELECT s_nationkey AS key, s_suppkey AS value, 0 AS src FROM supplier UNION ALL SELECT c_nationkey, c_custkey, 1 FROM customer) GROUP BY 1""")
def map_merge_first(t: Tables) -> DataFrame:
    return sets.merge_first(t.supplier.select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("value")), t.customer.select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("value")))


@query("SELECT l_partkey AS field FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'N'")
def shared_fields(t: Tables) -> DataFrame:
    """Fields that both domains access."""
    side = lambda f: t.lineitem.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("field"))
    return side("R").intersect(side("N"))


@query("""SELECT l_orderkey, l_linenumber, 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem l
  WHERE l_suppkey <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem e WHERE e.l_quantity >= 45 AND e.l_partkey = l.l_partkey AND e.l_suppkey = l.l_suppkey)""")
def wild_casts(t: Tables) -> DataFrame:
    """Casts from a part to a supplier, where a large lot says that the part begins with that supplier; one supplier is untyped."""
    part, supplier = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    casts = t.lineitem.select("l_orderkey", "l_linenumber", part.alias("src"), supplier.alias("dst"))
    return sets.wild_casts(casts, t.lineitem.where("l_quantity >= 45").select(part.alias("outer"), supplier.alias("first")), ("s0",))


@query("""WITH s AS (SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS members FROM orders GROUP BY 1) SELECT o_custkey, members, dense_rank() OVER (ORDER BY members)::BIGINT AS set_id FROM s""")
def set_intern(t: Tables) -> DataFrame:
    return sets.intern(t.orders, "o_custkey", "o_orderpriority").select("o_custkey", F.array_join("members", ",").alias("members"), "set_id")


@query("SELECT l_suppkey, count(DISTINCT l_partkey)::BIGINT AS n FROM lineitem GROUP BY 1")
def bitset(t: Tables) -> DataFrame:
    return sets.bit_counts(t.lineitem, "l_suppkey", "l_partkey")


@query("""WITH s AS (SELECT l_suppkey AS owner, l_partkey AS item, bool_or(l_returnflag = 'R') AS a, bool_or(l_returnflag = 'A') AS b FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
  SELECT owner, count(*)::BIGINT AS n_union, count(*) FILTER (WHERE a AND b)::BIGINT AS n_both, count(*) FILTER (WHERE a AND NOT b)::BIGINT AS n_left, count(*) FILTER (WHERE b AND NOT a)::BIGINT AS n_new, sum(CASE WHEN b AND NOT a THEN item END)::BIGINT AS new_items FROM s GROUP BY 1""")
def bitset_ops(t: Tables) -> DataFrame:
    """Sets of the parts that each supplier saw returned and accepted: united, met, reset, and tested while set."""
    a, b = F.col("a"), F.col("b")
    sets = bitsets.side_by_side(t.lineitem, "l_suppkey", "l_partkey", a=F.col("l_returnflag") == "R", b=F.col("l_returnflag") == "A")
    new = b.bitwiseAND(F.bitwise_not(a))
    counted = {"n_union": a.bitwiseOR(b), "n_both": a.bitwiseAND(b), "n_left": a.bitwiseAND(F.bitwise_not(b)), "n_new": new}
    sums = [F.sum(F.bit_count(bits)).cast("bigint").alias(name) for name, bits in counted.items()]
    return sets.groupBy("owner").agg(*sums, F.sum(bitsets.total(F.col("word"), new)).alias("new_items"))


@query("""SELECT o_custkey, max(o_orderkey) AS top_key, max_by(o_orderpriority, o_orderkey) AS top_value, min_by(o_orderstatus, o_orderkey) AS added FROM orders GROUP BY 1""")
def map_ops(t: Tables) -> DataFrame:
    """Persistent maps: adding, looking up, the largest element."""
    entries = t.orders.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("m"), F.min("o_orderkey").alias("low"), F.min_by("o_orderstatus", "o_orderkey").alias("s"))
    out = entries.withColumn("top_key", F.array_max(F.map_keys("m"))).withColumn("more", F.map_concat(F.transform_keys("m", lambda k, _: k), F.create_map(-F.col("low") - 1, F.col("s"))))
    return out.select("o_custkey", "top_key", F.element_at("m", F.col("top_key")).alias("top_value"), F.element_at("more", -F.col("low") - 1).alias("added"))


@query(with_views("tev", "SELECT run, min(seq)::BIGINT AS first_bad FROM tev WHERE node = 'error' GROUP BY 1"))
def bisect_min(t: Tables) -> DataFrame:
    return sets.first_failure(views.tev(t).withColumn("bad", F.col("node") == "error"), "seq", "bad", ["run"])


@query("""SELECT n_nationkey, coalesce(CASE WHEN n_nationkey % 3 = 0 THEN 'let ' || n_name END, CASE WHEN n_nationkey % 2 = 0 THEN n_name END, r_name) AS name FROM nation JOIN region ON n_regionkey = r_regionkey""")
def coalesce_override(t: Tables) -> DataFrame:
    """Fields through three levels of inheritance; the last that sets one wins."""
    n = t.nation.join(t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey")
    mine, let = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("let "), "n_name"))
    return n.select("n_nationkey", fn.override(F.col("r_name"), mine, let).alias("name"))


# --- scalars --------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, (p_size + 1024)::BIGINT AS added, (p_size << 3)::BIGINT AS shl, (p_partkey >> 1)::BIGINT AS srl, (p_size & 6)::BIGINT AS anded FROM part")
def scalar_math(t: Tables) -> DataFrame:
    size, key = F.col("p_size").cast("bigint"), F.col("p_partkey")
    return t.part.select("p_partkey", (size + 1024).alias("added"), fn.shift_left(size, 3).alias("shl"), fn.shift_right_unsigned(key, 1).alias("srl"), size.bitwiseAND(F.lit(6).cast("bigint")).alias("anded"))


@query("SELECT p_partkey, CASE WHEN p_size = 10 THEN 'ten' WHEN p_brand = 'Brand#11' THEN 'brand' ELSE 'other' END AS pick FROM part")
def scalar_if(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(F.col("p_size") == 10, "ten").when(F.col("p_brand") == "Brand#11", "brand").otherwise("other").alias("pick"))


@query("SELECT p_partkey, p_brand || ':' || p_type || '#' || p_size AS pasted FROM part")
def str_concat(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat("p_brand", F.lit(":"), "p_type", F.lit("#"), F.col("p_size").cast("string")).alias("pasted"))


@query("SELECT p_partkey, replace(p_type, 'S', 'RSE') AS replaced FROM part")
def str_subst(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fn.substitute(F.col("p_type"), "S", "RSE").alias("replaced"))


@query("""WITH w AS (SELECT p_partkey, string_split(p_type, ' ') AS a, string_split(p_name, ' ') AS b FROM part) SELECT p_partkey, a[1] AS first, array_to_string(a[2:], ' ') AS rest, len(b) = 0 AS nothing,
  array_to_string(list_concat(a, b), '|') AS joined, array_to_string([a[3], a[2], a[1], a[1]], '-') AS slice, array_to_string([x || '!' FOR x IN a], ' ') AS mapped FROM w""")
def list_ops(t: Tables) -> DataFrame:
    a, b = F.split("p_type", " "), F.split("p_name", " ")
    return t.part.select(
        "p_partkey", fn.head(a).alias("first"), F.array_join(fn.tail(a), " ").alias("rest"), fn.is_empty(b).alias("nothing"), F.array_join(F.concat(a, b), "|").alias("joined"),
        F.array_join(fn.pick(a, fn.places("2-0,0")), "-").alias("slice"), F.array_join(F.transform(a, lambda x: F.concat(x, F.lit("!"))), " ").alias("mapped"),
    )


@query("SELECT p_partkey, ((p_partkey >> 3) & 1)::BIGINT AS one, ((p_partkey >> 1) & 7)::BIGINT AS field FROM part")
def bit_slice(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", fn.bit(F.col("p_partkey"), 3).alias("one"), fn.bits(F.col("p_partkey"), 3, 1).alias("field"))


@query("SELECT r_regionkey, unnest(range(0, r_regionkey + 1))::BIGINT AS i FROM region")
def seq_gen(t: Tables) -> DataFrame:
    return t.region.select("r_regionkey", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("r_regionkey").cast("bigint"))).alias("i"))


@query("""SELECT o_orderkey, CASE WHEN o_custkey <= o_orderkey THEN o_custkey ELSE -9223372036854775808 END::BIGINT AS lo, CASE WHEN o_custkey <= o_orderkey THEN o_orderkey ELSE -9223372036854775808 END::BIGINT AS hi FROM orders""")
def interval_norm(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", fn.interval(F.col("o_custkey"), F.col("o_orderkey")).alias("i")).select("o_orderkey", "i.lo", "i.hi")


@query("""SELECT item_id, array_to_string([CASE WHEN h BETWEEN '20' AND '7E' THEN chr(('0x' || h)::INT) ELSE '\\x' || h END FOR h IN regexp_extract_all(hex(encode(text)), '..')], '') AS shown FROM benchmark""")
def hex_render(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", fn.printable(F.col("text")).alias("shown"))


@query("SELECT event_id, json_extract_string(props, '$.device') AS device, len(json_keys(props))::BIGINT AS n_keys FROM events")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.device").alias("device"), F.size(F.json_object_keys("props")).cast("bigint").alias("n_keys"))


@query("""SELECT 'f' || l_suppkey AS fn, 'rpc f' || l_suppkey || '(' || array_to_string(list_sort(list(DISTINCT l_linenumber || ':' || CASE WHEN l_returnflag = 'R' THEN 'READ' ELSE 'WRITE' END)), ',') || ')' AS policy FROM lineitem GROUP BY l_suppkey""")
def policy_text(t: Tables) -> DataFrame:
    access = F.when(F.col("l_returnflag") == "R", "READ").otherwise("WRITE")
    return sinks.policy_lines(t.lineitem.select(F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("fn"), F.col("l_linenumber").cast("string").alias("field"), access.alias("access")))


@query(with_views("trade", "SELECT src::VARCHAR AS src, dst::VARCHAR AS dst, 1::BIGINT AS n FROM trade"))
@requires("trade")
def dot_roundtrip(t: Tables) -> DataFrame:
    """Edges written as DOT lines and read again."""
    return readers.read_dot(sinks.dot_lines(views.trade(t)))[1]


@query("SELECT s_suppkey::VARCHAR AS name, s_name || '|' || s_acctbal AS label FROM supplier")
def dot_nodes(t: Tables) -> DataFrame:
    """Nodes with their labels, written as DOT lines among edges and read again."""
    rows = t.supplier.select(F.col("s_suppkey").alias("name"), F.concat(F.lit("{"), "s_name", F.lit("|"), F.col("s_acctbal").cast("string"), F.lit("}")).alias("label"))
    edges = t.supplier.select(F.col("s_suppkey").alias("src"), F.col("s_nationkey").alias("dst"))
    return readers.read_dot(sinks.dot_nodes(rows).union(sinks.dot_lines(edges)))[0]


_MACRO = """CASE event_type WHEN 'signup' THEN '  MacroNameTok: M' || event_id WHEN 'click' THEN '  Range: ["f' || user_id || '.c:' || event_id || ':1", "x"]'
  WHEN 'view' THEN '  ConditionRange: ["c.c:1:1", "c.c:1:2"]' ELSE '  Range: ["(nonfile)", "(nonfile)"]' END"""


@query("""SELECT user_id, event_id, macro, 'f' || user_id || '.c:' || event_id AS location FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN 'M' || event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS macro FROM events)
  WHERE event_type = 'click' AND macro IS NOT NULL""")
def macro_ranges(t: Tables) -> DataFrame:
    """Lines of a macro trace, one for each event."""
    out = readers.read_macro_ranges(t.events.select("user_id", "ts", "event_id", F.expr(_MACRO).alias("line")), ["user_id"], ["ts", "event_id"])
    return out.select("user_id", "event_id", "macro", "location")


@query("""WITH a AS (SELECT DISTINCT l_suppkey AS fn, CASE WHEN l_returnflag = 'R' THEN 'driver' ELSE 'kernel' END AS domain, CASE WHEN l_returnflag = 'R' THEN l_partkey % 40 ELSE l_partkey % 40 + 20 END AS field FROM lineitem WHERE l_quantity > 48),
  s AS (SELECT field, count(DISTINCT domain) > 1 AS shared FROM a GROUP BY 1)
  SELECT fn, domain, array_to_string(list_sort(list(field)), ',') AS fields, count(*) FILTER (WHERE shared)::BIGINT AS n_shared FROM a JOIN s USING (field) GROUP BY 1, 2""")
def access_sets(t: Tables) -> DataFrame:
    read = F.col("l_returnflag") == "R"
    field = F.when(read, F.col("l_partkey") % 40).otherwise(F.col("l_partkey") % 40 + 20)
    found = sets.accessed_fields(t.lineitem.where("l_quantity > 48").select(F.col("l_suppkey").alias("fn"), F.when(read, "driver").otherwise("kernel").alias("domain"), field.alias("field")))
    return found.withColumn("fields", F.array_join(F.transform("fields", lambda x: x.cast("string")), ","))


@query(with_views("tev", _SPECTRUM + """, ranked AS (SELECT node, rank() OVER (ORDER BY score DESC)::BIGINT AS rank FROM sc), f AS (SELECT DISTINCT length(node)::BIGINT AS version, node FROM tev UNION ALL SELECT 99, 'nowhere')
  SELECT version, min(rank)::BIGINT AS rank FROM f LEFT JOIN ranked USING (node) GROUP BY 1"""))
def fault_best_rank(t: Tables) -> DataFrame:
    """The best rank of each version's faulty nodes; null where no run hit one."""
    e = views.tev(t)
    spectrum = faults.spectra(e.where("node <> 'error'"), e.select("run", "failed").distinct())
    wrong = e.select(F.length("node").cast("bigint").alias("version"), "node").distinct().union(t.spark.sql("SELECT 99L AS version, 'nowhere' AS node"))
    return faults.fault_rank(faults.rank_nodes(faults.scores(spectrum)), wrong)


def _file(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(with_views("trade", "SELECT src, dst, (src - dst)::BIGINT AS \"offset\", 'copy' AS edge FROM trade"))
@requires("trade")
def points_file(t: Tables) -> DataFrame:
    """A points-to graph file, written and read again."""
    path = _file(t, "graph")
    views.trade(t).select("src", "dst", (F.col("src") - F.col("dst")).alias("offset"), F.lit("copy").alias("edge")).write.csv(path)
    return readers.read_points_to(t.spark, path)


@query("SELECT DISTINCT p_brand AS name FROM part")
def name_file(t: Tables) -> DataFrame:
    """A file of names (with blank and repeated lines), written and read again."""
    path = _file(t, "names")
    sinks.write_fact_set(t.part.select(F.concat("p_brand", F.lit(" ")).alias("value")).union(t.spark.sql("SELECT '  ' AS value")), path)
    return readers.read_names(t.spark, path)


@query("""WITH r AS (SELECT p_size AS rank, count(*) AS n FROM part GROUP BY 1), m AS (SELECT max(p_size) AS top FROM part)
  SELECT rank / top::DOUBLE AS x, sum(n) OVER (ORDER BY rank)::DOUBLE / (sum(n) OVER ()) AS y FROM r, m""")
def points_of_curve(t: Tables) -> DataFrame:
    """The points of a curve as lines ``x y``, written and read again."""
    path = _file(t, "curve")
    sinks.write_points(faults.rank_curve(t.part.select(F.col("p_size").cast("string").alias("rank_raw"), F.col("p_size").alias("total"))), path)
    return t.spark.read.csv(path, sep=" ", schema="x double, y double")


@query("SELECT l_suppkey AS fn, count(*)::BIGINT AS v FROM lineitem GROUP BY 1")
def profile_file(t: Tables) -> DataFrame:
    """Counters written as a profile and read again."""
    path = _file(t, "profile")
    sinks.write_profile(t.lineitem.groupBy(F.col("l_suppkey").alias("fn")).agg(F.count("*").alias("v")), path)
    return t.spark.read.parquet(path)


@query("""SELECT (CASE WHEN l_orderkey % 4 < 2 THEN 64 ELSE 32 END)::INTEGER AS width, CASE WHEN l_orderkey % 2 = 0 THEN 'little' ELSE 'big' END AS "order", 'f' || l_orderkey AS fn,
  (9223372036854775808::DECIMAL(20, 0) + l_orderkey)::DECIMAL(20, 0) AS hash, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey)::BIGINT AS pos, l_partkey::DECIMAL(20, 0) AS v FROM lineitem""")
def raw_profile_file(t: Tables) -> DataFrame:
    """Orders as functions and their lines as counters, written as raw binary profiles of both widths and byte orders, and read again."""
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))["l_partkey"]
    hashed = (F.lit("9223372036854775808").cast("decimal(20,0)") + F.col("l_orderkey").cast("decimal(20,0)")).cast("decimal(20,0)")
    rows = t.lineitem.groupBy("l_orderkey").agg(lines.alias("counters")).select("l_orderkey", F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("fn"), hashed.alias("hash"), "counters")
    out = []
    for i, (width, order) in enumerate((w, o) for w in (64, 32) for o in ("little", "big")):
        path = _file(t, "raw")
        sinks.write_raw_profile(rows.where(F.col("l_orderkey") % 4 == i), path, width, order)
        found = readers.read_raw_profiles(t.spark, path).where("error IS NULL")
        out.append(found.select(F.lit(width).alias("width"), F.lit(order).alias("order"), "fn", "hash", F.posexplode("counters").alias("pos", "v")).withColumn("pos", (F.col("pos") + 1).cast("bigint")))
    return reduce(DataFrame.unionByName, out)


@query("SELECT s_nationkey AS nation, sum(strlen(s_name) + 1)::BIGINT AS n_bytes FROM supplier GROUP BY 1")
def unit_files(t: Tables) -> DataFrame:
    """Every file of a directory tree as bytes: names written as one folder for each nation."""
    path = _file(t, "units")
    t.supplier.select("s_nationkey", F.col("s_name").alias("value")).write.partitionBy("s_nationkey").text(path)
    nation = F.regexp_extract("path", r"s_nationkey=(\d+)", 1).cast("int").alias("nation")
    return readers.read_units(t.spark, f"{path}/*").groupBy(nation).agg(F.sum(F.octet_length("content")).cast("bigint").alias("n_bytes"))


@query("""SELECT s_suppkey AS test, (s_suppkey % 9)::VARCHAR AS fails_at, CASE WHEN s_suppkey % 5 = 0 THEN '>' ELSE '' END || s_nationkey AS rank_raw, (s_nationkey + 1)::BIGINT AS total FROM supplier""")
def results_file(t: Tables) -> DataFrame:
    """Tab-separated results after two header lines, written as files of at most 100,000 lines of one nation and read again."""
    path = _file(t, "results")
    rank = F.concat(F.when(F.col("s_suppkey") % 5 == 0, ">").otherwise(""), F.col("s_nationkey").cast("string"))
    line = F.concat_ws("\t", "s_suppkey", F.col("s_suppkey") % 9, rank, F.col("s_nationkey") + 1)
    body = t.supplier.groupBy("s_nationkey", F.expr("s_suppkey div 100000").alias("piece")).agg(F.array_join(F.collect_list(line), "\n").alias("lines"))
    body = body.select(F.concat(F.lit("head\nhead\n"), "lines").alias("value"), "s_nationkey", "piece")
    body.repartition("s_nationkey", "piece").write.option("lineSep", "\n").partitionBy("s_nationkey", "piece").text(path)
    return readers.read_results(t.spark, f"{path}/*/*").select(F.col("test").cast("bigint").alias("test"), "fails_at", "rank_raw", "total")


@query("SELECT source, sum(len(string_split(text, chr(10))))::BIGINT AS n_lines FROM documents WHERE text IS NOT NULL GROUP BY 1")
def line_sum(t: Tables) -> DataFrame:
    """Lines summed over the files of each source."""
    return t.documents.where("text IS NOT NULL").groupBy("source").agg(F.sum(F.size(F.split("text", "\n"))).cast("bigint").alias("n_lines"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(l_partkey)), ' ') AS parts FROM lineitem GROUP BY 1")
def sorted_list(t: Tables) -> DataFrame:
    """The parts of each order as a sorted list, repeated ones included."""
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list("l_partkey")).cast("array<string>"), " ").alias("parts"))


@query("SELECT p_partkey, abs(p_retailprice - round(p_retailprice)) <= greatest(0.3, abs(round(p_retailprice)) * 0.0004) AS same FROM part")
def float_close(t: Tables) -> DataFrame:
    """Prices that equal whole ones within an absolute or a relative tolerance."""
    return t.part.select("p_partkey", fn.close(F.col("p_retailprice"), F.round("p_retailprice"), 0.3, 0.0004).alias("same"))


@query("""WITH b AS (SELECT p_partkey, [ord(x)::HUGEINT FOR x IN string_split(p_name, '')] AS b FROM part)
  SELECT p_partkey, list_reduce(b, lambda h, x: (h * 11 + x) % 18446744073709551616, 0::HUGEINT)::VARCHAR
    || list_reduce(b, lambda h, x: (h * 7) % 18446744073709551616 - (h * 7) % 256 + xor(((h * 7) % 256)::INTEGER, x::INTEGER), 0::HUGEINT)::VARCHAR AS hash FROM b""")
def unit_hash(t: Tables) -> DataFrame:
    """Double hashes of byte units."""
    return t.part.select("p_partkey", fn.double_hash(F.col("p_name").cast("binary")).alias("hash"))
