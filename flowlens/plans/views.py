"""Fact tables derived from the driver's tables, and the same definitions in SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.plans.registry import Tables, analysis


@analysis
def trade(t: Tables) -> DataFrame:
    """(src, dst): which nation's customers bought large, discounted lots from which nation's suppliers."""
    big = t.lineitem.where("l_quantity >= 50 AND l_discount >= 0.10").select("l_orderkey", "l_suppkey")
    rows = big.join(t.orders.select("o_orderkey", "o_custkey"), big.l_orderkey == F.col("o_orderkey")).join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(t.supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).where("c_nationkey <> s_nationkey")
    return rows.select(F.col("c_nationkey").cast("bigint").alias("src"), F.col("s_nationkey").cast("bigint").alias("dst")).distinct()


def tev(t: Tables) -> DataFrame:
    """(run, seq, node, failed): event traces; a run is a user's day of month and fails if it holds an error."""
    run = (F.col("user_id") * 100 + F.dayofmonth("ts")).cast("bigint")
    e = t.events.select(run.alias("run"), "ts", "event_id", F.col("event_type").alias("node"))
    w = Window.partitionBy("run")
    return e.select("run", F.row_number().over(w.orderBy("ts", "event_id")).cast("bigint").alias("seq"), "node", F.bool_or(F.col("node") == "error").over(w).alias("failed"))


def lines(t: Tables) -> DataFrame:
    """(doc_id, line_no, line): lines of documents, numbered from 0."""
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).select("doc_id", F.col("n").cast("bigint").alias("line_no"), "line")


@analysis
def stmt(t: Tables) -> DataFrame:
    """(kind, dst, src): pointer statements; each customer is a function with eight variables, each line of an order one
    statement of it: dst = &src, dst = src, dst = *src, *dst = src."""
    var = lambda c: (F.col("o_custkey") * 8 + F.col(c) % 8)
    kind = F.element_at(F.array(F.lit("addr"), F.lit("copy"), F.lit("load"), F.lit("store")), F.col("l_linenumber").cast("int") % 4 + 1)
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(kind.alias("kind"), var("l_partkey").alias("dst"), var("l_suppkey").alias("src")).distinct()


def prof(t: Tables) -> DataFrame:
    """(fn, hash, pos, v): counters by line status, ship year and line number."""
    return (
        t.lineitem.groupBy(F.concat("l_returnflag", "l_linestatus").alias("fn"), F.year("l_shipdate").cast("bigint").alias("hash"), F.col("l_linenumber").cast("bigint").alias("pos"))
        .agg(F.count("*").alias("v"))
    )


def cov(t: Tables) -> DataFrame:
    """(file, fn, region, covered): parts by brand and type; covered if returned in a large lot."""
    hit = t.lineitem.where("l_quantity >= 49 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("hit", F.lit(True))
    return t.part.join(hit, "p_partkey", "left").select(F.col("p_brand").alias("file"), F.col("p_type").alias("fn"), F.col("p_partkey").alias("region"), F.coalesce("hit", F.lit(False)).alias("covered"))


@analysis
def flow(t: Tables) -> DataFrame:
    """(lhs, rhs, kind, section): a layered graph customer > order > part > supplier > nation > region."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    section = F.when(F.col("o_orderpriority") == "5-LOW", "implicit").otherwise("default")
    o, li = t.orders, t.lineitem
    parts = [
        o.select(name("c", "o_custkey").alias("lhs"), name("o", "o_orderkey").alias("rhs"), section.alias("section")),
        li.select(name("o", "l_orderkey").alias("lhs"), name("p", "l_partkey").alias("rhs"), F.lit("default").alias("section")),
        li.where("l_quantity >= 45").select(name("p", "l_partkey").alias("lhs"), name("s", "l_suppkey").alias("rhs"), F.lit("default").alias("section")),
        t.supplier.select(name("s", "s_suppkey").alias("lhs"), name("n", "s_nationkey").alias("rhs"), F.lit("default").alias("section")),
        t.nation.select(name("n", "n_nationkey").alias("lhs"), name("r", "n_regionkey").alias("rhs"), F.lit("default").alias("section")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct().withColumn("kind", F.lit("default"))


def furniture(t: Tables) -> DataFrame:
    """(elem_id): the sources of flow: customers of one market segment."""
    return t.customer.where("c_mktsegment = 'FURNITURE'").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("elem_id"))


def whitelist(t: Tables) -> DataFrame:
    """(elem_id): parts of one brand."""
    return t.part.where("p_brand = 'Brand#11'").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("elem_id"))


VIEWS = {
    "trade": """SELECT DISTINCT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey
      JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 50 AND l_discount >= 0.10 AND c_nationkey <> s_nationkey""",
    "tev": """SELECT run, row_number() OVER (PARTITION BY run ORDER BY ts, event_id)::BIGINT AS seq, node, bool_or(node = 'error') OVER (PARTITION BY run) AS failed
      FROM (SELECT (user_id * 100 + extract(day FROM ts))::BIGINT AS run, ts, event_id, event_type AS node FROM events)""",
    "lines": "SELECT doc_id, (generate_subscripts(a, 1) - 1)::BIGINT AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)",
    "stmt": """SELECT DISTINCT ['addr', 'copy', 'load', 'store'][l_linenumber % 4 + 1] AS kind, o_custkey * 8 + l_partkey % 8 AS dst, o_custkey * 8 + l_suppkey % 8 AS src
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "prof": """SELECT l_returnflag || l_linestatus AS fn, year(l_shipdate)::BIGINT AS hash, l_linenumber::BIGINT AS pos, count(*)::BIGINT AS v FROM lineitem GROUP BY ALL""",
    "cov": """SELECT p_brand AS file, p_type AS fn, p_partkey AS region, p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49 AND l_returnflag = 'R') AS covered FROM part""",
    "flow": """SELECT DISTINCT lhs, rhs, section, 'default' AS kind FROM (
      SELECT 'c' || o_custkey AS lhs, 'o' || o_orderkey AS rhs, CASE WHEN o_orderpriority = '5-LOW' THEN 'implicit' ELSE 'default' END AS section FROM orders
      UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey, 'default' FROM lineitem
      UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey, 'default' FROM lineitem WHERE l_quantity >= 45
      UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'default' FROM supplier
      UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'default' FROM nation)""",
    "furniture": "SELECT 'c' || c_custkey AS elem_id FROM customer WHERE c_mktsegment = 'FURNITURE'",
    "whitelist": "SELECT 'p' || p_partkey AS elem_id FROM part WHERE p_brand = 'Brand#11'",
}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``body`` over some of VIEWS (names by spaces), which may hold further ``x AS (...)`` parts before its SELECT."""
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{'' if body.lstrip().startswith(',') else ' '}{body}"
