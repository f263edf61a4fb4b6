"""Information flow: constraints, least and greatest solutions, whitelists, reports.

``constraints(lhs, rhs, kind, section)`` say that what taints lhs taints rhs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.graph import reach, reversed_edges
from flowlens.operators.joins import overlap_join

#: Held values that meet in one task.
ROWS = 1 << 19


def label_elements(config: DataFrame, fields: DataFrame) -> DataFrame:
    """(elem_id): elements of labelled locations: ``config(loc_id, off_lo, off_hi)`` labels the bytes of a field, or
    the whole location where both are null."""
    wanted = config.select("loc_id", F.col("off_lo").alias("want_lo"), F.col("off_hi").alias("want_hi")).distinct()
    # one join for both, as fields are the large side
    return fields.join(wanted, "loc_id").where("want_lo IS NULL OR (off_lo < want_hi AND want_lo < off_hi)").select("elem_id").distinct()


def flow_edges(constraints: DataFrame, kinds: list[str] | None = None, implicit: bool = False) -> DataFrame:
    """(src, dst) of the chosen kinds; the implicit section only on demand. Pruned before any solving."""
    out = constraints if kinds is None else constraints.where(F.col("kind").isin(kinds))
    out = out if implicit else out.where("section <> 'implicit'")
    return out.select(F.col("lhs").alias("src"), F.col("rhs").alias("dst"))


def without_whitelist(constraints: DataFrame, whitelist: DataFrame, kind: str = "default") -> DataFrame:
    """Constraints without those of ``kind`` that enter or leave a whitelisted element."""
    listed = whitelist.select(F.col("elem_id").alias("w")).distinct()
    free = constraints.where(F.col("kind") == kind).join(listed, F.col("lhs") == F.col("w"), "left_anti").join(listed, F.col("rhs") == F.col("w"), "left_anti")
    return free.unionByName(constraints.where(F.col("kind") != kind))


def least_solution(constraints: DataFrame, sources: DataFrame, kinds: list[str] | None = None, implicit: bool = False) -> DataFrame:
    """(elem_id, depth): all tainted elements, sources included."""
    found = reach(flow_edges(constraints, kinds, implicit), sources.select(F.col("elem_id").alias("node")))
    return found.withColumnRenamed("node", "elem_id")


def greatest_solution(constraints: DataFrame, untainted: DataFrame, elements: DataFrame, kinds: list[str] | None = None, implicit: bool = False) -> DataFrame:
    """(elem_id): the largest set that may be tainted while none of ``untainted`` is: what flows into them is not."""
    bad = reach(reversed_edges(flow_edges(constraints, kinds, implicit)), untainted.select(F.col("elem_id").alias("node")))
    return elements.select("elem_id").join(bad.select(F.col("node").alias("elem_id")), "elem_id", "left_anti")


def report(sites: DataFrame, tainted: DataFrame, whitelist: DataFrame | None = None) -> DataFrame:
    """Branches or instructions ``sites(..., elem_id)`` whose element is tainted (and not whitelisted)."""
    out = sites.join(tainted.select("elem_id"), "elem_id", "left_semi")
    return out if whitelist is None else out.join(whitelist.select("elem_id"), "elem_id", "left_anti")


def report_by_kind(sites: DataFrame, tainted: DataFrame, whitelist: DataFrame) -> DataFrame:
    """``report`` where pointers and other values have whitelists of their own: an entry of ``whitelist(elem_id, pointer)`` exempts
    those of ``sites(..., elem_id, pointer)`` that agree with it in both; a site of unknown kind is exempt under no entry."""
    return sites.join(tainted.select("elem_id"), "elem_id", "left_semi").join(whitelist.select("elem_id", "pointer"), ["elem_id", "pointer"], "left_anti")


def mediators(values: DataFrame, tainted: DataFrame) -> DataFrame:
    """(fn, n_values): functions that hold values that depend on the input, and how many different ones, of ``values(fn, elem_id)``.

    Values are dealt once, by element, in parts of about ROWS rows; they are joined, and repeated ones dropped, where they lie.
    """
    n = max(int(values.sparkSession.conf.get("spark.sql.shuffle.partitions")), values.count() // ROWS + 1)
    held = values.repartition(n, "elem_id").join(tainted.select("elem_id").repartition(n, "elem_id"), "elem_id", "left_semi").select("fn", "elem_id").distinct()
    return held.groupBy("fn").agg(F.count("*").alias("n_values"))


def apply_summaries(calls: DataFrame, tree: DataFrame) -> DataFrame:
    """(node_id, access): memory copies write the fields of their destination and read those of their source.

    ``calls(callee, dest, src)`` name parameter trees; ``tree(node_id, tree_id, parent_id)``; roots are no fields.
    """
    fields = tree.where("parent_id IS NOT NULL")
    copies = calls.where("callee = 'memcpy'")
    written = copies.join(fields, copies.dest == fields.tree_id).select("node_id", F.lit("DATA_WRITE").alias("access"))
    read = copies.join(fields, copies.src == fields.tree_id).select("node_id", F.lit("DATA_READ").alias("access"))
    return written.union(read).distinct()


def check_accesses(accesses: DataFrame, regions: DataFrame, width: int = 64) -> DataFrame:
    """Accesses (id, lo, hi) that lie in no legal region (lo, hi)."""
    inside = overlap_join(accesses, regions.select(F.col("lo").alias("r_lo"), F.col("hi").alias("r_hi")), "lo", "hi", "r_lo", "r_hi", width).where("r_lo <= lo AND hi <= r_hi")
    return accesses.join(inside.select("id").distinct(), "id", "left_anti")
