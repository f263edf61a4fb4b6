"""Set algebra, interning, maps and bit sets over fact tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.fixpoint import cut


def union_all_distinct(*tables: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, tables).distinct()


def merge_first(*maps: DataFrame) -> DataFrame:
    """(key, value): of several maps, the first that holds a key gives its value."""
    tagged = reduce(DataFrame.unionByName, [m.select("key", "value", F.lit(i).alias("_source")) for i, m in enumerate(maps)])
    return tagged.groupBy("key").agg(F.min_by("value", F.struct("_source", "value")).alias("value"))


def intern(members: DataFrame, owner: str, item: str) -> DataFrame:
    """(owner, members, set_id): equal sets share one canonical sorted array and id; ids follow the arrays' order.

    Different sets are sorted by ranges and numbered inside each; only the ranges' sizes are summed in one task.
    """
    sets = members.where(F.col(item).isNotNull()).groupBy(owner).agg(F.array_sort(F.collect_set(item)).alias("members"))
    place = F.monotonically_increasing_id()  # the range in the upper bits, the place in it in the lower 33
    ranged = cut(sets.select("members").distinct().repartitionByRange("members").sortWithinPartitions("members").withColumn("_place", place))
    ranged = ranged.select("members", F.shiftright("_place", 33).alias("_range"), F.col("_place").bitwiseAND((1 << 33) - 1).alias("_at"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    ids = ranged.join(sizes, "_range").select("members", (F.col("_before") + F.col("_at") + 1).alias("set_id"))
    return sets.join(ids, "members").select(owner, "members", "set_id")


def bit_counts(facts: DataFrame, owner: str, item: str) -> DataFrame:
    """(owner, n): different items of each owner, by words of 64 places, so a set of few members that lie far apart stays small."""
    rows = facts.select(owner, F.col(item).cast("bigint").alias("_item"))
    words = rows.groupBy(owner, F.shiftright("_item", 6).alias("_w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_item & 63 AS int))")).alias("_m"))
    return words.groupBy(owner).agg(F.sum(F.coalesce(F.bit_count("_m"), F.lit(0))).cast("bigint").alias("n"))


def first_failure(outcomes: DataFrame, index: str, failed: str, by: list[str]) -> DataFrame:
    """(by..., first_bad): the smallest index that fails: what bisection looks for."""
    return outcomes.where(F.col(failed)).groupBy(*by).agg(F.min(index).alias("first_bad"))


def accessed_fields(accesses: DataFrame) -> DataFrame:
    """(fn, domain, fields, n_shared): the sorted fields that each function of ``accesses(fn, domain, field)`` reads or writes,
    and how many of them more than one domain accesses."""
    shared = accesses.groupBy("field").agg((F.count_distinct("domain") > 1).alias("shared"))
    each = accesses.select("fn", "domain", "field").distinct().join(shared, "field")
    return each.groupBy("fn", "domain").agg(F.array_sort(F.collect_list("field")).alias("fields"), F.count_if("shared").alias("n_shared"))


def wild_casts(casts: DataFrame, embeds: DataFrame, untyped: tuple[str, ...] = ("void",)) -> DataFrame:
    """Those of ``casts(..., src, dst)`` between two different types of which neither is the other's first member
    (``embeds(outer, first)``) and neither is untyped. A cast from or to an unknown (null) type is not judged."""
    both = casts.where("src <> dst").where(~F.col("src").isin(*untyped) & ~F.col("dst").isin(*untyped))
    pair = embeds.select("outer", "first").union(embeds.select("first", "outer")).distinct()
    return both.join(pair, (F.col("src") == F.col("outer")) & (F.col("dst") == F.col("first")), "left_anti")
