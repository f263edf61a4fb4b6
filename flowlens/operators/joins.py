"""Joins that are more than an equality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, l_lo: str, l_hi: str, r_lo: str, r_hi: str, width: float, on: list[str] | None = None) -> DataFrame:
    """Pairs of half-open ranges that overlap, as an equality on cells of ``width`` times a power of two.

    A range's level is the least whose cells are as long as it is, so it touches two of them at most, however long it
    is. The longer range of a pair stands in the cells of its own level and the shorter one is looked up there: each
    side goes once to its own level, and to the (at most some sixty) higher levels that the other side has. A pair is
    kept in the first cell that both touch only, so no distinct is needed. Empty ranges and null ends meet nothing.
    """

    def levelled(df: DataFrame, lo: str, hi: str) -> DataFrame:
        size = (F.col(hi) - F.col(lo)).cast("double") / width
        return df.where(F.col(lo) < F.col(hi)).withColumn("_own", F.greatest(F.lit(0), F.ceil(F.log2(size)).cast("int")))

    def cell(c, level):
        return F.floor(c / (F.lit(float(width)) * F.pow(F.lit(2.0), level))).cast("bigint")

    def cells(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("_cell", F.explode(F.sequence(cell(F.col(lo), F.col("_level")), cell(F.col(hi), F.col("_level"))))).drop("_own")

    left, right = levelled(left, l_lo, l_hi), levelled(right, r_lo, r_hi)
    levels = {side: sorted(r[0] for r in df.select("_own").distinct().collect()) for side, df in (("left", left), ("right", right))}
    own = lambda df: df.withColumn("_level", F.col("_own"))

    def raised(df: DataFrame, to: list[int], least: Column) -> DataFrame:
        return df.withColumn("_level", F.explode(F.filter(F.array(*map(F.lit, to)).cast("array<int>"), lambda x: x >= least)))

    keys = [*(on or []), "_level", "_cell"]
    longer = cells(own(left), l_lo, l_hi).join(cells(raised(right, levels["left"], F.col("_own")), r_lo, r_hi), keys)
    shorter = cells(raised(left, levels["right"], F.col("_own") + 1), l_lo, l_hi).join(cells(own(right), r_lo, r_hi), keys)
    pairs = longer.unionByName(shorter)
    low = cell(F.greatest(F.col(l_lo), F.col(r_lo)), F.col("_level"))
    return pairs.where((F.col(l_lo) < F.col(r_hi)) & (F.col(r_lo) < F.col(l_hi)) & (F.col("_cell") == low)).drop("_cell", "_level")


def full_diff(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., left_value, right_value, kind): what only one side has, what differs, what matches."""
    a, b = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("_l")), right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("_r"))
    kind = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").when(F.col("left_value").eqNullSafe(F.col("right_value")), "match").otherwise("changed")
    return a.join(b, keys, "full").select(*keys, "left_value", "right_value", kind.alias("kind"))


def left_default(left: DataFrame, right: DataFrame, on: list[str], value: str, default) -> DataFrame:
    """``left`` with a looked-up value, or the default where the key is missing."""
    return left.join(right.select(*on, value), on, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def resolve_aliases(uses: DataFrame, aliases: DataFrame) -> DataFrame:
    """(target, uses): uses of each target, internal aliases resolved."""
    internal = aliases.where("internal").select(F.col("alias").alias("name"), F.col("target").alias("to"))
    return uses.join(internal, "name", "left").groupBy(F.coalesce("to", "name").alias("target")).agg(F.count("*").alias("uses"))


def indirect_calls(sites: DataFrame, functions: DataFrame) -> DataFrame:
    """(site, fn, etype): address-taken functions whose signature equals the call site's."""
    taken = functions.where("address_taken").select("fn", "signature")
    return sites.join(taken, "signature").select("site", "fn", F.lit("IND_CALL").alias("etype"))


def ternary(true_possible: Column, false_possible: Column) -> Column:
    """False if only the true branch is feasible, true if only the false one is, else unknown (null)."""
    return F.when(true_possible & ~false_possible, F.lit(False)).when(~true_possible & false_possible, F.lit(True))
