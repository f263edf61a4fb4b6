"""Coverage: filters over function records, roll-ups, summaries."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def match_any(filters: list[Column]) -> Column:
    """OR of filters; an empty list matches nothing."""
    return reduce(or_, filters, F.lit(False))


def match_all(filters: list[Column]) -> Column:
    """AND of filters; an empty list matches everything."""
    return reduce(and_, filters, F.lit(True))


def name_contains(text: str, name: str = "fn") -> Column:
    return F.col(name).contains(text)


def name_matches(pattern: str, name: str = "fn") -> Column:
    """Regular-expression search, not a full match."""
    return F.col(name).rlike(pattern)


def percent_below(covered: Column, total: Column, threshold: float) -> Column:
    return covered * 100 < total * threshold


def percent_above(covered: Column, total: Column, threshold: float) -> Column:
    return covered * 100 > total * threshold


def percent(part: Column, whole: Column) -> Column:
    """Per cent of a sum; null where there is nothing to cover."""
    return F.when(whole > 0, part * F.lit(100.0) / whole)


def rollup(regions: DataFrame) -> DataFrame:
    """(file, fn, level, regions, missed, pct): per function, per file (fn null) and in total (file null);
    percentages come from sums, never from averages."""
    out = regions.rollup("file", "fn").agg(
        F.grouping_id().cast("bigint").alias("level"), F.count("*").alias("regions"), F.count_if(~F.col("covered")).alias("missed"), F.count_if("covered").alias("hit")
    )
    return out.select("file", "fn", "level", "regions", "missed", percent(F.col("hit"), F.col("regions")).alias("pct"))


def summary_text(executed: Column, total: Column, nothing: str) -> Column:
    """``84.21% of 38``, or the given words where there is nothing to execute."""
    return F.when(total > 0, F.format_string("%.2f%% of %d", executed * F.lit(100.0) / total, total)).otherwise(F.lit(nothing))
