"""Order-sensitive operators over lines and traces, as window expressions partitioned by file or run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_forward(df: DataFrame, value: Column, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with the last non-null ``value`` at or before each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def sections(lines: DataFrame, by: list[str], headers: tuple[str, ...] = ("default:", "default-sink:", "source-sink:", "implicit:")) -> DataFrame:
    """Constraint lines (with ``<:``) and their section, split into explicit and implicit sets.

    A header is a whole line; other headers leave the section as it is; lines before any header go.
    The explicit set leaves out the implicit section; the implicit set holds everything.
    """
    known = F.when(F.col("line").isin(*headers), F.expr("substring(line, 1, length(line) - 1)"))
    out = carry_forward(lines, known, by, ["line_no"], "section").where(F.col("line").contains("<:") & F.col("section").isNotNull())
    return out.withColumn("explicit", F.col("section") != "implicit").withColumn("implicit", F.lit(True))


def skip_pairs(lines: DataFrame, match: Column, by: list[str]) -> DataFrame:
    """Lines left after each matching line has gone together with the next line, which is not tested itself.

    In a run of matching lines every second one is such a next line, so all matching lines go, and the
    line after a run goes if the run's length is odd.
    """
    w = Window.partitionBy(*by).orderBy("line_no")
    marked = lines.withColumn("_m", F.coalesce(match, F.lit(False)))
    marked = marked.withColumn("_n", F.row_number().over(w)).withColumn("_last", F.max(F.when(~F.col("_m"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    run = F.col("_n") - 1 - F.coalesce("_last", F.lit(0))
    return marked.where(~F.col("_m") & (run % 2 == 0)).drop("_m", "_n", "_last")


def first_seen_ids(df: DataFrame, key: str, by: list[str], order: list[str], name: str) -> DataFrame:
    """``df`` with dense ids from 0 in the order in which keys first appear."""
    first = F.min(F.struct(*order)).over(Window.partitionBy(*by, key))
    return df.withColumn("_first", first).withColumn(name, (F.dense_rank().over(Window.partitionBy(*by).orderBy("_first")) - 1).cast("bigint")).drop("_first")


def nesting(df: DataFrame, step: Column, by: list[str], order: list[str], name: str = "level") -> DataFrame:
    """``df`` with the running sum of +1 (enter) and -1 (exit)."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(step).over(w).cast("bigint"))


def trace_edges(trace: DataFrame, by: list[str], order: list[str], node: str) -> DataFrame:
    """(by..., src, dst, seq): consecutive pairs of each run."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = trace.select(*by, F.col(node).alias("src"), F.lead(node).over(w).alias("dst"), F.row_number().over(w).cast("bigint").alias("seq"))
    return out.where("dst IS NOT NULL")


def compact_trace(trace: DataFrame, by: list[str], order: list[str], node: str) -> DataFrame:
    """(by..., src, dst, n): the different edges of each run with their counts."""
    return trace_edges(trace, by, order, node).groupBy(*by, "src", "dst").agg(F.count("*").alias("n"))


def pair_with_next(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Rows at odd places with the value of the row after them (exit code line, then trace line)."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_n", F.row_number().over(w)).withColumn("next_value", F.lead(value).over(w))
    return out.where("_n % 2 = 1 AND next_value IS NOT NULL").drop("_n")


def islands(lines: DataFrame, by: list[str], blank: Column) -> DataFrame:
    """Non-blank lines with the number of their record; blank lines end records."""
    w = Window.partitionBy(*by).orderBy("line_no")
    ends = F.sum(F.when(blank, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = lines.withColumn("_ends", ends).where(~blank)
    return out.withColumn("record", F.dense_rank().over(Window.partitionBy(*by).orderBy("_ends")).cast("bigint")).drop("_ends")
