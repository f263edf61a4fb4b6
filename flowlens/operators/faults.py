"""Fault localization: suspiciousness of nodes from passing and failing runs, ranks, and cumulative curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def spectra(hits: DataFrame, runs: DataFrame) -> DataFrame:
    """(node, ef, ep, tf, tp) of ``hits(run, node)`` and ``runs(run, failed)``: failing and passing runs that
    hit each node, and all failing and passing runs."""
    totals = runs.agg(F.count_if("failed").alias("tf"), F.count_if(~F.col("failed")).alias("tp"))
    each = hits.select("run", "node").distinct().join(runs, "run").groupBy("node").agg(F.count_if("failed").alias("ef"), F.count_if(~F.col("failed")).alias("ep"))
    return each.crossJoin(F.broadcast(totals))  # one row of totals


def scores(spectrum: DataFrame, method: str = "ochiai") -> DataFrame:
    """``spectrum`` with ``score``: published formulas (``ochiai``, ``tarantula``, ``jaccard``)."""
    ef, ep, tf, tp = (F.col(c) for c in ("ef", "ep", "tf", "tp"))
    formulas = {
        "ochiai": ef / F.sqrt(tf * (ef + ep)),
        "tarantula": (ef / tf) / (ef / tf + ep / tp),
        "jaccard": ef / (tf + ep),
    }
    return spectrum.withColumn("score", formulas[method].cast("double"))


def rank_nodes(scored: DataFrame) -> DataFrame:
    """``scored`` with ``rank``, the most suspicious first; equal scores share a rank. The program's nodes are
    counted, not its runs, so one window over them is small."""
    return scored.withColumn("rank", F.rank().over(Window.orderBy(F.desc("score"))).cast("bigint"))


def fault_rank(ranked: DataFrame, faults: DataFrame) -> DataFrame:
    """(version, rank): the best rank of each version's faulty nodes; null if none was hit."""
    return faults.join(ranked, "node", "left").groupBy("version").agg(F.min("rank").alias("rank"))


def rank_curve(ranks: DataFrame) -> DataFrame:
    """(x, y) of ``ranks(rank_raw, total)``: share of code examined and share of faults located.

    Ranks that begin with ``>`` were not located: they are left out of the count, but their totals still
    count for the largest one. Ranks are counted per value first, so the window runs over the distinct ones.
    """
    top = ranks.agg(F.max("total").alias("top"))
    located = ranks.where(~F.col("rank_raw").startswith(">")).select(F.col("rank_raw").cast("bigint").alias("rank"))
    counts = located.groupBy("rank").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    every = F.sum("n").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return counts.withColumn("y", upto / every).crossJoin(F.broadcast(top)).select((F.col("rank") / F.col("top")).alias("x"), "y")
