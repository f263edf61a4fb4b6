"""Connected components of a graph of links, by alternating star contraction.

Each round turns the links of every node towards its smallest neighbour, with grouped minima and joins
only, so a node of very many links is partially aggregated and its join side can be split. Links and
labels never leave Spark; the driver sees one count for each round, of the nodes that are not settled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from flowlens.llm.lineage import Tables

ROUNDS = 60


def components(links: DataFrame, tables: Tables | None = None) -> DataFrame:
    """(node, component) of all nodes of ``links(a, b)``; component is the smallest node reachable."""
    links = contracted(links, tables or Tables(links.sparkSession))
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(links.select("b", "b").distinct())


def _settled(links: DataFrame) -> bool:
    """Whether each node a has one link and is no other node's b: then b is the smallest of the component."""
    up, seen = F.lit(1).alias("up"), Observation()
    ends = links.select(F.col("a").alias("node"), up, F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0")
    odd.observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    return not seen.get["n"]


def contracted(links: DataFrame, tables: Tables) -> DataFrame:
    """A table (a, b) of all nodes a that are not the smallest of their component, b."""
    links = tables.write(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(ROUNDS):
        if _settled(links):
            return links
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        # each larger neighbour of a node moves to the node's smallest
        larger = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # each node's smaller neighbours, and the node, move to the smallest of them
        low = larger.groupBy("a").agg(F.min("b").alias("low"))
        smaller = larger.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x"))
        turned = tables.write(smaller.select("x.a", "x.b").where("a <> b").distinct())
        tables.drop(links)
        links = turned
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
