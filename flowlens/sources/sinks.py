"""Writers. Each writes a folder of part files, as Spark does; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowlens.sources import raw_profiles


def write_constraint_sets(sections: DataFrame, path: str) -> None:
    """The explicit and the implicit constraint set (which holds the explicit one) under two folders."""
    for name in ("explicit", "implicit"):
        sections.where(name).select("line").write.mode("overwrite").text(f"{path}/{name}")


def write_fact_set(facts: DataFrame, path: str) -> None:
    facts.distinct().write.mode("overwrite").text(path)


def dot_lines(edges: DataFrame) -> DataFrame:
    """(line): one DOT line for each edge; repeated edges stay."""
    return edges.select(F.format_string('"%s" -> "%s";', F.col("src").cast("string"), F.col("dst").cast("string")).alias("line"))


def dot_nodes(nodes: DataFrame) -> DataFrame:
    """(line): one DOT line for each of ``nodes(name, label)``."""
    return nodes.select(F.format_string('"%s" [shape=record,label="%s"];', F.col("name").cast("string"), "label").alias("line"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): one JSON object for each node with its successors."""
    after = edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_list("dst")).alias("to"))
    return nodes.join(after, "node", "left").select(F.to_json(F.struct("node", F.coalesce("to", F.array()).alias("to"))).alias("line"))


class LogFolder:
    """A log of lines that starts empty. Each batch is a folder of its own, written over what an earlier attempt of that batch
    left there: a batch that is repeated counts once, and a stream needs no memory of what it has written."""

    def __init__(self, spark: SparkSession, path: str, truncate: bool = True):
        """``truncate=False`` goes on with what is there, as a stream does that is started again."""
        self.spark, self.path = spark, path
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if truncate:
            files.delete(where, True)
        files.mkdirs(where)

    def append(self, lines: DataFrame, batch: int) -> None:
        """One batch of ``lines(line)``; lines that are null are left out."""
        lines.where("line IS NOT NULL").select("line").write.mode("overwrite").text(f"{self.path}/batch={batch}")

    def follow(self, lines: DataFrame, state: str) -> StreamingQuery:
        """Appends what a stream of ``lines(line)`` gives until its input ends; ``state`` is a folder of the stream's own."""
        return lines.writeStream.foreachBatch(self.append).option("checkpointLocation", state).trigger(availableNow=True).start()

    def lines(self) -> DataFrame:
        """(batch, line)."""
        rows = self.spark.read.text(self.path)
        batch = F.col("batch").cast("bigint") if "batch" in rows.columns else F.lit(None).cast("bigint")
        return rows.select(batch.alias("batch"), F.col("value").alias("line"))


def write_profile(counters: DataFrame, path: str) -> None:
    counters.write.mode("overwrite").parquet(path)


def write_raw_profile(counters: DataFrame, path: str, width: int = 64, order: str = "little", mode: str = "overwrite") -> None:
    """``counters(fn, hash, counters)`` as raw binary profiles of one width and byte order."""
    rows = counters.select("fn", F.col("hash").cast("decimal(20,0)").alias("hash"), F.col("counters").cast("array<decimal(20,0)>").alias("counters"))
    raw_profiles.register(counters.sparkSession)
    rows.write.format("rawprofile").mode(mode).option("width", width).option("order", order).save(path)


def write_points(curve: DataFrame, path: str) -> None:
    """``x y`` lines of a curve."""
    curve.orderBy("x").write.mode("overwrite").csv(path, sep=" ")


def policy_lines(accesses: DataFrame) -> DataFrame:
    """(fn, policy): one line of text for each function: its fields with their access, sorted. Text only; nothing is loaded anywhere."""
    each = F.concat(F.col("field"), F.lit(":"), F.col("access"))
    return accesses.groupBy("fn").agg(F.array_join(F.array_sort(F.collect_set(each)), ",").alias("fields")).select("fn", F.format_string("rpc %s(%s)", "fn", "fields").alias("policy"))
