"""Readers of program facts. Text readers give ``(file, line_no, line)``; other operators parse lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.sequences import carry_forward
from flowlens.sources import raw_profiles


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) with line numbers from 1. A file is read whole, as line numbers need its start."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    lines = whole.select("file", F.posexplode(F.split(F.regexp_replace("text", "\r?\n$", ""), "\r?\n")).alias("n", "line"))
    return lines.select("file", (F.col("n") + 1).cast("bigint").alias("line_no"), "line")


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name): one name a line; blank lines go."""
    return spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''").distinct()


def read_results(spark: SparkSession, path: str, skip: int = 2) -> DataFrame:
    """(test, fails_at, rank_raw, total) of tab-separated results after ``skip`` header lines."""
    parts = F.split("line", "\t")
    rows = read_lines(spark, path).where(F.col("line_no") > skip).where("line <> ''")
    return rows.select(parts[0].alias("test"), parts[1].alias("fails_at"), parts[2].alias("rank_raw"), F.expr("try_cast(split(line, '\t')[3] AS bigint)").alias("total"))


def read_fault_map(lines: DataFrame) -> DataFrame:
    """(version, line_no) of ``{v: (l, ..., ), }`` lines; -1 stands for a fault without a line."""
    head = F.regexp_extract("line", r"(-?\d+)\s*:", 1)
    listed = F.split(F.regexp_extract("line", r"\(([^)]*)\)", 1), ",")
    each = lines.where(head != "").select(head.cast("bigint").alias("version"), F.explode(listed).alias("l"))
    return each.where(F.trim("l") != "").select("version", F.trim("l").cast("bigint").alias("line_no"))


def read_trace(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dictionary (node_id, file, start_line, end_line) and events (line_no, seq, node_id) of a trace text:
    ``N = (file,a,b)`` lines define nodes, ``,N,N`` lines are events."""
    pattern = r"^(\d+) = \((.*?),(\d+)(?:,(\d+))?\)$"
    part = lambda i: F.regexp_extract("line", pattern, i)
    nodes = lines.where(F.col("line").rlike(pattern)).select(
        part(1).cast("int").alias("node_id"), part(2).alias("file"), part(3).cast("int").alias("start_line"), F.expr(f"try_cast(nullif(regexp_extract(line, r'{pattern}', 4), '') AS int)").alias("end_line")
    )
    events = lines.where(F.col("line").startswith(",")).select("line_no", F.posexplode(F.split(F.expr("substring(line, 2)"), ",")).alias("seq", "n"))
    return nodes, events.select("line_no", F.col("seq").cast("bigint").alias("seq"), F.col("n").cast("int").alias("node_id"))


def read_dot(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (name, label) and edges (src, dst, n: repeated edges are kept as a count) of DOT lines."""
    name = r'("(?:[^"\\]|\\.)*"|[\w.]+)'
    bare = lambda c: F.regexp_replace(c, r'^"|"$', "")
    edge = rf"^\s*{name}\s*->\s*{name}"
    edges = lines.where(F.col("line").rlike(edge)).select(bare(F.regexp_extract("line", edge, 1)).alias("src"), bare(F.regexp_extract("line", edge, 2)).alias("dst"))
    node = rf"^\s*{name}\s*\[.*?label=\"?\{{?([^\"\}}]*)\}}?\"?.*\]"
    nodes = lines.where(~F.col("line").contains("->") & F.col("line").rlike(node)).select(bare(F.regexp_extract("line", node, 1)).alias("name"), F.regexp_extract("line", node, 2).alias("label"))
    return nodes, edges.groupBy("src", "dst").agg(F.count("*").alias("n"))


#: What a line of a macro trace must not hold to give a range.
NO_RANGE = ("ConditionRange", "FilenameRange", "SourceRangeSkipped", "nonfile")


def read_macro_ranges(lines: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by..., order..., macro, location) of macro-trace blocks: each range line with the macro named last before it, and
    file and line of where the range begins."""
    named = carry_forward(lines, F.when(F.col("line").contains("MacroNameTok"), F.split("line", " ")[3]), by, order, "macro")
    kept = F.col("line").contains("Range")
    for part in NO_RANGE:
        kept = kept & ~F.col("line").contains(part)
    place = F.split(F.regexp_extract("line", r'\["([^"]*)"', 1), ":")
    return named.where(kept & F.col("macro").isNotNull()).select(*by, *order, "macro", F.concat_ws(":", place[0], place[1]).alias("location"))


def read_points_to(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, offset, edge) of a comma-separated graph file."""
    return spark.read.csv(path, schema="src bigint, dst bigint, offset bigint, edge string")


def read_units(spark: SparkSession, path: str) -> DataFrame:
    """(path, content): every file of a directory as bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def read_raw_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(path, fn, hash, counters, error) of raw binary profiles; numbers are unsigned and come as decimals."""
    return raw_profiles.register(spark).read.format("rawprofile").load(path)
