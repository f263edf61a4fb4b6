"""Profile counters: parsing, merging with overflow checks, summaries.

Counters are unsigned 64-bit numbers, held as DECIMAL(20,0) and summed as DECIMAL(38,0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.sequences import islands

MAX_COUNTER = "18446744073709551615"


def parse_profile_text(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by..., fn, hash, pos, v): name, hash, number of counters, then the counters, one a line; ``#`` lines are
    comments and a blank line ends a record. Records whose numbers do not parse, or whose count is wrong or
    0, are given as one row with ``error``."""
    kept = lines.where(~F.col("line").startswith("#"))
    rows = islands(kept, by, F.trim("line") == "")
    w = Window.partitionBy(*by, "record").orderBy("line_no")
    rows = rows.withColumn("at", F.row_number().over(w).cast("bigint"))
    head = rows.groupBy(*by, "record").agg(
        F.max(F.when(F.col("at") == 1, F.col("line"))).alias("fn"), F.max(F.when(F.col("at") == 2, F.expr("try_cast(line AS decimal(20,0))"))).alias("hash"),
        F.max(F.when(F.col("at") == 3, F.expr("try_cast(line AS bigint)"))).alias("count"), (F.count("*") - 3).alias("given"),
        F.count_if((F.col("at") > 3) & F.expr("try_cast(line AS decimal(20,0))").isNull()).alias("bad"),
    )
    error = (
        F.when(F.col("hash").isNull(), "bad hash").when(F.col("count").isNull() | (F.col("count") <= 0), "no counts").when(F.col("bad") > 0, "bad counter").when(F.col("count") != F.col("given"), "wrong number of counters")
    )
    head = head.select(*by, "record", "fn", "hash", error.alias("error"))
    body = rows.where("at > 3").select(*by, "record", (F.col("at") - 3).alias("pos"), F.expr("try_cast(line AS decimal(20,0))").alias("v"))
    good = head.where("error IS NULL").join(body, [*by, "record"]).select(*by, "fn", "hash", "pos", "v", "error")
    nothing = [F.lit(None).cast("bigint").alias("pos"), F.lit(None).cast("decimal(20,0)").alias("v")]
    return good.unionByName(head.where("error IS NOT NULL").select(*by, "fn", "hash", *nothing, "error"))


def merge_counters(profiles: DataFrame) -> DataFrame:
    """(fn, hash, pos, v, error): element-wise sums of ``profiles(input, fn, hash, pos, v)`` by (fn, hash).

    The first input that holds a (fn, hash) fixes its length; records of another length are left out (see
    ``length_errors``) and the merge goes on. A sum beyond an unsigned 64-bit number is null, with an error.
    """
    kept = _with_lengths(profiles).where("len = first_len")
    total = F.sum(F.col("v").cast("decimal(38,0)"))
    out = kept.groupBy("fn", "hash", "pos").agg(total.alias("s"))
    over = F.col("s") > F.lit(MAX_COUNTER).cast("decimal(38,0)")
    return out.select("fn", "hash", "pos", F.when(~over, F.col("s").cast("decimal(38,0)")).alias("v"), F.when(over, F.lit("counter overflow")).alias("error"))


def length_errors(profiles: DataFrame) -> DataFrame:
    """(input, fn, hash): records whose length differs from the first input's."""
    return _with_lengths(profiles).where("len <> first_len").select("input", "fn", "hash").distinct()


def _with_lengths(profiles: DataFrame) -> DataFrame:
    lengths = profiles.groupBy("input", "fn", "hash").agg(F.count("*").alias("len"))
    first = lengths.groupBy("fn", "hash").agg(F.min_by("len", "input").alias("first_len"))
    return profiles.join(lengths, ["input", "fn", "hash"]).join(first, ["fn", "hash"])


def summarise(counters: DataFrame) -> DataFrame:
    """(fn, hash, function_count, block_sum, block_max): the first counter is the function's, the rest are blocks'."""
    first, rest = F.when(F.col("pos") == 1, F.col("v")), F.when(F.col("pos") > 1, F.col("v"))
    return counters.groupBy("fn", "hash").agg(F.max(first).alias("function_count"), F.sum(rest).alias("block_sum"), F.max(rest).alias("block_max"))


def parse_samples(lines: DataFrame, by: list[str]) -> DataFrame:
    """(by..., fn, total, head, line, disc, n, callee, calls, error): sample profiles; a head line ``fn:total:head``,
    then ``line[.disc]: n callee:calls ...``. Negative or malformed numbers give a row with ``error``."""
    head = F.regexp_extract("line", r"^([^\s:][^:]*):(-?\d+):(-?\d+)\s*$", 1)
    w = Window.partitionBy(*by).orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = lines.where(F.trim("line") != "").withColumn("h", F.when(~F.col("line").rlike(r"^\s"), F.col("line")))
    rows = rows.withColumn("open", F.last("h", ignorenulls=True).over(w)).withColumn("is_head", F.col("h").isNotNull())
    body = r"^\s+(-?\d+)(?:\.(-?\d+))?:\s*(-?\d+)((?:\s+[^\s:]+:-?\d+)*)\s*$"
    part = lambda i: F.expr(f"try_cast(nullif(regexp_extract(line, r'{body}', {i}), '') AS bigint)")
    top = lambda i: F.expr(f"try_cast(nullif(regexp_extract(open, r'^([^\\s:][^:]*):(-?\\d+):(-?\\d+)\\s*$', {i}), '') AS bigint)")
    rows = rows.withColumn("fn", F.regexp_extract("open", r"^([^\s:][^:]*):", 1)).withColumn("total", top(2)).withColumn("head", top(3))
    good = F.when(F.col("is_head"), head != "").otherwise(F.col("line").rlike(body))
    out = rows.where("NOT is_head").withColumn("line_n", part(1)).withColumn("disc", F.coalesce(part(2), F.lit(0))).withColumn("n", part(3))
    error = F.when(~good, "malformed line").when(F.col("total").isNull(), "bad head").when((F.col("line_n") < 0) | (F.col("disc") < 0) | (F.col("n") < 0), "negative number")
    calls = F.expr(f"filter(split(trim(regexp_extract(line, r'{body}', 4)), ' +'), x -> x <> '')")
    return out.select(*by, "fn", "total", "head", F.col("line_n").alias("line"), "disc", "n", calls.alias("calls"), error.alias("error"))


def merge_samples(samples: DataFrame) -> DataFrame:
    """(fn, line, disc, n): sums of sample counts of all inputs."""
    return samples.where("error IS NULL").groupBy("fn", "line", "disc").agg(F.sum("n").alias("n"))


def merge_calls(samples: DataFrame) -> DataFrame:
    """(fn, line, disc, callee, n): sums of call counts of all inputs."""
    each = samples.where("error IS NULL").select("fn", "line", "disc", F.explode("calls").alias("c"))
    return each.groupBy("fn", "line", "disc", F.substring_index("c", ":", 1).alias("callee")).agg(F.sum(F.substring_index("c", ":", -1).cast("bigint")).alias("n"))


def scale_weights(df: DataFrame, weight: str, top) -> DataFrame:
    """Weights scaled into 32 bits: floor(w / (floor(max / (2**32 - 1)) + 1)) + 1."""
    scale = F.floor(top / F.lit(4294967295)) + 1
    return df.withColumn("scaled", (F.floor(F.col(weight) / scale) + 1).cast("bigint"))
