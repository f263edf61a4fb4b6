"""Least fixpoints: the semi-naive loop that graph and taint operators share, and the tables of its rounds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class RoundLimitError(RuntimeError):
    """A fixpoint did not settle within the round limit that the caller gave."""


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only where it is unset (a local session, as in tests) a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="flowlens-"))
    return jsc.getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint. Columns are named afresh at the top, so later unions of parts of one loop
    never meet the same column twice."""
    shared_folder(df.sparkSession)
    return df.select(*[F.col(c).alias(c) for c in df.columns]).checkpoint()


class Rounds:
    """Tables of a loop in the shared folder. ``write`` gives a table read again and its number of rows, found in
    the same job; ``drop`` deletes tables that no later round reads. What a result still reads stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame) -> tuple[DataFrame, int]:
        path, seen = f"{shared_folder(self.spark)}/round-{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out, seen.get["n"]

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None and id(table) in self.paths:
                where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.paths.pop(id(table))[1])
                where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Dealt(Rounds):
    """Rounds whose tables lie dealt by columns (bucketed), so that joins by these columns do not deal them again. Bucketed tables
    need names in the session's catalog: ``drop`` all of them when the loop has ended."""

    ROWS = 1 << 17  # new facts of the first round for each bucket

    def __init__(self, spark: SparkSession, keys: list[str], buckets: int):
        super().__init__(spark)
        self.keys, self.buckets = keys, buckets

    def write(self, df: DataFrame) -> tuple[DataFrame, int]:
        """``df`` is dealt by the keys already (``deal``, and what keeps it so), or each task writes a file for each bucket."""
        name, seen = f"round_{uuid.uuid4().hex}", Observation()
        path = f"{shared_folder(self.spark)}/{name}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.format("parquet").bucketBy(self.buckets, *self.keys).option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        self.paths[id(out)] = (out, path)
        return out, seen.get["n"]

    def deal(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.buckets, *self.keys)

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            if table is not None and id(table) in self.paths:
                self.spark.sql(f"DROP TABLE {self.paths[id(table)][1].rpartition('/')[2]}")
        super().drop(*tables)

    def drop_all(self) -> None:
        self.drop(*[table for table, _ in self.paths.values()])


class Known:
    """What a loop has found: tables of growing size. Eight of one size become one of the next, so each row is written again
    at most once for each eightfold number of rounds, and a round reads few tables."""

    WIDTH = 8

    def __init__(self, rounds: Rounds):
        self.rounds, self.parts = rounds, []

    def add(self, table: DataFrame) -> None:
        self.parts.append((0, table))
        while len(self.parts) >= self.WIDTH and self.parts[-1][0] == self.parts[-self.WIDTH][0]:
            last = [t for _, t in self.parts[-self.WIDTH :]]
            self.parts[-self.WIDTH :] = [(self.parts[-1][0] + 1, self.rounds.write(reduce(DataFrame.unionByName, last))[0])]
            self.rounds.drop(*last)

    def with_(self, *more: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [*(t for _, t in self.parts), *more])

    def drop(self) -> None:
        self.rounds.drop(*(t for _, t in self.parts))
        self.parts = []


def rounds_of(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], max_rounds: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """What ``semi_naive`` finds in at most ``max_rounds`` rounds, and the facts of the last one (None where nothing is left to do)."""
    rounds = Rounds(seed.sparkSession)
    known = Known(rounds)
    new, n = rounds.write(seed.select(keys).distinct().withColumn("round", F.lit(0)))
    number = 0
    while n:
        if number == max_rounds:
            return known.with_(new), new
        number += 1
        derived = step(new.select(keys)).select(keys).distinct().join(known.with_(new).select(keys), keys, "left_anti")
        fresh, n = rounds.write(derived.withColumn("round", F.lit(number)))
        known.add(new)
        new = fresh
    return known.with_(new), None


def dealt_rounds(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], rounds: Dealt) -> DataFrame:
    """What ``semi_naive`` finds, without ``round``, for seeds in proportion to the whole: ``rounds``, which is for all ``keys``, keeps known facts
    dealt, so that a round deals the facts that it derives and no others."""
    known = Known(rounds)
    new, n = rounds.write(rounds.deal(seed.select(keys)).distinct())
    while n:
        derived = rounds.deal(step(new).select(keys)).distinct()
        for part in [*(t for _, t in known.parts), new]:  # one by one, as a union of them would be dealt again
            derived = derived.join(part, keys, "left_anti")
        fresh, n = rounds.write(derived)
        known.add(new)
        new = fresh
    return known.with_(new)


def semi_naive(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], max_rounds: int | None = None) -> DataFrame:
    """All facts that ``step`` derives from ``seed``, with the round in which each first appeared (``round``).

    ``step`` maps the facts that are new in a round to the facts they imply (columns ``keys``); it must be
    monotone. Only new facts are joined in a round. The loop ends when a round gives nothing new, or with RoundLimitError
    beyond the ``max_rounds`` of a caller that gives it.
    """
    found, left = rounds_of(seed, step, keys, max_rounds)
    if left is not None:
        raise RoundLimitError(f"the fixpoint did not settle in max_rounds={max_rounds} rounds")
    return found
