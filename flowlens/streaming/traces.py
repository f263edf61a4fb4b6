"""Traces as streams: events that a running program appends to files of a directory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
DICTIONARY = "user_id bigint, node string, node_id bigint"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the event files under ``path`` (a folder or a pattern)."""
    return spark.readStream.schema(EVENT).parquet(path)


def node_counts(events: DataFrame) -> DataFrame:
    """(node, n): how often each node was met so far."""
    return events.groupBy(F.col("event_type").alias("node")).agg(F.count("*").alias("n"))


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least event_id of each (user, node) of each batch."""
    for batch in batches:
        least = pa.Table.from_batches([batch]).group_by(["user_id", "node"]).aggregate([("event_id", "min")])
        yield from least.select(["user_id", "node", "event_id_min"]).rename_columns(["user_id", "node", "first"]).combine_chunks().to_batches()


def _dictionary(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    nodes = list(state.get[0]) if state.exists else []
    known, firsts = set(nodes), {}
    for batch in batches:
        for node, first in zip(batch["node"], batch["first"], strict=True):
            if node not in known:
                firsts[node] = min(first, firsts.get(node, first))
    fresh = sorted(firsts, key=firsts.__getitem__)
    state.update((nodes + fresh,))
    yield pd.DataFrame({"user_id": [key[0]] * len(fresh), "node": fresh, "node_id": range(len(nodes), len(nodes) + len(fresh))})


def node_dictionary(events: DataFrame) -> DataFrame:
    """(user_id, node, node_id): dense first-seen ids of nodes for each user, kept as state between batches.

    Only the least event_id of each (user, node) of a batch moves, so a user of very many events is no large group.
    """
    firsts = events.select("user_id", F.col("event_type").alias("node"), "event_id").mapInArrow(_firsts, "user_id bigint, node string, first bigint")
    return firsts.groupBy("user_id").applyInPandasWithState(_dictionary, DICTIONARY, "nodes array<string>", "append", "NoTimeout")


def encode_events(events: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(user_id, event_id, node_id) of events whose nodes the dictionary knows."""
    known = dictionary.select(F.col("user_id").alias("u"), "node", "node_id")
    return events.join(known, F.col("user_id").eqNullSafe(F.col("u")) & F.col("event_type").eqNullSafe(F.col("node"))).select("user_id", "event_id", "node_id")
