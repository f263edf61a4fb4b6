"""Packing of token sequences: shortest-pack-first over the length histogram.

Each document's ids (with an end id) are cut into full pieces of ``size`` ids and one shorter rest.
The histogram of piece lengths has at most ``size`` entries, so the plan is made on the driver from it
alone: lengths are placed longest first; each takes the packing pattern with the most room left (the
shortest pack), as often as both counts allow, and patterns carry counts, not documents. Then patterns
meet the pieces again by rank: the r-th piece of a length takes the r-th slot that the patterns hold
for that length. Ranks are numbered inside each task's part and offset by the parts before it, so a
length that a third of all pieces share is never gathered.

Defined results: null text is empty text, whose document is the end id alone; repeated rows are
documents of their own; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import bpe
from flowlens.llm.lineage import written

SIZE = 4096
END_ID = 2

_PIECES = "part int, id bigint, start bigint, length int, crc bigint, doc_tokens bigint, local bigint"


def plan(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in order, how many sequences follow them) for all pieces of the histogram.

    Open patterns are kept by room; a length takes the roomiest, which splits if it holds more
    sequences than there are pieces left.
    """
    done: list[tuple[tuple[int, ...], int]] = []
    rooms: list[int] = []  # a heap of -room, once for each room that has open patterns
    open_patterns: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(pattern: tuple[int, ...], count: int, room: int) -> None:
        if not room:
            done.append((pattern, count))
            return
        if not open_patterns.get(room):
            heapq.heappush(rooms, -room)
        open_patterns.setdefault(room, []).append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = -rooms[0] if rooms else 0
            if room < length:  # one by one, each new pack is the shortest until it is full of this length
                full = size // length
                if left >= full:
                    put((length,) * full, left // full, size - full * length)
                if left % full:
                    put((length,) * (left % full), 1, size - left % full * length)
                break
            pattern, count = open_patterns[room].pop()
            if not open_patterns[room]:
                heapq.heappop(rooms)
            used = min(count, left)
            if count > used:
                put(pattern, count - used, room)
            put((*pattern, length), used, room - length)
            left -= used
    return done + [x for patterns in open_patterns.values() for x in patterns]


def slots(patterns: list[tuple[tuple[int, ...], int]], size: int) -> dict[str, np.ndarray]:
    """For each length, in the order of its ranks: first rank, first sequence, offset of each run of slots."""
    rows, taken, base = [], {}, 0
    for pattern, count in patterns:
        at = 0
        for length in pattern:
            first = taken.get(length, 0)
            rows.append((length, first, base, at))
            taken[length] = first + count
            at += length
        base += count
    length, first, sequence, offset = (np.array(x, dtype=np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 4
    return {"length": length, "first": first, "sequence": sequence, "offset": offset}


def _pieces(vocabulary: str, size: int, end_id: int):
    tail = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, dtype=np.int64)
        tokens = bpe.load(vocabulary)
        for batch in batches:
            for first in range(0, len(batch), 2048):
                rows = []
                for i, ids in zip(batch.column(0).slice(first, 2048).to_pylist(), tokens.encode_many(batch.column(1).slice(first, 2048).to_pylist()), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    for start in range(0, n, size):
                        piece = ids[4 * start : 4 * (start + size)]
                        length = len(piece) // 4
                        rows.append((part, i, start, length, zlib.crc32(piece), n, int(seen[length])))
                        seen[length] += 1
                columns = zip(*rows, strict=True)
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["part", "id", "start", "length", "crc", "doc_tokens", "local"])

    return run


def _place(table: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.int64(1) << 40
        keys = table["length"] * wide + table["first"]
        for batch in batches:
            length, rank = np.asarray(batch.column(2)).astype(np.int64), np.asarray(batch.column(5))
            at = np.searchsorted(keys, length * wide + rank, "right") - 1
            sequence = table["sequence"][at] + rank - table["first"][at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(table["offset"][at])], names=["id", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"]
            )

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row for each piece: id (named as given), start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(source.mapInArrow(_pieces(vocabulary or bpe.default_vocabulary(), size, end_id), _PIECES))
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    table = slots(plan(histogram, size), size)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["part", "length"]).select("id", "start", "length", "crc", "doc_tokens", (F.col("local") + F.col("before")).alias("rank"))
    placed = ranked.mapInArrow(_place(table), "id bigint, start bigint, length int, crc bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
    return placed.select(F.col("id").alias(id_col), "start", F.col("length").cast("bigint").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
