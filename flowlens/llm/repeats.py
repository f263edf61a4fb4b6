"""Repeated windows of a corpus, routed by content so that each shard can be indexed by itself.

A window is ``window`` consecutive units (words or bytes) of one document. Two equal windows hold the
same minimum n-gram hash at the same offset. Consecutive windows that share that *anchor* form one
segment (at most ``window`` windows long). The steps, all Spark shuffles of packed rows:

1. ``_segments``: each task cuts its documents into segments, aggregates its own equal segments, and
   sends (anchor, content digest, place) to a bucket of the anchor.
2. ``_copies``: a bucket drops anchors that occur once in the corpus (their windows cannot repeat),
   and aggregates equal segments: the earliest is kept for the index, all windows of the others repeat.
3. ``_contents``: the kept segments meet their documents again, by blocks of ids, and send their text
   to the shard of their anchor.
4. ``index`` (given by the operator): finds equal windows among the distinct segments of a shard.
5. ``_finish`` (given by the operator): repeated windows meet their documents, block by block.

A *hot* anchor (one that holds more distinct segments than several buckets' share of a task) is dealt
by content instead: its entries go to salted buckets, its windows one by one to shards by their own
hash. One task never has to hold a whole hot group, and nothing is dropped.

No text decides what equals what by a hash that its writer could know: segments are compared by a 96-bit BLAKE2b
digest under a key drawn for each run, windows of hot anchors and everything in a shard unit by unit. The plain 64-bit
hashes only route.

Rows with one id and one text are one document, whose result each of them gets; rows with one id and
different texts are ordered by a hash of the text. A null id is ordered
after all ids. Ids are integers. Null texts are empty texts.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import blobs, textbytes as tb

NO_ID = np.iinfo(np.int64).max
_LOW = np.uint64((1 << 24) - 1)
_BATCH = ["target", "blob"]
_TYPES = [pa.int32(), pa.binary()]
_SCHEMA = "target int, blob binary"
FLUSH = 1 << 20


@dataclass(frozen=True)
class Spec:
    """What a window is, and how the work is dealt."""

    unit: str  # "word" or "byte"
    window: int
    gram: int
    parts: int  # buckets and blocks
    hot: int = 256  # least number of distinct segments in one task that makes an anchor hot
    key: bytes = field(default_factory=lambda: os.urandom(16), repr=False)  # of the digests of one run

    @property
    def shards(self) -> int:
        """More than buckets, as an index takes several times the memory of its text."""
        return 4 * self.parts

    @property
    def reach(self) -> int:
        return self.window - self.gram + 1


def units(part: tb.Slice, unit: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, tb.Words | None]:
    """Unit hashes of a slice, unit offsets of its texts, a hash of each text, and its words."""
    tags = tb.text_hashes(part)
    if unit == "byte":
        return tb._BYTE[part.data], part.offsets, tags, None
    found = tb.words(part)
    return tb.word_hashes(part, found), found.offsets, tags, found


def spelled(part: tb.Slice, found: tb.Words | None) -> tuple[np.ndarray, np.ndarray]:
    """The units of a slice one after the other, words with one space after each: bytes, and where each unit begins."""
    if found is None:
        return part.data, np.arange(len(part.data) + 1)
    size = found.ends - found.starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 0x20, dtype=np.uint8)
    out[tb.ranges(at[:-1], size)] = part.data[tb.ranges(found.starts, size)]
    return out, at


def layout(part: tb.Slice, unit: str) -> tuple[np.ndarray, tb.Words | None]:
    """Unit offsets of the texts of a slice, and its words."""
    if unit == "byte":
        return part.offsets, None
    found = tb.words(part)
    return found.offsets, found


def tags_of(slices: list[tb.Slice], ids: np.ndarray) -> np.ndarray:
    """A hash of each text; zeros where ids alone tell the rows apart."""
    if len(np.unique(ids)) == len(ids):
        return np.zeros(len(ids), dtype=np.uint64)
    return np.concatenate([np.zeros(0, np.uint64), *(tb.text_hashes(s) for s in slices)])


def block_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return ((ids ^ (ids >> 17) ^ (ids >> 31)) % parts + parts) % parts


def block_column(ids, parts: int):
    """The same as block_of, as a column."""
    mixed = ids.bitwiseXOR(F.shiftright(ids, 17)).bitwiseXOR(F.shiftright(ids, 31))
    return F.pmod(mixed, F.lit(parts)).cast("int")


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.cast(pa.int64()).fill_null(NO_ID))


def once(order: np.ndarray, *columns: np.ndarray) -> np.ndarray:
    """``order`` without entries that equal the one before in all columns (rows given twice)."""
    if len(order) < 2:
        return order
    new = np.zeros(len(order) - 1, dtype=bool)
    for c in columns:
        new |= c[order[1:]] != c[order[:-1]]
    return order[np.concatenate([[True], new])]


def _segments(spec: Spec) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def flush(held: list[tuple], docs: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids, tags = (np.concatenate(x) for x in zip(*docs, strict=True))
        key, content, more, doc, start, count = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(key)
        twin = np.diff(key[order]) == 0  # only entries whose key is not alone need the full order
        at = np.flatnonzero(np.concatenate([twin, [False]]) | np.concatenate([[False], twin]))
        some = order[at]
        order[at] = some[np.lexsort((start[some], tags[doc[some]], ids[doc[some]], more[some], content[some], key[some]))]
        order = once(order, start, tags[doc], ids[doc], key)
        same = (np.diff(key[order]) == 0) & (np.diff(content[order]) == 0) & (np.diff(more[order]) == 0)
        copy = order[1:][same]
        rows = []
        for block, at in blobs.by_target(block_of(ids[doc[copy]], spec.parts)):
            i = copy[at]
            rows.append((-1 - block, blobs.pack(ids[doc[i]], tags[doc[i]], start[i], count[i])))
        keep = order[np.concatenate([[True], ~same])]
        key, content, more, doc, start, count = (x[keep] for x in (key, content, more, doc, start, count))
        least = max(spec.hot, len(key) // spec.parts)
        edges = np.flatnonzero(np.concatenate([[True], np.diff(key) != 0, [True]]))
        sizes = np.diff(edges)
        hot = np.repeat(sizes >= least, sizes)
        target = (np.where(hot, content, key) % np.uint64(spec.parts)).astype(np.int64)
        for bucket, i in blobs.by_target(target):
            u, inv = np.unique(doc[i], return_inverse=True)
            rows.append((bucket, blobs.pack(ids[u], tags[u], inv.astype(np.uint32), key[i], content[i], more[i], start[i], count[i], hot[i])))
        marks = key[edges[:-1][sizes >= least]]
        for bucket, i in blobs.by_target((marks % np.uint64(spec.parts)).astype(np.int64)):
            none = np.zeros(0, dtype=np.uint64)
            rows.append((bucket, blobs.pack(none.view(np.int64), none, none.astype(np.uint32), marks[i])))
        for i in range(0, len(rows), 64):
            yield blobs.table(_BATCH, _TYPES, rows[i : i + 64]).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs, size, first = [], [], 0, 0
        for batch in batches:
            ids = ids_of(batch.column(0))
            for part in tb.text_slices(batch.column(1)):
                values, offsets, tags, found = units(part, spec.unit)
                docs.append((ids[part.first : part.first + len(part)], tags))
                counts = tb.last_whole_window(offsets, spec.window)
                if counts.any():
                    prefix = tb.prefix_hash(values)
                    gram = tb.window_hash(prefix, spec.gram)
                    place = np.arange(len(gram), dtype=np.uint64)
                    least = tb.window_min((gram & ~_LOW) | (place & _LOW), spec.reach)
                    at, doc = tb.ranges(offsets[:-1], counts), tb.expand(counts)
                    anchor = at + ((least[at] - at.astype(np.uint64)) & _LOW).astype(np.int64)
                    new = np.flatnonzero(np.concatenate([[True], (np.diff(anchor) != 0) | (np.diff(doc) != 0)]))
                    count = np.diff(np.append(new, len(at)))
                    at, doc = at[new], doc[new]
                    text, begin = spelled(part, found)
                    content = tb.digests(text, begin[at], begin[at + count + spec.window - 1], spec.key)
                    start = at - offsets[doc]
                    held.append((gram[anchor[new]], *content, doc + first, start.astype(np.uint32 if start.max(initial=0) < 1 << 32 else np.int64), count.astype(np.uint16)))
                    size += len(new)
                first += len(part)
                if size >= FLUSH:
                    yield from flush(held, docs)
                    held, docs, size, first = [], [], 0, 0
        if held:
            yield from flush(held, docs)

    return run


def _copies(spec: Spec) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        if (mine := group["target"][0].as_py()) < 0:  # copies that a task has found already: straight to their block
            rows = [(-1 - mine, blobs.pack(np.array([0]), *blobs.unpack(x.as_buffer()))) for x in group["blob"]]
            return blobs.table(_BATCH, _TYPES, rows)
        parts = blobs.unpack_all(group["blob"])
        marks = np.unique(np.concatenate([np.zeros(0, np.uint64), *(p[3] for p in parts if len(p) == 4)]))
        parts = [p for p in parts if len(p) > 4]
        if not parts:
            return blobs.table(_BATCH, _TYPES, [])
        ids, tags = (np.concatenate([p[i][p[2]] for p in parts]) for i in (0, 1))
        key, content, more, start, count, hot = (np.concatenate([p[i] for p in parts]) for i in (3, 4, 5, 6, 7, 8))
        hot = hot | np.isin(key, marks)
        _, inverse, often = np.unique(key, return_inverse=True, return_counts=True)
        keep = np.flatnonzero((often[inverse] >= 2) | hot)
        ids, tags, key, content, more, start, count, hot = (x[keep] for x in (ids, tags, key, content, more, start, count, hot))
        order = once(np.lexsort((start, tags, ids, more, content, key)), start, tags, ids, key)
        same = np.concatenate([[False], (np.diff(key[order]) == 0) & (np.diff(content[order]) == 0) & (np.diff(more[order]) == 0)]) if len(order) else np.zeros(0, bool)
        rows = []
        copy, first = order[same], order[~same]
        for block, at in blobs.by_target(block_of(ids[copy], spec.parts)):
            i = copy[at]
            rows.append((block, blobs.pack(np.array([0]), ids[i], tags[i], start[i], count[i])))
        for block, at in blobs.by_target(block_of(ids[first], spec.parts)):
            i = first[at]
            rows.append((block, blobs.pack(np.array([1]), ids[i], tags[i], start[i], count[i], key[i], hot[i])))
        return blobs.table(_BATCH, _TYPES, rows)

    return run


def places(ids: np.ndarray, tags: np.ndarray, want_ids: np.ndarray, want_tags: np.ndarray) -> np.ndarray:
    """For each wanted (id, tag) the first row that has it."""
    order = np.lexsort((np.arange(len(ids)), tags, ids))
    sid, stag = ids[order], tags[order]
    both = np.concatenate([sid, want_ids]), np.concatenate([stag, want_tags])
    rank = np.lexsort((np.concatenate([np.zeros(len(sid), np.int8), np.ones(len(want_ids), np.int8)]), both[1], both[0]))
    seen = np.maximum.accumulate(np.where(rank < len(sid), rank, -1))
    out = np.empty(len(want_ids), dtype=np.int64)
    wanted = rank >= len(sid)
    out[rank[wanted] - len(sid)] = seen[wanted]
    # of several rows with one (id, tag) the sort puts the last just before; step back to the first
    first = np.concatenate([[True], (np.diff(sid) != 0) | (np.diff(stag.view(np.int64)) != 0)])
    return order[np.maximum.accumulate(np.where(first, np.arange(len(sid)), 0))[out]]


def _contents(spec: Spec) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        need = [x[1:] for x in blobs.unpack_all(found["blob"]) if x[0][0] == 1]
        if not need or not len(docs):
            return blobs.table(_BATCH, _TYPES, [])
        ids, tags, start, count, key, hot = (np.concatenate(x) for x in zip(*need, strict=True))
        start, count = start.astype(np.int64), count.astype(np.int64)
        all_ids, rows = ids_of(docs["id"]), []
        slices = list(tb.text_slices(docs["text"]))
        all_tags = tags_of(slices, all_ids)
        at = places(all_ids, all_tags, ids, tags if all_tags.any() else np.zeros_like(tags))
        for part in slices:
            mine = np.flatnonzero((at >= part.first) & (at < part.first + len(part)))
            if not len(mine):
                continue
            offsets, found_words = layout(part, spec.unit)
            for heat in (False, True) if hot[mine].any() else (False,):
                i = mine[hot[mine] == heat]
                begin, windows, route = offsets[at[i] - part.first] + start[i], count[i], key[i]
                place = start[i]
                if heat:  # one window at a time, by its own hash
                    each = tb.expand(windows)
                    begin, place = tb.ranges(begin, windows), tb.ranges(place, windows)
                    i, windows = i[each], np.ones(len(each), dtype=np.int64)
                    route = tb.span_hash(tb.prefix_hash(units(part, spec.unit)[0]), begin, begin + spec.window)
                    order = once(np.lexsort((place, tags[i], ids[i], route)), place, tags[i], ids[i])
                    again = np.concatenate([[False], np.diff(route[order]) == 0]) if len(order) else np.zeros(0, bool)
                    of = order[again], order[np.flatnonzero(again) - 1]
                    again[again] = tb.equal_spans(*spelled(part, found_words), *(x for o in of for x in (begin[o], begin[o] + spec.window)))
                    for block, j in blobs.by_target(block_of(ids[i[order[again]]], spec.parts)):
                        k = order[again][j]
                        rows.append((-1 - block, blobs.pack(np.array([0]), ids[i[k]], tags[i[k]], place[k], windows[k].astype(np.uint16))))
                    order = order[~again]
                    i, windows, begin, place, route = (x[order] for x in (i, windows, begin, place, route))
                end = begin + windows + spec.window - 1
                lo, hi = (begin, end) if found_words is None else (found_words.starts[begin], found_words.ends[end - 1])
                for shard, j in blobs.by_target((route % np.uint64(spec.shards)).astype(np.int64)):
                    size = hi[j] - lo[j]
                    text = part.data[tb.ranges(lo[j], size)]
                    rows.append((shard, blobs.pack(ids[i[j]], tags[i[j]], place[j].astype(np.int64), size.astype(np.uint32), text)))
        return blobs.table(_BATCH, _TYPES, rows)

    return run


def _shard(spec: Spec, index: Callable) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        if (mine := group["target"][0].as_py()) < 0:  # windows whose repeats were met on the way
            return pa.table([pa.array([-1 - mine] * len(group), pa.int32()), group["blob"]], names=_BATCH)
        parts = blobs.unpack_all(group["blob"])
        ids, tags, place, size = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:4])
        text = np.concatenate([p[4] for p in parts])
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        order = once(np.lexsort((size, place, tags, ids)), size, place, tags, ids)  # now earlier in the array is earlier in the corpus
        text = text[tb.ranges(begin[order], size[order])]
        segment, offset = index(text, np.concatenate([[0], np.cumsum(size[order])]), spec)
        ids, tags, place = ids[order], tags[order], place[order]
        start = place[segment] + offset
        rows = []
        for block, i in blobs.by_target(block_of(ids[segment], spec.parts)):
            one = np.ones(len(i), dtype=np.uint16)
            rows.append((block, blobs.pack(np.array([0]), ids[segment[i]], tags[segment[i]], start[i], one)))
        return blobs.table(_BATCH, _TYPES, rows)

    return run


def _finish(spec: Spec, passed: list[str], render: Callable) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        spans = [x[1:] for x in blobs.unpack_all(found["blob"]) if x[0][0] == 0]
        empty = np.zeros(0, dtype=np.int64)
        ids, tags, start, count = (np.concatenate(x).astype(np.uint64 if i == 1 else np.int64) for i, x in enumerate(zip(*spans, strict=True))) if spans else (empty, empty.astype(np.uint64), empty, empty)
        all_ids, out = ids_of(docs["id"]), []
        slices = list(tb.text_slices(docs["text"]))
        all_tags = tags_of(slices, all_ids)
        if not all_tags.any():
            tags = np.zeros(len(ids), dtype=np.uint64)
        first = places(all_ids, all_tags, all_ids, all_tags) if len(all_ids) else empty
        at = places(all_ids, all_tags, ids, tags) if len(ids) else empty
        by_row = np.argsort(at, kind="stable")
        edges = np.searchsorted(at[by_row], np.arange(len(all_ids) + 1))
        for part in slices:
            offsets, found_words = layout(part, spec.unit)
            row = first[part.first : part.first + len(part)]
            many = edges[row + 1] - edges[row]
            i = by_row[tb.ranges(edges[row], many)]
            begin = np.repeat(offsets[:-1], many) + start[i]
            change = np.zeros(offsets[-1] + 1, dtype=np.int64)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + count[i] + spec.window - 1, -1)
            gone = np.cumsum(change)[:-1] > 0
            out.append(render(part, offsets, found_words, gone))
        columns = [pa.concat_arrays([x[k] for x in out]) if out else pa.array([], t) for k, t in enumerate(RENDERED_TYPES)]
        return pa.table([*(docs[c] for c in passed), *columns], names=[*passed, *RENDERED])

    return run


RENDERED = ["n_units", "n_removed", "removed", "kept"]
RENDERED_TYPES = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
RENDERED_DDL = "n_units bigint, n_removed bigint, removed array<struct<start:bigint,end:bigint>>, kept binary"


def summary(offsets: np.ndarray, gone: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Units, removed units, and maximal removed runs (half-open, in units of the text) of each text."""
    total = np.concatenate([[0], np.cumsum(gone)])
    cut = np.zeros(len(gone) + 1, dtype=bool)
    cut[offsets] = True
    begin = gone.copy()
    begin[1:] &= ~gone[:-1] | cut[1:-1]
    end = gone.copy()
    end[:-1] &= ~gone[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    at = np.searchsorted(starts, offsets)
    base = np.repeat(offsets[:-1], np.diff(at))
    spans = pa.StructArray.from_arrays([pa.array(starts - base, pa.int64()), pa.array(ends - base, pa.int64())], ["start", "end"])
    return pa.array(np.diff(offsets), pa.int64()), pa.array(total[offsets[1:]] - total[offsets[:-1]], pa.int64()), pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)


def binaries(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Byte strings from their concatenation."""
    big = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return big.cast(pa.binary())


def remove_repeats(docs: DataFrame, spec: Spec, index: Callable, render: Callable, id_col: str, text_col: str) -> DataFrame:
    """All columns of ``docs`` and RENDERED (prefixed by ``dedup_`` so that no name clashes)."""
    names = docs.columns
    source = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"),
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c not in (id_col, text_col)], F.col(id_col).alias("own_id"),
    )
    passed = [f"c{i}" for i, c in enumerate(names) if c not in (id_col, text_col)] + ["own_id", "text"]
    blocks = source.withColumn("target", block_column(F.col("id"), spec.parts))
    cut = source.select("id", "text").mapInArrow(_segments(spec), _SCHEMA)
    found = cut.groupBy("target").applyInArrow(_copies(spec), _SCHEMA)
    grouped = blocks.groupBy("target")
    contents = grouped.cogroup(found.groupBy("target")).applyInArrow(_contents(spec), _SCHEMA)
    repeats = contents.groupBy("target").applyInArrow(_shard(spec, index), _SCHEMA)
    types = {f.name: f.dataType.simpleString() for f in source.schema}
    ddl = ", ".join(f"{c} {types[c]}" for c in passed) + ", " + RENDERED_DDL
    done = grouped.cogroup(found.unionByName(repeats).groupBy("target")).applyInArrow(_finish(spec, passed, render), ddl)
    back = {id_col: "own_id", text_col: "text"} | {c: f"c{i}" for i, c in enumerate(names) if c not in (id_col, text_col)}
    return done.select(*[F.col(back[c]).alias(c) for c in names], *[F.col(r).alias(f"dedup_{r}") for r in RENDERED])


def parts_for(docs: DataFrame) -> int:
    """Buckets and blocks: an odd number, about one for each shuffle partition."""
    return int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) | 1
