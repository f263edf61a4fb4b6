"""Near-duplicate vectors by spherical-cap filters.

Filter directions are a random product code: after a random rotation the coordinates fall into blocks,
each block has a random code of unit vectors, and a direction is one code word of each block. A vector
goes to every direction whose inner product with it exceeds a threshold; these are list-decoded from the
blocks' scores (only code words that can still reach the threshold are combined), so the directions,
which grow with the table, are never scanned. Vectors that share a filter are compared in double
precision, each pair in the first filter that both share, and links are counted there.

Equal vectors of one label are one class first. Classes meet per (label, filter); a crowded filter is cut
into chunks, and every pair of chunks is a task of its own, so no task holds a whole hot filter.

The directions' number follows the table's size (a count), so filters keep their mean size (up to 2^31 of them; vectors
of fewer than 24 components have at most 4,096, as their links are dense). The threshold is the height of the
cap that gives each vector so many filters on average, and a vector that exceeds fewer than half as many
takes its best ones instead. How many they are is found by trial: from ``per_vector`` on, until pairs just at the
cosine that links miss each other with a probability of at most ``MISS``, whatever the number of components. Recall is
measured against brute force in the tests.

Defined results: vectors that are null, zero, or hold null or non-finite components, and vectors with a
null label, link with nothing; rows with the same id, or without one, are vectors of their own, each with its own
links; null ids are ordered after all ids; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.components import components
from flowlens.llm.lineage import written
from flowlens.llm.repeats import NO_ID

THRESHOLD = 0.93
PER_VECTOR = 24  # at least
MISS, PROBES = 0.004, 2000
CROWD = 1024


class ProductCode:
    """Directions made of one code word for each block of coordinates, and the list decoder.

    Vectors of few coordinates have one block (a block of one or two coordinates has hardly any directions),
    others two, and three where two of 4,096 words are fewer than ``directions``.
    """

    def __init__(self, size: int, directions: int, per_vector: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.rotation = np.linalg.qr(rng.standard_normal((size, size)))[0]
        blocks = 1 if size < 24 else 2 if directions <= 4096**2 else 3
        self.words = int(max(16, min((4096, 4096, 1290)[blocks - 1], math.ceil(round(directions ** (1 / blocks), 6)))))
        self.total, self.per_vector = self.words**blocks, min(per_vector, self.words**blocks)
        self.edges = [size * b // blocks for b in range(blocks + 1)]
        self.codes = []
        for width in np.diff(self.edges).tolist():
            code = rng.standard_normal((self.words, width))
            self.codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) / math.sqrt(blocks))
        self.threshold = cap_height(size, self.per_vector / self.total)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted numbers of its filters."""
        turned = unit @ self.rotation
        scores = [turned[:, a:b] @ c.T for a, b, c in zip(self.edges[:-1], self.edges[1:], self.codes, strict=True)]
        order = [np.argsort(-s, axis=1) for s in scores]
        scores = [np.take_along_axis(s, o, axis=1) for s, o in zip(scores, order, strict=True)]
        best = np.stack([s[:, 0] for s in scores], axis=1)
        after = best[:, ::-1].cumsum(axis=1)[:, ::-1] - best  # what the blocks after each can add at most
        out = []
        for i in range(len(unit)):
            sums, names = np.zeros(1), np.zeros(1, dtype=np.int64)
            for s, o, more in zip(scores, order, after[i], strict=True):  # only what can still reach the threshold goes on
                many = np.searchsorted(-s[i], sums + more - self.threshold, "right")
                a = np.repeat(np.arange(len(sums)), many)
                b = np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
                sums, names = sums[a] + s[i][b], names[a] * self.words + o[i][b]
            if len(names) * 2 < self.per_vector:  # too few exceed it: the best ones
                sums, names = np.zeros(1), np.zeros(1, dtype=np.int64)
                for s, o in zip(scores, order, strict=True):
                    top = min(self.words, self.per_vector)
                    both, numbers = (sums[:, None] + s[i][None, :top]).ravel(), (names[:, None] * self.words + o[i][None, :top]).ravel()
                    first = np.argpartition(-both, min(self.per_vector, len(both)) - 1)[: self.per_vector]
                    sums, names = both[first], numbers[first]
            out.append(np.sort(names))
        return out


def cap_height(size: int, share: float) -> float:
    """The inner product with a fixed direction that ``share`` of all unit vectors exceed: by bisection over
    the cap's area, an integral of (1 - t^2)^((size - 3) / 2)."""
    if size == 1:
        return 0.0
    angle = np.linspace(0, math.pi, 200_001)
    area = np.concatenate([[0.0], np.cumsum(np.sin((angle[1:] + angle[:-1]) / 2) ** (size - 2))])
    return float(np.cos(np.interp(min(0.5, share) * area[-1], area, angle)))


@lru_cache(16)
def product_code(size: int, directions: int, threshold: float, per_vector: int, miss: float = MISS) -> ProductCode:
    """The code for vectors of ``size`` components: filters for each vector are doubled from ``per_vector`` until, of random
    pairs whose cosine is the threshold, a share of at most ``miss`` has no filter in common. The same in every task."""
    rng = np.random.default_rng(7)
    a, side = rng.standard_normal((2, PROBES, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side -= (side * a).sum(axis=1, keepdims=True) * a
    length = np.linalg.norm(side, axis=1, keepdims=True)
    b = threshold * a + math.sqrt(1 - threshold**2) * side / np.where(length > 1e-9, length, 1)
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    while True:
        code = ProductCode(size, directions, per_vector)
        missed = sum(not np.isin(x, y, assume_unique=True).any() for x, y in zip(code.decode(a), code.decode(b), strict=True))
        if missed <= miss * PROBES or per_vector * 2 > code.total:
            return code
        per_vector = per_vector * 3 // 2


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _filters(directions: int, per_vector: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(2))
            for size in np.unique(sizes).tolist():
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                vectors = _matrix(part.column(3)).astype(np.float64)
                vectors /= np.abs(vectors).max(axis=1, keepdims=True)
                found = product_code(size, directions, threshold, per_vector).decode(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))
                ends = np.cumsum([0, *map(len, found)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*batch.schema.names, "filters"])

    return run


def _pair(vectors, norms, earlier, copies, left, right, threshold, links, labels) -> None:
    """Counts the links between the rows of ``left`` and ``right`` (the same, or disjoint) that no earlier
    filter holds, and spreads the smallest label over all their links."""
    close = (vectors[left] @ vectors[right].T) / (norms[left][:, None] * norms[right][None, :]) >= threshold
    same = left is right
    if same:
        np.fill_diagonal(close, False)
    if not close.any():
        return
    counted = close & ~((earlier[left] @ earlier[right].T) > 0) if earlier.shape[1] else close
    links[left] += counted @ copies[right]
    if not same:
        links[right] += copies[left] @ counted
    while True:
        low = np.where(close, labels[right][None, :], np.iinfo(np.int64).max)
        new_left = np.minimum(labels[left], low.min(axis=1))
        low = np.where(close, new_left[:, None], np.iinfo(np.int64).max)
        new_right = np.minimum(labels[right], low.min(axis=0))
        if np.array_equal(new_left, labels[left]) and np.array_equal(new_right, labels[right]):
            return
        labels[left] = new_left
        labels[right] = np.minimum(labels[right], new_right)


def _compare(threshold: float):
    """Links of the (label, filter, chunk pair) groups of one bucket: for each class its counted links
    and the smallest class of its part of the group."""

    def run(table: pa.Table) -> pa.Table:
        columns = {c: table[c].to_numpy() for c in ("group", "filter", "side", "rep", "copies", "size")}
        order = np.lexsort((columns["rep"], columns["filter"], columns["group"]))
        cuts = np.flatnonzero((np.diff(columns["group"][order]) != 0) | (np.diff(columns["filter"][order]) != 0)) + 1
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        filters = table["filters"].combine_chunks()
        ends, values = np.asarray(filters.offsets), np.asarray(filters.values)
        vector = table["vector"].combine_chunks()
        starts, numbers = np.asarray(vector.offsets), np.asarray(vector.values)
        for rows in np.split(order, cuts):
            if len(rows) < 2:
                continue
            f, size = columns["filter"][rows[0]], columns["size"][rows[0]]
            vectors = numbers[starts[rows][:, None] + np.arange(size)[None, :]].astype(np.float64)
            vectors /= np.abs(vectors).max(axis=1, keepdims=True)
            norms = np.linalg.norm(vectors, axis=1)
            # which filters before this one each row has, of those that two rows share
            own = np.repeat(np.arange(len(rows)), ends[rows + 1] - ends[rows])
            each = np.concatenate([values[ends[r] : ends[r + 1]] for r in rows])
            own, each = own[each < f], each[each < f]
            distinct, name, often = np.unique(each, return_inverse=True, return_counts=True)
            shared = np.flatnonzero(often > 1)
            earlier = np.zeros((len(rows), len(shared)), dtype=np.float32)
            keep = often[name] > 1
            earlier[own[keep], np.searchsorted(shared, name[keep])] = 1
            rep, copies, side = (columns[c][rows] for c in ("rep", "copies", "side"))
            links, labels = np.zeros(len(rows), dtype=np.int64), rep.copy()
            if (side < 0).all():
                every = np.arange(len(rows))
                _pair(vectors, norms, earlier, copies, every, every, threshold, links, labels)
            else:
                _pair(vectors, norms, earlier, copies, np.flatnonzero(side == 0), np.flatnonzero(side == 1), threshold, links, labels)
            some = np.flatnonzero((links > 0) | (labels != rep))
            out.append((rep[some], links[some], labels[some]))
        rep, links, least = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"rep": rep, "links": links, "least": least})

    return run


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, per_vector: int = PER_VECTOR, crowd: int = CROWD) -> DataFrame:
    """One row for each row of ``vectors``: id (named as given), n_links, component_id, kept."""
    spark = vectors.sparkSession
    v = F.col("vector")
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "array<float>" if element == "float" else "array<double>"  # compared in double precision either way
    source = vectors.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast(kind).alias("vector")
    )
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    fit = v.isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    source = source.withColumn("fit", fit)
    repeated = not source.groupBy("id").count().where("count > 1").isEmpty()
    if repeated:  # ids do not tell rows apart: number them in the order of ids
        rows = written(source.repartitionByRange("id").sortWithinPartitions("id").withColumn("row", F.monotonically_increasing_id()))
    else:
        rows = written(source.withColumn("row", F.col("id")))
    classes = rows.where("fit").groupBy("label", "vector").agg(F.min("row").alias("rep"), F.count("*").alias("copies"))
    total = rows.count()
    shaped = classes.select("rep", "copies", F.size("vector").alias("size"), "vector", F.xxhash64("label", F.size("vector")).alias("group"), "label")
    ddl = f"rep bigint, copies bigint, size int, vector {kind}, `group` bigint, label string, filters array<int>"
    placed = written(shaped.mapInArrow(_filters(max(256, total), per_vector, threshold), ddl))
    spread = placed.select("rep", "group", F.explode("filters").alias("filter"))
    counts = spread.groupBy("group", "filter").agg(F.count("*").alias("members")).where("members > 1")
    met = spread.join(counts, ["group", "filter"])
    chunks = F.ceil(F.col("members") / crowd).cast("int")
    mine = F.pmod(F.xxhash64("rep", "filter"), chunks).cast("int")
    pairs = F.when(chunks <= 1, F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(-1).alias("side")))).otherwise(
        F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(j, mine).alias("lo"), F.greatest(j, mine).alias("hi"), F.when(j == mine, -1).when(mine < j, 0).otherwise(1).alias("side")))
    )
    dealt = met.select("rep", "group", "filter", F.explode(pairs).alias("p"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    target = F.pmod(F.xxhash64("group", "filter", "p.lo", "p.hi"), F.lit(parts)).cast("int").alias("target")
    dealt = dealt.select(F.xxhash64("group", "p.lo", "p.hi").alias("group2"), F.col("group").alias("own"), "filter", "p.side", "rep", target)
    full = dealt.join(placed.select("rep", F.col("group").alias("own"), "copies", "size", "vector", "filters"), ["rep", "own"])
    full = full.select("target", F.col("group2").alias("group"), "filter", "side", "rep", "copies", "size", "vector", "filters")
    found = written(full.groupBy("target").applyInArrow(_compare(threshold), "rep bigint, links bigint, least bigint"))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    labels = components(found.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    members = rows.join(classes.select("label", "vector", "rep", "copies"), ["label", "vector"], "left")
    out = members.join(links, "rep", "left").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    out = out.select("id", "row", "copies", "links", F.coalesce("component", "rep", "row").alias("low"))
    if repeated:
        out = out.join(rows.select(F.col("row").alias("low"), F.col("id").alias("low_id")), "low")
    else:
        out = out.withColumn("low_id", F.col("low"))
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.when(F.col("low_id") != NO_ID, F.col("low_id")).alias("component_id"), (F.col("row") == F.col("low")).alias("kept"),
    )
