"""Hard negatives by vantage-point trees over norm-augmented vectors.

With M the greatest norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and an anchor q becomes (q, 0): the squared
distance of the two is |q|^2 + M^2 - 2 q.x, so a higher inner product is a smaller distance, and a window of
scores is an annulus around the anchor.

* Each task builds vantage-point trees over its rows, in chunks, and writes them to the shared folder.
* Anchors go to all trees in blocks of bounded size; a task walks its trees for a whole block at once. Bounds of
  each leaf's distance to each anchor follow from the distances of anchor and leaf to the vantage points above
  it. Every anchor then takes its leaves nearest first, none that lies outside the annuli of all its windows,
  and stops once no leaf left can hold a better row. A task sends the best rows of all its trees, at most
  ``positives`` (times ``negatives``) for each anchor, and Spark ranks them.
* First the positives are searched (rows of the anchor's label), then their score windows among other labels.

Vectors become integers ``floor(scale * x)`` and scores are exact; distances only decide what is skipped, with a
margin for their rounding.

Defined results: rows with a null id, a null label, a vector that is null or holds null or non-finite
components take no part; rows with one id are rows of their own, each an anchor or a partner by itself; equal
scores go by the smaller id; rows of other lengths than an anchor's are no partners of it; an anchor without a positive, a positive
without a negative and an empty table give no rows; other columns are ignored. Scores too large for 64 bits raise ValueError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm import blobs
from flowlens.llm.lineage import Tables
from flowlens.llm.vector_codes import fit_vectors, integers

SCALE, POSITIVES, NEGATIVES = 256, 5, 10
LOW, HIGH = 30, 90  # percent of the positive's score
LEAF = 64
CHUNK_ROWS, CHUNK = 1 << 14, 1 << 21
BLOCK = 1 << 22  # numbers held for one block of anchors: their components and their bounds in a tree
NONE = np.iinfo(np.int64).min


class Tree:
    """A vantage-point tree. Node i of level l holds the rows from ``n * i >> l`` to ``n * (i + 1) >> l``;
    ``point`` is the row its children are told apart by, ``near`` and ``far`` bound the rows' distance to their
    parent's point. Rows keep their own number, id and label (its value, or the 64-bit hash of one that is no integer)."""

    def __init__(self, vectors, rows, ids, labels, points, near, far, top):
        self.vectors, self.rows, self.ids, self.labels = vectors, rows, ids, labels
        self.points, self.near, self.far, self.top = points, near, far, top
        self.depth = len(points)

    @staticmethod
    def edges(n: int, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level

    @classmethod
    def build(cls, vectors: np.ndarray, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, top: float) -> Tree:
        n = len(vectors)
        wide = augmented(vectors, top)
        order, depth = np.arange(n), max(0, (n // LEAF).bit_length() - 1)
        points, near, far = [], [], []
        # the root's vantage point is the row farthest from the middle, a child's the one farthest from its parent's
        at = np.array([int(np.argmax(((wide - wide.mean(axis=0)) ** 2).sum(axis=1)))])
        for level in range(depth):
            node = np.repeat(np.arange(1 << level), np.diff(cls.edges(n, level)))
            away = np.sqrt(((wide[order] - wide[at[node]]) ** 2).sum(axis=1))
            turn = np.lexsort((away, node))
            order, away = order[turn], away[turn]
            points.append(at)
            edges = cls.edges(n, level + 1)
            near.append(away[edges[:-1]])
            far.append(away[edges[1:] - 1])
            at = order[edges[1:] - 1]
        return cls(vectors[order], rows[order], ids[order], labels[order], [np.argsort(order)[p] for p in points], near, far, top)

    def pack(self) -> bytes:
        empty = np.zeros(0)
        join = lambda many: np.concatenate([empty, *many])
        return blobs.pack(np.array([len(self.rows), self.vectors.shape[1], self.depth]), self.vectors.astype(np.int32).ravel(), self.rows, self.ids, self.labels, join(self.points).astype(np.int32), join(self.near), join(self.far), np.array([self.top]))

    @classmethod
    def unpack(cls, blob) -> Tree:
        head, vectors, rows, ids, labels, points, near, far, top = blobs.unpack(blob)
        n, size, depth = head.tolist()
        split = lambda x, first: [x[first * ((1 << level) - 1) : first * ((1 << level + 1) - 1)] for level in range(depth)]
        return cls(vectors.reshape(n, size), rows, ids, labels, split(points, 1), split(near, 2), split(far, 2), float(top[0]))

    def leaves(self, wide: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(anchor, leaf) least and greatest distance that a row of the leaf can have."""
        low, high = np.zeros((len(anchors), 1)), np.full((len(anchors), 1), np.inf)
        for point, near, far in zip(self.points, self.near, self.far, strict=True):
            v = wide[point]
            away = np.sqrt(np.maximum((anchors * anchors).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2 * anchors @ v.T, 0))
            away, low, high = (np.repeat(x, 2, axis=1) for x in (away, low, high))
            low = np.maximum(low, np.maximum(away - far[None, :], near[None, :] - away))
            high = np.minimum(high, away + far[None, :])
        return low, high


def augmented(vectors: np.ndarray, top: float) -> np.ndarray:
    v = vectors.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))[:, None]], axis=1)


class Search:
    """The best partners of a block of anchors, carried from tree to tree: for each anchor and window the ``k`` rows
    of highest score, then of smallest id, whose score lies within the window."""

    def __init__(self, vectors: np.ndarray, rows: np.ndarray, labels: np.ndarray, least: np.ndarray, most: np.ndarray, k: int, same: bool):
        self.vectors, self.rows, self.labels, self.least, self.most, self.k, self.same = vectors, rows, labels, least, most, k, same
        self.best = np.full((*least.shape, k), NONE)  # scores, highest first
        self.who = np.full((*least.shape, k), np.iinfo(np.int64).max)  # their ids
        self.row = np.full((*least.shape, k), -1)

    def visit(self, tree: Tree) -> None:
        n, size = tree.vectors.shape
        if size != self.vectors.shape[1]:
            return
        exact = np.float64 if tree.top < 1 << 53 else np.int64  # sums of products stay below ``top``
        wide = augmented(tree.vectors, tree.top)
        low, high = tree.leaves(wide, np.pad(self.vectors.astype(np.float64), ((0, 0), (0, 1))))
        margin = 1e-5 * (1 + np.sqrt(tree.top))
        base = (self.vectors.astype(np.float64) ** 2).sum(axis=1) + tree.top
        ring = lambda score, of: np.sqrt(np.maximum(base[of][:, None] - 2 * score.astype(np.float64), 0))
        every = np.arange(len(base))
        # nearest and farthest distance of each window
        inner, outer = ring(self.most, every), np.where(self.least <= self.most, ring(self.least, every), -np.inf)
        edges = Tree.edges(n, tree.depth)
        widest = int(np.diff(edges).max())
        order = np.argsort(low, axis=1, kind="stable")
        live = np.arange(len(self.vectors))
        for step in range(order.shape[1]):
            leaf = order[live, step]
            at = low[live, leaf] - margin
            last = self.best[live, :, -1]
            reach = np.where(last == NONE, outer[live], np.minimum(outer[live], ring(last, live)))
            live_still = (at[:, None] <= reach).any(axis=1)  # leaves come nearest first: no later one is nearer
            live, leaf, at, reach = live[live_still], leaf[live_still], at[live_still], reach[live_still]
            if not len(live):
                return
            wanted = ((at[:, None] <= reach) & (high[live, leaf][:, None] + margin >= inner[live])).any(axis=1)
            mine, leaf = live[wanted], leaf[wanted]
            slab = max(1, CHUNK // (widest * max(size, 1)))
            for at in range(0, len(mine), slab):
                part = slice(at, at + slab)
                self._score(tree, mine[part], edges[leaf[part]], edges[leaf[part] + 1], widest, exact)

    def _score(self, tree: Tree, mine: np.ndarray, begin: np.ndarray, end: np.ndarray, widest: int, exact) -> None:
        at = begin[:, None] + np.arange(widest)[None, :]
        there = at < end[:, None]
        at = np.minimum(at, len(tree.rows) - 1)
        score = np.matmul(tree.vectors[at].astype(exact), self.vectors[mine].astype(exact)[:, :, None])[:, :, 0].astype(np.int64)
        fits = there & (tree.rows[at] != self.rows[mine][:, None]) & ((tree.labels[at] == self.labels[mine][:, None]) == self.same)
        for w in range(self.least.shape[1]):
            good = fits & (score >= self.least[mine, w][:, None]) & (score <= self.most[mine, w][:, None])
            some = np.flatnonzero((good & (score >= self.best[mine, w, -1][:, None])).any(axis=1))
            if not len(some):
                continue
            i = mine[some]
            scores = np.concatenate([self.best[i, w], np.where(good[some], score[some], NONE)], axis=1)
            ids = np.concatenate([self.who[i, w], np.where(good[some], tree.ids[at[some]], np.iinfo(np.int64).max)], axis=1)
            rows = np.concatenate([self.row[i, w], np.where(good[some], tree.rows[at[some]], -1)], axis=1)
            first = np.lexsort((rows, ids, -np.maximum(scores, NONE + 1)), axis=1)[:, : self.k]
            self.best[i, w], self.who[i, w], self.row[i, w] = (np.take_along_axis(x, first, axis=1) for x in (scores, ids, rows))

    def found(self) -> pa.RecordBatch:
        anchor, window, place = np.nonzero(self.row >= 0)
        i = anchor, window, place
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (self.rows[anchor], window, self.best[i], self.who[i], self.row[i])], names=["anchor", "slot", "score", "id", "row"])


_FOUND = "anchor bigint, slot bigint, score bigint, id bigint, row bigint"


def _trees(scale: int, top: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def build(size: int) -> pa.RecordBatch:
            row, ids, vector, label, is_anchor = (pa.chunked_array([b.column(c) for b in held[size]]).combine_chunks() for c in (0, 1, 2, 3, 5))
            numbers, row = integers(vector, scale), np.asarray(row)
            of = np.flatnonzero(np.asarray(is_anchor))
            tree = Tree.build(numbers, row, np.asarray(ids), np.asarray(label), top)
            held[size] = []
            mine = blobs.pack(numbers[of].ravel(), row[of], np.asarray(ids)[of], np.asarray(label)[of])
            return pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([tree.pack()], pa.binary()), pa.array([len(of)], pa.int64()), pa.array([mine], pa.binary())], names=["size", "tree", "n_anchors", "anchors"])

        for batch in batches:
            sizes = np.asarray(batch.column(4))
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                step = max(1, min(CHUNK_ROWS, CHUNK // max(size, 1)))
                for at in range(0, len(rows), step):
                    part = batch.take(pa.array(rows[at : at + step]))
                    if sum(map(len, held.get(size, []))) + len(part) > step:
                        yield build(size)
                    held.setdefault(size, []).append(part)
        for size in list(held):
            if held[size]:
                yield build(size)

    return run


def _search(block: tuple[np.ndarray, ...], k: int, same: bool):
    """Partners of the anchors of a broadcast ``block`` (vectors, rows, labels, least, most) in all trees of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*block.value, k, same)
        for batch in batches:
            for blob in batch.column(0):
                search.visit(Tree.unpack(blob.as_buffer()))
        found = search.found()
        for at in range(0, len(found), 1 << 16):
            yield found.slice(at, 1 << 16)

    return run


def _ranked(found: DataFrame, k: int, *keys: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _blocks(trees: DataFrame, size: int) -> list[list[str]]:
    """The trees whose anchors make a block of bounded size, as lists of their numbers."""
    counts = trees.where((F.col("size") == size) & (F.col("n_anchors") > 0)).select("tree_id", "n_anchors").orderBy("tree_id").collect()
    out, room = [], -1
    for r in counts:
        need = r.n_anchors * (size + CHUNK_ROWS // LEAF)
        if need > room:
            out.append([])
            room = BLOCK
        out[-1].append(r.tree_id)
        room -= need
    return out


def _pass(spark: SparkSession, trees: DataFrame, block: tuple[np.ndarray, ...], k: int, same: bool, tables: Tables, *keys: str) -> DataFrame:
    sent = spark.sparkContext.broadcast(block)
    out = tables.write(_ranked(trees.select("tree").mapInArrow(_search(sent, k, same), _FOUND), k, *keys))
    sent.destroy()
    return out


def mine(
    vectors: DataFrame, anchors: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where ``anchors``
    (a condition on the columns of ``vectors``) holds and each of its best ``positives`` of the same label, the
    first ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score."""
    spark = vectors.sparkSession
    tables = Tables(spark)
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"), F.coalesce(anchors, F.lit(False)).alias("is_anchor")
    )
    rows = fit_vectors(rows, "vector").where("id IS NOT NULL AND label IS NOT NULL")
    whole = rows.schema["label"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    rows = rows.select("row", "id", "vector", (F.col("label").cast("bigint") if whole else F.xxhash64("label")).alias("label"), F.size("vector").alias("size"), "is_anchor")
    norm = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x.cast("double") * scale).cast("double"), F.lit(2.0)))
    top = rows.agg(F.max(norm)).first()[0]
    empty = spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    if top is None:
        return empty
    if top * max(low, high, 100) >= 1 << 62:
        raise ValueError("scores do not fit 64 bits")
    built = tables.write(rows.mapInArrow(_trees(scale, top), "size int, tree binary, n_anchors bigint, anchors binary").withColumn("tree_id", F.monotonically_increasing_id()))
    results = []
    for size in [r["size"] for r in built.select("size").distinct().collect()]:
        trees = built.where(F.col("size") == size)
        for chosen in _blocks(built, size):
            parts = [blobs.unpack(r.anchors) for r in trees.where(F.col("tree_id").isin(chosen)).select("anchors").collect()]
            numbers, row, ids, labels = (np.concatenate(x) for x in zip(*parts, strict=True))
            numbers = numbers.reshape(len(row), size)
            any_score = np.full((len(row), 1), 1 << 61)
            near = _pass(spark, trees, (numbers, row, labels, -any_score, any_score), positives, True, tables, "anchor")
            # the block's windows: one for each positive, and one that nothing fits where there are fewer
            at = {r: i for i, r in enumerate(row.tolist())}
            least, most = np.full((len(row), positives), 1), np.full((len(row), positives), 0)
            for r in near.select("anchor", "rank", "score").collect():
                least[at[r.anchor], r["rank"] - 1] = -(-low * r.score // 100)
                most[at[r.anchor], r["rank"] - 1] = high * r.score // 100
            far = _pass(spark, trees, (numbers, row, labels, least, most), negatives, False, tables, "anchor", "slot")
            named = spark.createDataFrame(pa.table({"anchor": row, "anchor_id": ids}))
            pairs = far.select("anchor", (F.col("slot") + 1).cast("int").alias("slot"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
            own = near.select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
            results.append(pairs.join(own, ["anchor", "slot"]).join(named, "anchor").select(empty.columns))
    tables.drop(built)
    out = empty
    for part in results:
        out = out.unionByName(part)
    return out
