"""Product codes of vectors, with codebooks trained by the filtering form of Lloyd's algorithm.

Components become integers, ``floor(scale * x)``, so that every sum is exact and no result depends on how the
table is partitioned. A vector is cut into ``parts`` equal consecutive parts; each part position has a
codebook of ``entries`` integer vectors, first the parts of the smallest ids, then ``rounds`` times the means
of the parts nearest to each.

* Each task builds kd-trees over its vectors (one for each part position and chunk of vectors) and writes them
  to the shared folder: points in tree order, and for each node its bounding box, count and sum.
* A round walks all trees level by level. In a node the entry nearest to the middle of its box is compared with
  every entry left there: one that is farther in all of the box (its most favourable corner decides) is
  eliminated for the subtree. Where one is left, the node's cached sum and count go to it at once; only the
  points of leaves with several are compared one by one.
* Tasks send one row for each (part, entry) they used; the driver holds codebooks only, ``entries`` times the
  vector's length.

Ties go to the lower entry. Defined results: vectors that are null or hold null or non-finite components are
left out; ids only choose the first entries (null ids come last, equal ids in the order of their vectors), rows
with one id are vectors of their own; vectors of each length have codebooks of their own; a length that ``parts`` does not
divide is cut as evenly as can be; with fewer vectors than ``entries`` each is an entry; an empty table gives
an empty table; other columns are ignored. Components too large for exact 64-bit distances raise ValueError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm import blobs
from flowlens.llm.lineage import Tables

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
LEAF = 16
CHUNK = 1 << 20  # components of one forest

Codebooks = dict[int, np.ndarray]  # vector length -> (parts, entries, width) integers


def fit_vectors(vectors: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is not null and holds neither null nor non-finite components."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))


def integers(column: pa.Array, scale: int) -> np.ndarray:
    """(n, length) integers of vectors of one length."""
    flat = np.floor(np.asarray(column.flatten(), dtype=np.float64) * scale)
    if len(flat) and not np.abs(flat).max() < 1 << 31:
        raise ValueError("a component is too large for exact integer arithmetic")
    return flat.astype(np.int64).reshape(len(column), len(flat) // max(len(column), 1))


def cut(numbers: np.ndarray, parts: int) -> np.ndarray:
    """(parts, n, width): the parts of vectors, padded with zeros where they are uneven."""
    size = numbers.shape[1]
    edges = [size * p // parts for p in range(parts + 1)]
    width = max(1, -(-size // parts))
    if width * (int(np.abs(numbers).max(initial=0)) + 1) ** 2 >= 1 << 57:
        raise ValueError("components are too large for exact squared distances")
    out = np.zeros((parts, len(numbers), width), dtype=np.int64)
    for p in range(parts):
        out[p, :, : edges[p + 1] - edges[p]] = numbers[:, edges[p] : edges[p + 1]]
    return out


class Forest:
    """One kd-tree for each part position over the same vectors. Node i of level l holds the points from
    ``n * i >> l`` to ``n * (i + 1) >> l`` of its part's order."""

    def __init__(self, points: np.ndarray, order: np.ndarray, boxes: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.points, self.order, self.boxes = points, order, boxes
        self.parts, self.n, self.width = points.shape

    @staticmethod
    def edges(n: int, level: int) -> np.ndarray:
        return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level

    @classmethod
    def build(cls, points: np.ndarray) -> Forest:
        parts, n, width = points.shape
        order = np.broadcast_to(np.arange(n), (parts, n)).copy()
        depth, boxes = max(0, (n // LEAF).bit_length() - 1), []
        for level in range(depth + 1):
            edges = cls.edges(n, level)
            lo, hi = np.minimum.reduceat(points, edges[:-1], axis=1), np.maximum.reduceat(points, edges[:-1], axis=1)
            boxes.append((lo, hi, np.add.reduceat(points, edges[:-1], axis=1)))
            if level < depth:
                node = np.repeat(np.arange(1 << level), np.diff(edges))
                widest = np.argmax(hi - lo, axis=2)[:, node]
                along = np.take_along_axis(points, widest[:, :, None], axis=2)[:, :, 0]
                turn = np.stack([np.lexsort((a, node)) for a in along])
                order = np.take_along_axis(order, turn, axis=1)
                points = np.take_along_axis(points, turn[:, :, None], axis=1)
        return cls(points, order, boxes)

    def pack(self) -> bytes:
        small = np.int32 if np.abs(self.points).max(initial=0) < 1 << 31 else np.int64
        head = np.array(self.points.shape, dtype=np.int64)
        return blobs.pack(head, self.points.astype(small).ravel(), self.order.astype(np.int32).ravel(), *(x.ravel() for box in self.boxes for x in box))

    @classmethod
    def unpack(cls, blob: bytes) -> Forest:
        head, points, order, *rest = blobs.unpack(blob)
        parts, n, width = head.tolist()
        nodes = [x.reshape(parts, -1, width) for x in rest]
        return cls(points.astype(np.int64).reshape(parts, n, width), order.reshape(parts, n), list(zip(nodes[::3], nodes[1::3], nodes[2::3], strict=True)))

    def assign(self, book: np.ndarray, each: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Sums and counts of the points nearest to each entry and, if asked for ``each``, the entry of each point."""
        k = book.shape[1]
        sums, counts = np.zeros(book.shape, dtype=np.int64), np.zeros(book.shape[:2], dtype=np.int64)
        chosen = np.zeros((self.parts, self.n), dtype=np.int64) if each else None
        part, node = np.arange(self.parts), np.zeros(self.parts, dtype=np.int64)
        left = np.ones((self.parts, k), dtype=bool)
        squares = (book * book).sum(axis=2)
        number = np.arange(k)
        for level, (lo, hi, total) in enumerate(self.boxes):
            low, high, at = lo[part, node], hi[part, node], book[part]
            middle = ((2 * at - (low + high)[:, None, :]) ** 2).sum(axis=2)
            best = np.argmin(np.where(left, middle, np.iinfo(np.int64).max), axis=1)
            lead = at - book[part, best][:, None, :]
            # at most this much nearer than ``best`` anywhere in the box
            gain = squares[part, best][:, None] - squares[part] + 2 * np.maximum(low[:, None, :] * lead, high[:, None, :] * lead).sum(axis=2)
            left &= ~((gain < 0) | ((gain == 0) & (best[:, None] < number)))
            whole = left.sum(axis=1) == 1
            edges = self.edges(self.n, level)
            p, i, entry = part[whole], node[whole], best[whole]
            np.add.at(sums, (p, entry), total[p, i])
            np.add.at(counts, (p, entry), edges[i + 1] - edges[i])
            if each:
                for a, b, e, q in zip(edges[i].tolist(), edges[i + 1].tolist(), entry.tolist(), p.tolist(), strict=True):
                    chosen[q, a:b] = e
            part, node, left = part[~whole], node[~whole], left[~whole]
            if level + 1 < len(self.boxes):
                part, node, left = np.repeat(part, 2), (2 * node[:, None] + np.arange(2)).ravel(), np.repeat(left, 2, axis=0)
        edges = self.edges(self.n, len(self.boxes) - 1)
        for q in np.unique(part).tolist():
            mine = part == q
            size = edges[node[mine] + 1] - edges[node[mine]]
            rows = np.repeat(edges[node[mine]] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            points = self.points[q, rows]
            distance = squares[q] - 2 * (points @ book[q].T)
            entry = np.argmin(np.where(np.repeat(left[mine], size, axis=0), distance, np.iinfo(np.int64).max), axis=1)
            np.add.at(sums[q], entry, points)
            counts[q] += np.bincount(entry, minlength=k)
            if each:
                chosen[q, rows] = entry
        return sums, counts, chosen

    def codes(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, parts) entries and (n,) squared distances, in the vectors' own order."""
        _, _, chosen = self.assign(book, True)
        away = ((self.points - np.take_along_axis(book, chosen[:, :, None], axis=1)) ** 2).sum(axis=2)
        code, error = np.empty((self.n, self.parts), dtype=np.uint8), np.zeros(self.n, dtype=np.int64)
        for p in range(self.parts):
            code[self.order[p], p] = chosen[p]
            error[self.order[p]] += away[p]
        return code, error


def _forests(parts: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column(3))
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                step = max(1, CHUNK // max(size, 1))
                for at in range(0, len(rows), step):
                    part = batch.take(pa.array(rows[at : at + step]))
                    forest = Forest.build(cut(integers(part.column(2), scale), parts))
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(c)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), *lists, pa.array([forest.pack()], pa.binary())], names=["size", "ids", "labels", "forest"])

    return run


def _sums(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for size, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums, counts, _ = Forest.unpack(blob.as_buffer()).assign(books[size], False)
                have = total.setdefault(size, [np.zeros_like(sums), np.zeros_like(counts)])
                have[0] += sums
                have[1] += counts
        for size, (sums, counts) in total.items():
            part, entry = np.nonzero(counts)
            rows = [pa.array(x, pa.int32()) for x in (np.full(len(part), size), part, entry)]
            yield pa.RecordBatch.from_arrays([*rows, pa.array(list(sums[part, entry]), pa.list_(pa.int64())), pa.array(counts[part, entry])], names=["size", "part", "entry", "sums", "n"])

    return run


def _codes(books: Codebooks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                size = batch.column(0)[i].as_py()
                code, error = Forest.unpack(batch.column(3)[i].as_buffer()).codes(books[size])
                ids, labels = (batch.column(c).slice(i, 1).flatten() for c in (1, 2))
                yield pa.RecordBatch.from_arrays(
                    [ids, labels, pa.array(np.full(len(code), size), pa.int32()), pa.array([row.tobytes() for row in code], pa.binary()), pa.array(error)],
                    names=["id", "label", "size", "code", "error"],
                )

    return run


def first_codebooks(rows: DataFrame, parts: int, entries: int, scale: int) -> Codebooks:
    """The vectors of the ``entries`` smallest ids of each length, cut into parts."""
    rank = F.row_number().over(Window.partitionBy("size").orderBy(F.col("id").asc_nulls_last(), "vector"))
    first = rows.select("size", "id", "vector").withColumn("rank", rank).where(F.col("rank") <= entries)
    found: dict[int, list[tuple[int, list[float]]]] = {}
    for r in first.select("size", "rank", "vector").collect():
        found.setdefault(r.size, []).append((r.rank, r.vector))
    return {size: cut(integers(pa.array([v for _, v in sorted(many)], pa.list_(pa.float64())), scale), parts) for size, many in found.items()}


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[DataFrame, Codebooks]:
    """(id, label, size, code, error), one row for each vector that takes part, and the codebooks by vector length.
    ``code`` has one byte for each part; ``error`` is the squared distance to what the code stands for."""
    if not 1 <= entries <= 256:
        raise ValueError("a code byte holds 1 to 256 entries")
    tables = Tables(vectors.sparkSession)
    rows = fit_vectors(vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")), "vector").withColumn("size", F.size("vector"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    books = first_codebooks(rows, parts, entries, scale)
    forests = tables.write(rows.mapInArrow(_forests(parts, scale), f"size int, ids array<{types['id']}>, labels array<{types['label']}>, forest binary"))
    for _ in range(rounds):
        parts_of = forests.select("size", "forest").mapInArrow(_sums(books), "size int, part int, entry int, sums array<bigint>, n bigint")
        each = parts_of.select("size", "part", "entry", "n", F.posexplode("sums").alias("place", "value"))
        means = each.groupBy("size", "part", "entry", "place").agg(F.sum("value").alias("value"), F.sum("n").alias("n")).collect()
        books = {size: book.copy() for size, book in books.items()}
        for r in means:
            books[r["size"]][r.part, r.entry, r.place] = r.value // r.n
    coded = tables.write(forests.mapInArrow(_codes(books), f"id {types['id']}, label {types['label']}, size int, code binary, error bigint"))
    tables.drop(forests)
    return coded, books


def entry_values(book: np.ndarray, size: int) -> list[int]:
    """All components of a codebook by part, entry and position, without padding."""
    parts = len(book)
    widths = [size * (p + 1) // parts - size * p // parts for p in range(parts)]
    return [int(x) for part, width in zip(book, widths, strict=True) for entry in part for x in entry[:width]]


def codebook_digest(book: np.ndarray, size: int) -> str:
    return hashlib.sha256(",".join(map(str, entry_values(book, size))).encode()).hexdigest()


def decode(coded: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """``coded`` and ``vector``: the middle of the cell that each entry component stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for size, code in zip(batch.column("size").to_pylist(), batch.column("code").to_pylist(), strict=True):
                book, parts = books[size], len(code)
                out.append([(int(x) + 0.5) / scale for p in range(parts) for x in book[p, code[p]][: size * (p + 1) // parts - size * p // parts]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], names=[*batch.schema.names, "vector"])

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in coded.schema)
    return coded.mapInArrow(run, f"{ddl}, vector array<double>")


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` and ``label_error``, the error summed over equal labels; null labels are one."""
    total = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return coded.join(total, F.col("label").eqNullSafe(F.col("of"))).drop("of")
