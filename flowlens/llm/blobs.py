"""Columnar rows: several numpy arrays packed into one binary cell, so a shuffle moves few, wide rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types and lengths, one after the other."""
    head = [np.array([len(arrays)], dtype=np.int64).tobytes()]
    for a in arrays:
        head.append(a.dtype.str[1:].ljust(8).encode() + np.array([len(a)], dtype=np.int64).tobytes())
    return b"".join(head + [np.ascontiguousarray(a).tobytes() for a in arrays])


def unpack(blob: bytes | memoryview) -> list[np.ndarray]:
    count = int(np.frombuffer(blob, np.int64, 1)[0])
    out, at = [], 8 + 16 * count
    for i in range(count):
        kind = bytes(blob[8 + 16 * i : 16 + 16 * i]).decode().strip()
        size = int(np.frombuffer(blob, np.int64, 1, 16 + 16 * i)[0])
        out.append(np.frombuffer(blob, np.dtype(kind), size, at))
        at += size * np.dtype(kind).itemsize
    return out


def unpack_all(column: pa.ChunkedArray) -> list[list[np.ndarray]]:
    return [unpack(x.as_buffer()) for x in column if x.is_valid]


def by_target(target: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each target with the positions of its entries, in their order."""
    if not len(target):
        return
    order = np.argsort(target, kind="stable")
    sorted_target = target[order]
    cuts = np.flatnonzero(np.diff(sorted_target)) + 1
    for rows in np.split(order, cuts):
        yield int(target[rows[0]]), rows


def table(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.table([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=names)
