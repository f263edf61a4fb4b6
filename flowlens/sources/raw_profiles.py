"""Raw binary profiles as a data source: ``spark.read.format("rawprofile")`` and ``df.write.format("rawprofile")``.

A file is a magic number that tells width and byte order, six header words (version, records, counters, size of names,
addresses of counters and names), records (length of the name, counters, hash, address of the name, address of the
counters), counters, names. A task reads the header and its own share of the records, then only the counters and names that
those point to, so a file of any size is read by many tasks. A task writes files of bounded size under names that nobody
reads; the commit renames those of the attempts that count, an abort deletes its own.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "path string, fn string, hash decimal(20,0), counters array<decimal(20,0)>, error string"
_ROW = pa.schema([("path", pa.string()), ("fn", pa.string()), ("hash", pa.decimal128(20, 0)), ("counters", pa.list_(pa.decimal128(20, 0))), ("error", pa.string())])
#: Bytes of one share of a file, of the counters and names read at once, and of a file written.
SPLIT = 64 << 20
READ = 4 << 20
FILE = 64 << 20
#: The format's version and the letters of its two widths within the magic number.
VERSION = 1
WIDTHS = {64: ord("r"), 32: ord("R")}
ORDERS = {"little": "<", "big": ">"}
HEADER = 56


def magic(order: str, width: int) -> bytes:
    return struct.pack(order + "Q", int.from_bytes(b"\xfflprof" + bytes([WIDTHS[width], 0x81]), "big"))


def record_of(order: str, width: int) -> struct.Struct:
    return struct.Struct(order + "IIQ" + ("QQ" if width == 64 else "II"))


class MalformedProfileError(ValueError):
    """A file, or a part of one, that is no raw profile."""


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Share(InputPartition):
    """The ``number``-th of ``shares`` equal parts of a file's records."""

    path: str
    size: int
    number: int
    shares: int


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


class RawProfiles(DataSource):
    """Options: ``path``; to write also ``width`` (64 or 32) and ``order`` (little or big); ``splitBytes`` and ``fileBytes``."""

    @classmethod
    def name(cls) -> str:
        return "rawprofile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT)))

    def writer(self, schema, overwrite: bool) -> Writer:
        width, order = int(self.options.get("width", 64)), self.options.get("order", "little")
        if width not in WIDTHS or order not in ORDERS:
            raise ValueError("width must be 64 or 32, order little or big")
        missing = {"fn", "hash", "counters"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {sorted(missing)}")
        return Writer(self.options["path"], width, ORDERS[order], int(self.options.get("fileBytes", FILE)), overwrite)


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[Share]:
        """Shares of the files of a folder (or of one file); hidden ones go. Only names and sizes are looked at here."""
        where, path = _at(self.path)
        found = where.get_file_info(path)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        files = [found] if found.type == fs.FileType.File else where.get_file_info(fs.FileSelector(path, recursive=True))
        files = [f for f in files if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            shares = max(1, -(-f.size // self.split))
            out += [Share(f.path, f.size, i, shares) for i in range(shares)]
        return out

    def read(self, share: Share | None) -> Iterator[pa.RecordBatch]:
        """The rows of a share; Spark gives None where there are no shares at all."""
        if share is None:
            return
        where, _ = _at(self.path)
        with where.open_input_file(share.path) as file:
            try:
                yield from _records(file, share)
            except MalformedProfileError as problem:
                if share.number == 0:
                    yield _batch(share.path, [(None, None, None, str(problem))])


def _batch(path: str, rows: list[tuple]) -> pa.RecordBatch:
    fn, key, counters, error = zip(*rows, strict=True)
    lengths = pa.array([None if c is None else len(c) for c in counters], pa.int32())
    values = pa.concat_arrays([pa.array([], pa.uint64())] + [c for c in counters if c is not None]).cast(pa.decimal128(20, 0))
    starts, at = [], 0
    for n in lengths.to_pylist():
        starts.append(None if n is None else at)
        at += n or 0
    lists = pa.ListArray.from_arrays(pa.array([*starts, at], pa.int32()), values)
    return pa.record_batch([pa.array([path] * len(rows), pa.string()), pa.array(fn, pa.string()), pa.array(key, pa.uint64()).cast(pa.decimal128(20, 0)), lists, pa.array(error, pa.string())], schema=_ROW)


def _records(file, share: Share) -> Iterator[pa.RecordBatch]:
    """The rows of one share. Records are read in blocks; those of a block that are sound are read in pieces of READ bytes of
    counters. A record that points outside its file becomes a row with an error."""
    order, width, (_, records, counts, names, counters_at, names_at) = _header(file, share.size)
    record = record_of(order, width)
    counters_from = HEADER + record.size * records
    names_from = counters_from + 8 * counts
    if share.size < names_from + names:
        raise MalformedProfileError("truncated data")
    first, end = (records * n // share.shares for n in (share.number, share.number + 1))
    block = max(1, READ // record.size)
    for low in range(first, end, block):
        rows, size = [], 0
        for length, n, key, name_at, counter_at in record.iter_unpack(_bytes(file, HEADER + record.size * low, record.size * min(block, end - low))):
            place, text = counter_at - counters_at, name_at - names_at
            if place < 0 or place % 8 or place // 8 + n > counts or text < 0 or text + length > names:
                rows.append((None, None, None, "malformed record"))
            else:
                rows.append((names_from + text, length, key, (counters_from + place, n)))
                size += 8 * n + length
            if size >= READ:
                yield _batch(share.path, _filled(file, rows, order))
                rows, size = [], 0
        if rows:
            yield _batch(share.path, _filled(file, rows, order))


def _header(file, size: int) -> tuple[str, int, tuple]:
    head = _bytes(file, 0, min(size, HEADER))
    for order in ORDERS.values():
        for width in WIDTHS:
            if head[:8] == magic(order, width):
                if size < HEADER:
                    raise MalformedProfileError("truncated header")
                return order, width, struct.unpack(order + "6Q", head[8:])
    raise MalformedProfileError("bad magic")


def _bytes(file, at: int, size: int) -> bytes:
    return file.read_at(size, at) if size else b""


class _Window:
    """Bytes of a file, read ahead: records that lie in the order of their data cost one read for each READ bytes."""

    def __init__(self, file):
        self.file, self.at, self.data = file, 0, b""

    def get(self, at: int, size: int) -> bytes:
        if not self.at <= at <= at + size <= self.at + len(self.data):
            self.at, self.data = at, _bytes(self.file, at, max(size, READ))
        return self.data[at - self.at : at - self.at + size]


def _filled(file, rows: list[tuple], order: str) -> list[tuple]:
    counters, names, out = _Window(file), _Window(file), []
    for name_from, length, key, where in rows:
        if name_from is None:
            out.append((None, None, None, where))
            continue
        values = np.frombuffer(counters.get(where[0], 8 * where[1]), order + "u8").astype("=u8")
        out.append((names.get(name_from, length).decode("utf-8", "replace"), key, pa.array(values), None))
    return out


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, order: str, limit: int, overwrite: bool):
        self.path, self.width, self.order, self.limit, self.overwrite = path, width, order, limit, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        """A row with a null, or a hash or counter that is no unsigned 64-bit number, fails the job."""
        where, folder = _at(self.path)
        where.create_dir(folder, recursive=True)
        out, pending = Written(), _File(self.order, self.width)
        try:
            for batch in batches:
                for fn, key, counters in _unsigned(batch):
                    if pending.size and pending.size + pending.record.size + len(fn) + counters.nbytes > self.limit:
                        self._put(where, folder, pending, out)
                        pending = _File(self.order, self.width)
                    pending.add(fn, key, counters)
            if pending.size:
                self._put(where, folder, pending, out)
        except BaseException:
            for name in out.files:
                where.delete_file(f"{folder}/{name}")
            raise
        return out

    def _put(self, where: fs.FileSystem, folder: str, pending: _File, out: Written) -> None:
        name = f"_{uuid.uuid4().hex}.raw"
        out.files.append(name)
        with where.open_output_stream(f"{folder}/{name}") as file:
            for part in pending.parts():
                file.write(part)

    def commit(self, messages: list[Written | None]) -> None:
        where, folder = _at(self.path)
        where.create_dir(folder, recursive=True)
        kept = {name for m in messages if m is not None for name in m.files}
        if self.overwrite:
            for old in where.get_file_info(fs.FileSelector(folder, recursive=True)):
                if old.type == fs.FileType.File and old.base_name not in kept:
                    where.delete_file(old.path)
        for name in kept:
            where.move(f"{folder}/{name}", f"{folder}/{name[1:]}")

    def abort(self, messages: list[Written | None]) -> None:
        where, folder = _at(self.path)
        for name in (name for m in messages if m is not None for name in m.files):
            where.delete_file(f"{folder}/{name}")


def _unsigned(batch: pa.RecordBatch) -> Iterator[tuple[bytes, int, np.ndarray]]:
    names, keys, lists = batch.column("fn"), batch.column("hash"), batch.column("counters")
    if names.null_count or keys.null_count or lists.null_count or lists.flatten().null_count:
        raise ValueError("a raw profile holds no nulls")
    keys, values = keys.cast(pa.uint64()), np.asarray(lists.flatten().cast(pa.uint64()))
    at = 0
    for fn, key, n in zip(names.to_pylist(), keys.to_pylist(), lists.value_lengths().to_pylist(), strict=True):
        yield fn.encode(), key, values[at : at + n]
        at += n


class _File:
    """What is to become one file: its records wait for the header, which holds their number."""

    def __init__(self, order: str, width: int):
        self.order, self.width, self.record = order, width, record_of(order, width)
        self.records, self.counters, self.names = bytearray(), bytearray(), bytearray()

    @property
    def size(self) -> int:
        return len(self.records) + len(self.counters) + len(self.names)

    def add(self, fn: bytes, key: int, counters: np.ndarray) -> None:
        self.records += self.record.pack(len(fn), len(counters), key, len(self.names), len(self.counters))
        self.counters += counters.astype(self.order + "u8").tobytes()
        self.names += fn

    def parts(self) -> Iterator[bytes]:
        sizes = (VERSION, len(self.records) // self.record.size, len(self.counters) // 8, len(self.names), 0, 0)
        yield from (magic(self.order, self.width) + struct.pack(self.order + "6Q", *sizes), self.records, self.counters, self.names)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RawProfiles)
    return spark
