"""Vectorised reading of text columns inside tasks: bytes, words, rolling hashes and minimum windows.

All functions work on one slice of an Arrow batch (a few MB of whole texts, or one longer text), so the
memory of a task is bounded by the slice and by the longest text. White space is byte-wise
``\\x20 \\x09-\\x0D``; every one of these is ASCII, so splitting UTF-8 bytes is splitting characters.
Null texts read as empty texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.default_rng(20240601)
#: A random 64-bit value for each byte, and odd multipliers with their inverses modulo 2**64.
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1 << 60, 1 << 62)) * 2 + 1
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``x**i`` and ``x**-i`` modulo 2**64 for i < n, kept between calls."""
    have = _powers.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Prefix sums of ``values[i] * x**i`` with a leading zero."""
    up, _ = powers(len(values))
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span of a sequence, from its prefix sums; equal contents give equal hashes."""
    _, down = powers(len(prefix))
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def window_hash(prefix: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` consecutive values (also those that cross texts)."""
    n = len(prefix) - size
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    _, down = powers(n)
    return mix((prefix[size:] - prefix[:n]) * down)


def window_min(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values, by doubling."""
    out, width = values, 1
    while width * 2 <= size:
        out = np.minimum(out[:-width], out[width:]) if len(out) > width else out[:0]
        width *= 2
    rest = size - width
    if rest:
        out = np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]
    return out


@dataclass
class Slice:
    """Whole texts of some rows: row numbers ``first`` on, bytes, and n + 1 byte offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def text_slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The texts of a column in slices of at most ``limit`` bytes, or one text where it alone is longer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    yield from _slices(column.cast(pa.large_string()).fill_null(""), limit)


def text_slices_binary(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The same for byte strings."""
    yield from _slices(column.cast(pa.large_binary()).fill_null(b""), limit)


def _slices(column: pa.Array, limit: int) -> Iterator[Slice]:
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Slice(first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a slice: byte spans, and n + 1 word offsets of the texts."""

    starts: np.ndarray
    ends: np.ndarray
    offsets: np.ndarray


def words(part: Slice, between: np.ndarray = _SPACE) -> Words:
    """Words, runs of bytes that are not ``between`` (given for all 256), here ``[^\\x20\\x09-\\x0D]+``; none crosses a text."""
    n = len(part.data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, np.zeros(len(part.offsets), dtype=np.int64))
    inside = ~between[part.data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[part.offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begin)
    return Words(starts, np.flatnonzero(end) + 1, np.searchsorted(starts, part.offsets))


_LONG = 64
_STEP = np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)


def word_hashes(part: Slice, of: Words, data: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each word; ``data`` may hold changed bytes, such as lower case.

    Words are read in lanes of eight bytes, each mixed into the state of those before it, so words whose letters
    follow a rule have no more equal hashes than others; words over 64 bytes go to xxh3.
    """
    data = part.data if data is None else data
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    size = of.ends - of.starts
    out = mix(size.astype(np.uint64) * _STEP)
    live = np.arange(len(size))
    for at in range(0, _LONG, 8):
        out[live] = mix(out[live] * _STEP + (lanes[of.starts[live] + at] & _KEEP[np.minimum(size[live] - at, 8)]))
        live = live[size[live] > at + 8]
        if not len(live):
            return out
    out[live] = [xxhash.xxh3_64_intdigest(data[b:e].data) for b, e in zip(of.starts[live].tolist(), of.ends[live].tolist(), strict=True)]
    return out


def text_hashes(part: Slice) -> np.ndarray:
    """xxh3 of each whole text."""
    ends = part.offsets.tolist()
    data = np.ascontiguousarray(part.data)
    return np.array([xxhash.xxh3_64_intdigest(data[b:e].data) for b, e in zip(ends, ends[1:])], dtype=np.uint64)


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A keyed 96-bit BLAKE2b digest of each span, as 64 and 32 bits."""
    empty, view = hashlib.blake2b(digest_size=12, key=key), memoryview(np.ascontiguousarray(data))

    def one(begin: int, end: int) -> bytes:
        h = empty.copy()
        h.update(view[begin:end])
        return h.digest()

    out = np.frombuffer(b"".join(map(one, starts.tolist(), ends.tolist())), dtype=[("a", "<u8"), ("b", "<u4")])
    return out["a"], out["b"]


def equal_spans(data: np.ndarray, begin: np.ndarray, first: np.ndarray, end: np.ndarray, other: np.ndarray, other_end: np.ndarray) -> np.ndarray:
    """Whether the units first .. end - 1 are those of other .. other_end - 1, for each pair; unit i begins at ``begin[i]``."""
    a, b = begin[first], begin[other]
    size = begin[end] - a
    same = size == begin[other_end] - b
    for some in np.array_split(np.flatnonzero(same), max(1, int(size[same].sum()) >> 22)):
        if len(some):
            differ = data[ranges(a[some], size[some])] != data[ranges(b[some], size[some])]
            same[some] = np.add.reduceat(differ, np.cumsum(size[some]) - size[some]) == 0
    return same


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, byte-wise."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def last_whole_window(offsets: np.ndarray, size: int) -> np.ndarray:
    """For each text the number of windows of ``size`` units that lie in it."""
    return np.maximum(offsets[1:] - offsets[:-1] - size + 1, 0)


def expand(counts: np.ndarray) -> np.ndarray:
    """0, 0, 1, 2, 2 for the counts 2, 1, 2."""
    return np.repeat(np.arange(len(counts)), counts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``starts[i] .. starts[i] + counts[i] - 1``, all i in order."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, counts)
