"""Removal of repeated word sequences with compressed full-text indexes.

``remove_repeated_words`` deletes each word that lies in a window of ``window`` words whose sequence
also starts earlier (in a document of smaller id, or earlier in the same document); windows are judged
on the input. The corpus is dealt to shards by content anchors (``repeats``). Each shard builds an
FM-index of its segments: the Burrows-Wheeler transform of the word symbols, kept as a wavelet matrix
of packed bits with sampled counts. Every window of the streamed segments is searched backwards, word
by word and all windows side by side; the number of words for which more than one place matches is the
matching statistic, and windows that reach the threshold report their interval, whose earliest place
stays.

Defined results: null text is empty text; words are ``[^\\x20\\x09-\\x0D]+`` unchanged; rows with the
same id and text are one document and all get its result; null ids come after all others; an empty
table gives an empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import repeats, textbytes as tb

WINDOW = 20
GRAM = 6


class FMIndex:
    """Backward search over a sequence of symbols 0 .. kinds-1, exact for patterns of ``reach`` symbols."""

    def __init__(self, symbols: np.ndarray, kinds: int, reach: int):
        n = len(symbols)
        rank = symbols.astype(np.int64)
        width, most = 1, kinds
        while width < reach:
            after = np.zeros(n, dtype=np.int64)
            after[: n - width] = rank[width:] + 1
            distinct, rank = np.unique(rank * (most + 1) + after, return_inverse=True)
            width, most = width * 2, len(distinct)
            if most == n:
                break
        order = np.argsort(rank, kind="stable")
        last = symbols[order - 1]  # of the suffix at 0 the text's last symbol, which is a separator
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=kinds))])
        self.bits = max(1, int(kinds - 1).bit_length())
        self.words, self.ones, self.zeros = [], [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (last >> level) & 1
            padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
            padded[:n] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]).astype(np.int32))
            self.zeros.append(int(n - bit.sum()))
            last = np.concatenate([last[bit == 0], last[bit == 1]])
        self.starts = self._starts(kinds)

    def _starts(self, kinds: int) -> np.ndarray:
        """Where each symbol's block begins on the last level."""
        symbol, at = np.arange(kinds), np.zeros(kinds, dtype=np.int64)
        for level in range(self.bits):
            at = self._step(level, symbol, at)
        return at

    def _step(self, level: int, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        ones = self.ones[level][block] + np.bitwise_count(self.words[level][block] & mask)
        bit = (symbol >> (self.bits - 1 - level)) & 1
        return np.where(bit == 1, self.zeros[level] + ones, at - ones)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        start = self.starts[symbol]
        for level in range(self.bits):
            at = self._step(level, symbol, at)
        return at - start

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of symbol + pattern from those of the pattern."""
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.below[symbol], 2)
        return both[: len(low)], both[len(low) :]


def matching_statistics(index: FMIndex, symbols: np.ndarray, ends: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For the pattern that ends at each place: how many symbols leftwards (``threshold`` at most) match
    at more than one place, and the low end of the interval of those that reach it."""
    length = np.zeros(len(ends), dtype=np.int64)
    live = np.arange(len(ends))
    low, high = index.below[symbols[ends]], index.below[symbols[ends] + 1]
    for done in range(1, threshold + 1):
        more = high - low >= 2
        live, low, high = live[more], low[more], high[more]
        length[live] = done
        if done == threshold or not len(live):
            break
        low, high = index.extend(symbols[ends[live] - done], low, high)
    interval = np.full(len(ends), -1, dtype=np.int64)
    interval[live] = low
    return length, interval


def word_names(part: tb.Slice, found: tb.Words) -> np.ndarray:
    """A number for each word, equal for equal words only: words of one hash are compared with the first of them,
    and where they differ those with that hash are named by their text."""
    hashes = tb.word_hashes(part, found)
    _, first, names = np.unique(hashes, return_index=True, return_inverse=True)
    at = first[names]
    other = np.flatnonzero(at != np.arange(len(at)))
    edges = np.empty(2 * len(at), dtype=np.int64)
    edges[::2], edges[1::2] = found.starts, found.ends
    wrong = other[~tb.equal_spans(part.data, edges, 2 * other, 2 * other + 1, 2 * at[other], 2 * at[other] + 1)]
    if len(wrong):
        extra: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(names, names[wrong])).tolist():
            names[i] = extra.setdefault(part.data[found.starts[i] : found.ends[i]].tobytes(), len(first) + len(extra))
    return names


def shard_repeats(text: np.ndarray, offsets: np.ndarray, spec: repeats.Spec) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of each window that equals an earlier one of the shard."""
    part = tb.Slice(0, text, offsets)
    found = tb.words(part)
    names = word_names(part, found)
    sizes = np.diff(found.offsets)
    begin = found.offsets[:-1] + np.arange(len(sizes))
    symbols = np.zeros(len(names) + len(sizes), dtype=np.int64)  # a 0 closes each segment
    symbols[tb.ranges(begin, sizes)] = names + 1
    index = FMIndex(symbols, int(symbols.max(initial=0)) + 1, spec.window)
    counts = np.maximum(sizes - spec.window + 1, 0)
    starts, segment = tb.ranges(begin, counts), tb.expand(counts)
    length, interval = matching_statistics(index, symbols, starts + spec.window - 1, spec.window)
    hit = np.flatnonzero(length >= spec.window)
    order = hit[np.argsort(interval[hit], kind="stable")]  # stable: the earliest place of an interval comes first
    again = order[1:][np.diff(interval[order]) == 0]
    return segment[again], starts[again] - begin[segment[again]]


def _render(part: tb.Slice, offsets: np.ndarray, found: tb.Words, gone: np.ndarray) -> list[pa.Array]:
    kept = ~gone
    size = np.where(kept, found.ends - found.starts, 0)
    left = np.concatenate([[0], np.cumsum(kept)])
    count = np.diff(left[offsets])
    # a space after each kept word but the last of its text
    final = np.zeros(len(kept) + 1, dtype=bool)
    last = np.searchsorted(left, left[offsets[1:]][count > 0])  # one past the last kept word of a text
    final[last - 1] = True
    room = size + (kept & ~final[:-1])
    begin = np.cumsum(room) - room
    out = np.full(int(room.sum()), 0x20, dtype=np.uint8)
    out[tb.ranges(begin, size)] = part.data[tb.ranges(found.starts, size)]
    return [*repeats.summary(offsets, gone), repeats.binaries(out, np.concatenate([begin, [len(out)]])[offsets])]


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = 256) -> DataFrame:
    """All columns of ``docs``, and dedup_n_units, dedup_n_removed (words), dedup_removed (maximal runs
    of words) and dedup_kept (string: kept words joined by one space)."""
    spec = repeats.Spec("word", window, gram, repeats.parts_for(docs), hot)
    out = repeats.remove_repeats(docs, spec, shard_repeats, _render, id_col, text_col)
    return out.withColumn("dedup_kept", F.col("dedup_kept").cast("string"))
