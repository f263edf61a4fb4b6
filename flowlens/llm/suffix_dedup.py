"""Suffix-array removal of repeated byte strings.

``remove_repeated_bytes`` deletes each byte that lies in a ``window``-byte string which also starts
earlier (in a document of smaller id, or earlier in the same document). Strings are judged on the
input. Matches never cross documents. The corpus is dealt to shards by content anchors (``repeats``),
so equal strings always meet; each shard's suffixes are then sorted by the difference-cover method:
sampled triples are sorted and named, the string of names is sorted by recursion, the remaining third
is sorted by one symbol and the rank of the next suffix, and both are merged. Adjacent suffixes in
that order share a prefix of ``window`` bytes exactly if their strings are equal. The recursion ends
once names cover the window or are all different.

Defined results: null text is empty text (0 bytes, nothing removed, kept empty); rows with the same id
and text are one document and all get its result; null ids come after all others; an empty table gives
an empty table; other columns pass through, whatever their names. Texts of any length are read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from flowlens.llm import repeats, textbytes as tb

WINDOW = 100
GRAM = 32


def sorted_places(keys: np.ndarray, top: int) -> np.ndarray:
    """argsort of keys in 0 .. top-1; where key and place fit in one integer, by a plain sort of both."""
    width = max(1, len(keys) - 1).bit_length()
    if top.bit_length() + width > 62:
        return np.argsort(keys, kind="stable")
    return np.sort((keys << width) | np.arange(len(keys))) & ((1 << width) - 1)


def dense_names(keys: np.ndarray, top: int) -> tuple[np.ndarray, int]:
    """Ranks of keys in 0 .. top-1 among the distinct keys, and how many there are."""
    if top <= max(1 << 16, 4 * len(keys)):
        seen = np.zeros(top, dtype=np.int64)
        seen[keys] = 1
        names = np.cumsum(seen) - 1
        return names[keys], int(names[-1]) + 1
    order = sorted_places(keys, top)
    new = np.concatenate([[0], np.cumsum(np.diff(keys[order]) != 0)])
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = new
    return out, int(new[-1]) + 1


def smaller_before(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For sorted ``keys``: how many of ``among`` are smaller."""
    both = np.sort(np.concatenate([keys * 2, among * 2 + 1]))
    ours = (both & 1) == 0
    return np.flatnonzero(ours) - np.arange(len(keys))


def suffix_order(symbols: np.ndarray, need: int) -> np.ndarray:
    """Places of all suffixes in an order that is right for the first ``need`` symbols at least.

    ``symbols`` are positive integers. Returns rank[i] of the suffix at i, 0 the smallest.
    """
    n = len(symbols)
    if n < 3:
        order = sorted(range(n), key=lambda i: list(symbols[i:]))
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.arange(n)
        return rank
    text = np.concatenate([symbols, [0, 0, 0]]).astype(np.int64)
    top = int(symbols.max()) + 1
    # places 1 and 2 modulo 3; one more place past the end where n is 1 modulo 3, so that each third place has a successor
    ones, twos = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sampled = np.concatenate([ones, twos])
    pair, pairs = text[:-1] * top + text[1:], top * top
    if pairs * top * n >= 1 << 61:
        pair, pairs = dense_names(pair, pairs)
    names, kinds = dense_names(pair[sampled] * top + text[sampled + 2], pairs * top)
    whole = kinds == len(sampled) or need <= 3
    ranks = names if whole else suffix_order(names + 1, -(-need // 3) + 1)
    rank = np.zeros(n + 3, dtype=np.int64)
    rank[sampled] = ranks + 1
    size = len(sampled) + 2
    # the remaining third: by its first symbol and the rank of what follows
    rest = np.arange(0, n, 3)
    by_one = text[rest] * size + rank[rest + 1]
    order = sorted_places(by_one, top * size)
    rest, by_one = rest[order], by_one[order]
    # merge: against places 1 modulo 3 by one symbol, against places 2 modulo 3 by two
    real = ones[ones < n]
    before = smaller_before(by_one, text[real] * size + rank[real + 1])
    before += smaller_before(pair[rest] * size + rank[rest + 2], pair[twos] * size + rank[twos + 2])
    before = np.maximum.accumulate(before)
    own = np.concatenate([real, twos])
    if whole and kinds < len(sampled):
        own = own[sorted_places(rank[own], size)]
    else:
        by_rank = np.full(size, -1, dtype=np.int64)
        by_rank[rank[own]] = own
        own = by_rank[by_rank >= 0]
    out = np.empty(n, dtype=np.int64)
    out[rest] = np.arange(len(rest)) + before
    out[own] = np.arange(len(own)) + np.cumsum(np.bincount(before, minlength=len(own) + 1))[: len(own)]
    return out


def equal_to_previous(text: np.ndarray, order: np.ndarray, window: int) -> np.ndarray:
    """For places in order: whether the ``window`` bytes equal those at the place before (exact)."""
    wide = np.zeros(len(text) + 8, dtype=np.uint8)
    wide[: len(text)] = text
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    if window >= 8:
        eight = np.lib.stride_tricks.as_strided(wide, (len(text), 8), (1, 1)).copy().view(np.uint64).ravel()
        steps, values = [*range(0, window - 7, 8), window - 8], eight
    else:
        steps, values = range(window), wide
    for step in steps:
        live = np.flatnonzero(same)
        same[live] = values[order[live] + step] == values[order[live - 1] + step]
    return same


def shard_repeats(text: np.ndarray, offsets: np.ndarray, spec: repeats.Spec) -> tuple[np.ndarray, np.ndarray]:
    """(segment, offset) of each window that equals an earlier one of the shard."""
    sizes = np.diff(offsets)
    joined = np.ones(len(text) + len(sizes), dtype=np.int64)  # a 1 closes each segment
    begin = offsets[:-1] + np.arange(len(sizes))
    present = np.cumsum(np.bincount(text, minlength=256) > 0)
    joined[tb.ranges(begin, sizes)] = present[text] + 1
    rank = suffix_order(joined, spec.window)
    counts = np.maximum(sizes - spec.window + 1, 0)
    whole = np.zeros(len(joined), dtype=bool)
    whole[tb.ranges(begin, counts)] = True
    places = np.empty(len(joined), dtype=np.int64)
    places[rank] = np.arange(len(joined))
    places = places[whole[places]]
    same = equal_to_previous(joined.astype(np.uint8), places, spec.window)
    first = np.minimum.reduceat(places, np.flatnonzero(~same)) if len(places) else places
    repeated = places[places != first[np.cumsum(~same) - 1]] if len(places) else places
    segment = np.searchsorted(begin, repeated, "right") - 1
    return segment, repeated - begin[segment]


def _render(part: tb.Slice, offsets: np.ndarray, _, gone: np.ndarray) -> list[pa.Array]:
    left = np.concatenate([[0], np.cumsum(~gone)])
    return [*repeats.summary(offsets, gone), repeats.binaries(part.data[~gone], left[offsets])]


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, hot: int = 256) -> DataFrame:
    """All columns of ``docs``, and dedup_n_units, dedup_n_removed (bytes), dedup_removed (maximal runs)
    and dedup_kept (the remaining bytes, which may cut a character)."""
    spec = repeats.Spec("byte", window, gram, repeats.parts_for(docs), hot)
    return repeats.remove_repeats(docs, spec, shard_repeats, _render, id_col, text_col)
