"""Passages of benchmark items in documents, by Wu-Manber search over words.

Words are runs of letters and digits (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z are lower-cased). A test string
is a window of ``window`` consecutive words of an item, or all words of a shorter item.

* Items are cut into windows by Spark; (window, item) pairs are dealt by hash into blocks of bounded size, each
  broadcast by itself. Tables of a block, for each number of words that its strings have: the shift of every
  pair of neighbouring words (how far the search may move on where the text shows that pair), and the strings in
  buckets of their last pair.
* A task lays the words of many texts one after the other, cuts them into lanes and moves a cursor along each: the shift
  table skips positions where no string can end, and words are hashed only where a cursor stops. Where the shift
  is zero, the bucket of the last pair is searched for the hash of the whole window, and what is found is compared
  byte by byte with the string.
* One block (the usual case) needs neither a shuffle nor a second look at the documents. With more, each pass adds to the
  spans and items found so far and its result is written, so that a task holds one block only.

Defined results: null and empty texts have no words and items without words no string; rows of one item id are one item,
items without an id are together one, named by an empty string; repeated documents are rows of their own; windows cross neither
texts nor items; an empty table of items hits nothing, an empty table of documents gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import textbytes as tb
from flowlens.llm.lineage import Tables

WINDOW = 10
BLOCK = 32 << 20  # bytes of windows in one block
LANE = 48  # words of a lane
SLICE = 4 << 20

_BETWEEN = np.ones(256, dtype=bool)
_BETWEEN[0x80:] = False
_BETWEEN[ord("a") : ord("z") + 1] = False
_BETWEEN[ord("0") : ord("9") + 1] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(0xFFFFFFFF00000000)

FOUND = ["n_words", "spans", "items"]
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_TYPES = [pa.int64(), pa.list_(_SPAN), pa.list_(pa.string())]
_DDL = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def lowered(part: tb.Slice) -> tuple[np.ndarray, tb.Words]:
    """The bytes of a slice in lower case, and its words."""
    data = tb.lower_ascii(part.data)
    return data, tb.words(tb.Slice(part.first, data, part.offsets), _BETWEEN)


def joined(data: np.ndarray, words: tb.Words, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``count`` words from each ``first`` on, joined by single spaces: bytes and offsets."""
    at = tb.ranges(first, count)
    size = words.ends[at] - words.starts[at] + 1
    out = data[np.minimum(tb.ranges(words.starts[at], size), len(data) - 1)] if len(at) else np.zeros(0, np.uint8)
    ends = np.cumsum(size)
    out[ends - 1] = 0x20
    offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(count)])]
    return out, offsets


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tb.text_slices(batch.column(1)):
                data, words = lowered(part)
                sizes = np.diff(words.offsets)
                count = np.where(sizes > 0, np.maximum(sizes - window + 1, 1), 0)
                item = tb.expand(count)
                first, length = tb.ranges(words.offsets[:-1], count), np.minimum(sizes, window)[item]
                for at in range(0, len(first), 10_000):
                    few = slice(at, at + 10_000)
                    text, ends = joined(data, words, first[few], length[few])
                    many = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part.first + item[few])), many.cast(pa.binary()), pa.array(length[few], pa.int32())], names=["item", "string", "n"])

    return run


def strings(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, string, n): the distinct test strings of each item, each word followed by a space, and their number of words."""
    source = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_windows(window), "item string, string binary, n int").distinct()


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return tb.mix(left * _STEP + right)


def chained(hashes: np.ndarray) -> np.ndarray:
    """One hash of each row of word hashes."""
    out = np.full(len(hashes), hashes.shape[1], dtype=np.uint64)
    for column in hashes.T:
        out = tb.mix(out * _STEP + column)
    return out


def bucket_key(last: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The bucket (half of the last pair's hash), then half of the whole string's hash."""
    return (last & _HALF) | (whole >> np.uint64(32))


class Block:
    """Search tables of some (string, item) pairs whose strings have one number of words."""

    def __init__(self, strings: list[bytes], items: list[str], n: int):
        names, which = np.unique(np.array(items, dtype=object), return_inverse=True)
        self.names, self.n = names.tolist(), n  # np.unique sorts, so smaller numbers are smaller strings
        distinct, of = np.unique(np.array(strings, dtype=object), return_inverse=True)
        text = np.frombuffer(b"".join(distinct.tolist()), dtype=np.uint8)
        ends = np.cumsum([len(s) for s in distinct])
        words = tb.words(tb.Slice(0, text, np.concatenate([[0], ends])), _BETWEEN)
        hashes = tb.word_hashes(tb.Slice(0, text, np.concatenate([[0], ends])), words).reshape(len(distinct), n)
        blocks = pair_hash(hashes[:, :-1].ravel(), hashes[:, 1:].ravel()).reshape(len(distinct), n - 1) if n > 1 else hashes
        self.span = blocks.shape[1]  # the greatest shift
        bits = int(np.clip(int(blocks.size).bit_length() + 3, 10, 26))
        self.down = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, self.span, dtype=np.int64 if self.span > 255 else np.uint8)
        for place in range(self.span):
            np.minimum.at(self.shift, blocks[:, place] >> self.down, self.span - 1 - place)
        whole = chained(hashes)
        key = bucket_key(blocks[:, -1], whole)
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        starts = np.concatenate([[0], ends[:-1]])
        self.text, self.starts, self.sizes = text, starts[order], (ends - starts)[order]
        # the items of each string
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        by_string = np.lexsort((which, back[of]))
        self.item = which[by_string]
        self.item_edges = np.searchsorted(back[of][by_string], np.arange(len(order) + 1))

    def find(self, part: tb.Slice, data: np.ndarray, words: tb.Words) -> tuple[np.ndarray, np.ndarray]:
        """(first word, string) of every occurrence."""
        total, n = len(words.starts), self.n
        hash_of = lambda at: tb.word_hashes(part, tb.Words(words.starts[at], words.ends[at], None), data)
        cursor = np.arange(n - 1, total, LANE)
        stop = np.minimum(cursor + LANE, total)
        ends, seen = [], []
        while len(cursor):
            last = hash_of(cursor)
            block = pair_hash(hash_of(cursor - 1), last) if n > 1 else last
            move = self.shift[block >> self.down]
            zero = move == 0
            ends.append(cursor[zero])
            seen.append(block[zero])
            cursor = cursor + np.maximum(move, 1)
            live = cursor < stop
            cursor, stop = cursor[live], stop[live]
        none = np.zeros(0, dtype=np.int64)
        if not ends:
            return none, none
        end, block = np.concatenate(ends), np.concatenate(seen)
        first = end - n + 1
        text = np.searchsorted(words.offsets, end, "right")
        bucket = np.minimum(np.searchsorted(self.key, block & _HALF), len(self.key) - 1)
        fits = (words.offsets[text - 1] <= first) & ((self.key[bucket] & _HALF) == (block & _HALF))
        first, block = first[fits], block[fits]
        if not len(first):
            return none, none
        key = bucket_key(block, chained(hash_of((first[:, None] + np.arange(n)[None, :]).ravel()).reshape(len(first), n)))
        string, out = np.searchsorted(self.key, key), []
        while True:  # nearly always twice: strings with one key follow each other
            left = string < len(self.key)
            left[left] = self.key[string[left]] == key[left]
            first, key, string = first[left], key[left], string[left]
            if not len(first):
                break
            same = self._equal(data, words, first, string)
            out.append((first[same], string[same]))
            string = string + 1
        if not out:
            return none, none
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _equal(self, data: np.ndarray, words: tb.Words, first: np.ndarray, string: np.ndarray) -> np.ndarray:
        out = np.zeros(len(first), dtype=bool)
        for at in range(0, len(first), 1 << 14):
            few = np.arange(at, min(at + (1 << 14), len(first)))
            text, ends = joined(data, words, first[few], np.full(len(few), self.n))
            size = np.diff(ends)
            few_same = size == self.sizes[string[few]]
            mine = np.flatnonzero(few_same)
            differ = text[tb.ranges(ends[mine], size[mine])] != self.text[tb.ranges(self.starts[string[few[mine]]], size[mine])]
            wrong = np.add.reduceat(differ, np.cumsum(size[mine]) - size[mine]) if len(mine) else np.zeros(0)
            out[few[mine]] = wrong == 0
        return out


def _merged(n_words: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: np.ndarray) -> pa.Array:
    """Maximal runs of words covered by spans of texts (positions in the words of all texts)."""
    edges = np.concatenate([[0], np.cumsum(n_words)])
    change = np.zeros(edges[-1] + 1, dtype=np.int64)
    np.add.at(change, edges[text] + starts, 1)
    np.add.at(change, edges[text] + ends, -1)
    hit = np.cumsum(change)[:-1] > 0
    cut = np.zeros(len(hit) + 1, dtype=bool)
    cut[edges] = True
    begin, end = hit.copy(), hit.copy()
    begin[1:] &= ~hit[:-1] | cut[1:-1]
    end[:-1] &= ~hit[1:] | cut[1:-1]
    first, last = np.flatnonzero(begin), np.flatnonzero(end) + 1
    at = np.searchsorted(first, edges)
    base = np.repeat(edges[:-1], np.diff(at))
    spans = pa.StructArray.from_arrays([pa.array(first - base, pa.int64()), pa.array(last - base, pa.int64())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), spans)


def _hits(sent, n_carried: int, again: bool, with_text: bool):
    """Carried columns, and what the strings of a broadcast list of blocks hit, added to what earlier passes did (``again``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[Block] = sent.value
        for batch in batches:
            spans = [batch.column(n_carried + 2), batch.column(n_carried + 3)] if again else None
            for part in tb.text_slices(batch.column(0), SLICE):
                data, words = lowered(part)
                sizes, rows = np.diff(words.offsets), slice(part.first, part.first + len(part))
                starts, ends, texts, named = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [set() for _ in range(len(part))]
                if again:
                    before = spans[0].slice(part.first, len(part))
                    flat = before.flatten()
                    starts.append(np.asarray(flat.field("start")))
                    ends.append(np.asarray(flat.field("end")))
                    texts.append(np.repeat(np.arange(len(part)), [len(x) for x in before]))
                    for have, names in zip(named, spans[1].slice(part.first, len(part)).to_pylist(), strict=True):
                        have.update(names)
                for block in blocks:
                    first, string = block.find(part, data, words)
                    text = np.searchsorted(words.offsets, first, "right") - 1
                    starts.append(first - words.offsets[text])
                    ends.append(first - words.offsets[text] + block.n)
                    texts.append(text)
                    met = np.unique(text * len(block.starts) + string)
                    for t, s in zip((met // len(block.starts)).tolist(), (met % len(block.starts)).tolist(), strict=True):
                        named[t].update(block.names[i] for i in block.item[block.item_edges[s] : block.item_edges[s + 1]].tolist())
                found = [pa.array(sizes, pa.int64()), _merged(sizes, *(np.concatenate(x) for x in (starts, ends, texts))), pa.array([sorted(x) for x in named], pa.list_(pa.string()))]
                carried = [batch.column(1 + i)[rows] for i in range(n_carried)]
                text = [batch.column(0)[rows]] if with_text else []
                yield pa.RecordBatch.from_arrays([*text, *carried, *(a.cast(t) for a, t in zip(found, _TYPES, strict=True))], names=[*(["text"] if with_text else []), *(f"c{i}" for i in range(n_carried)), *FOUND])

    return run


def find_passages(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, block: int = BLOCK
) -> DataFrame:
    """The columns ``keep`` (all, if not given) of every row of ``docs``, and leak_n_words, leak_spans (the maximal runs of
    words, half-open, that occurrences of test strings cover) and leak_items (ids of their items as strings, sorted)."""
    spark, tables = docs.sparkSession, Tables(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    carried = [c for c in keep if c != text_col]
    source = docs.select(F.col(text_col).cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)])
    ddl = "".join(f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}, " for i in range(len(carried))) + _DDL
    pairs = tables.write(strings(items, item_id_col, item_text_col, window))
    bytes_of = pairs.agg(F.sum(F.octet_length("string") + F.octet_length("item"))).first()[0] or 0
    n_blocks = max(1, -(-bytes_of // block))
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("string", "item"), F.lit(n_blocks)))
    rows, before = source, None
    for b in range(n_blocks):
        few = dealt.where(F.col("block") == b).select("string", "item", "n").toArrow()
        lengths = np.asarray(few["n"])
        some = [few.filter(pa.array(lengths == n)) for n in np.unique(lengths).tolist()]
        sent = spark.sparkContext.broadcast([Block(t["string"].to_pylist(), t["item"].to_pylist(), t["n"][0].as_py()) for t in some])
        with_text = text_col in keep or b + 1 < n_blocks
        rows = rows.mapInArrow(_hits(sent, len(carried), b > 0, with_text), f"text string, {ddl}" if with_text else ddl)
        if b + 1 < n_blocks:
            rows = tables.write(rows)
            if before is not None:
                tables.drop(before)
            before = rows
    tables.drop(pairs)
    back = {text_col: "text"} | {c: f"c{i}" for i, c in enumerate(carried)}
    return rows.select(*[F.col(back[c]).alias(c) for c in keep], *[F.col(c).alias(f"leak_{c}") for c in FOUND])
