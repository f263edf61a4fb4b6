"""Near duplicates by circulant MinHash, with exact verification.

A document's set holds its distinct shingles of ``shingle`` words (words ``[^\\x20\\x09-\\x0D]+``, A-Z
lowered). All signature coordinates come from two permutations: the first (a 64-bit mixer reduced to a
table of places) spreads the shingles, the second (a random permutation table) is read with a circular
shift of k for coordinate k. Coordinates are banded; documents that share a band are candidates, and
every link is confirmed on the full sets of shingle hashes (64 bits, each mixed from hashes of its words).

* Equal sets are one class first, so groups of copies cost one member.
* In a round each bucket has a leader. In the first it is the member that shares most buckets with others, and each
  member is compared with one of its leaders. In the second it is the member whose shingles are held by most others:
  of an original and its closest copies, which share the same buckets, that is the original, and only it
  may be similar enough to copies with many edits. There each member is compared with one leader of each component
  that it meets. What is linked becomes one component, and buckets inside one component close.
* What then remains in open buckets meets by an exact prefix filter: shingles are ordered from rare to
  frequent, and two sets that are similar enough share one among the first of each. In a crowd of documents
  that hold one passage, or of copies edited too much to be linked, the first shingles are those of the
  document alone, so such a bucket does not make all its pairs. Of the pairs that the filter leaves, one of
  each document and component is checked first, and then those that still join different components.
* Before texts are fetched, a pair must pass a bound that no link misses: of two sets that may differ in d
  shingles, bitmaps of parities differ in d bits at most.
* Only pairs inside one component, which cannot change the result, are never compared. A leader's text
  travels once for each ``CHUNK`` of its members. Sets too small to reach the similarity with any other set
  are not compared. Tables of a round are deleted in the next one.
* Before a join deals texts, a bitmap of the ids that it asks for, broadcast in words of 64 bits, drops the others where
  they are read. Ids that fall on the same bits let a text through that the join then drops; none is lost.

``plan`` derives the bands from the similarity: as if coordinates were independent, a pair just at it shares no
band with probability 5e-8 at most (at 0.8: 32 bands of 4). Nothing else can lose a link.

Defined results: null or wordless texts have 0 shingles and link with nothing; fewer words than a
shingle count as one shingle; rows with one id and one text are one document; rows with one id and
different texts are documents of their own, ordered by a hash of the text; a null id is ordered after all
ids; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import textbytes as tb
from flowlens.llm.components import contracted
from flowlens.llm.lineage import Tables
from flowlens.llm.repeats import NO_ID, ids_of

SHINGLE = 5
SIMILARITY = 80
COORDINATES = 256
PLACES = 1 << 20
ROUNDS = 2
BANDS_MISS = 5e-8
BITS = 1024  # of a bitmap of parities
SLOTS = 1 << 20  # counters of shingles, for their order only
CHUNK = 256
SIEVE = 1 << 24  # bits that tell which texts a join asks for

_SIGNATURE = "id bigint, tag bigint, n_shingles bigint, f1 bigint, f2 bigint, bands array<bigint>, bitmap array<bigint>"


@cache
def plan(percent: int) -> tuple[int, int]:
    """(bands, rows of a band) that lose a pair of that similarity with probability BANDS_MISS at most."""
    same = percent / 100
    for rows in (4, 3, 2, 1):
        bands = next((n for n in range(1, COORDINATES // rows + 1) if (1 - same**rows) ** n <= BANDS_MISS), None)
        if bands:
            return bands, rows
    raise ValueError(f"{COORDINATES} coordinates cannot find pairs of similarity {percent} %")


@cache
def shifted_permutation() -> np.ndarray:
    """Row i holds the second permutation at places i, i + 1, ... (circular), one for each coordinate."""
    table = np.random.default_rng(7).permutation(PLACES).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:COORDINATES]]), COORDINATES)


def _chained(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` consecutive word hashes."""
    n = len(hashes) - size + 1
    out = hashes[:n].copy()
    for k in range(1, size):
        out = tb.mix(out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + n])
    return out


def shingle_sets(part: tb.Slice, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a slice."""
    found = tb.words(part)
    hashes = tb.word_hashes(part, found, tb.lower_ascii(part.data))
    windows = _chained(hashes, size) if len(hashes) >= size else hashes[:0]
    out = []
    for begin, end in zip(found.offsets[:-1].tolist(), found.offsets[1:].tolist(), strict=True):
        if end - begin >= size:
            each = np.sort(windows[begin : end - size + 1])
            out.append(each[np.concatenate([[True], each[1:] != each[:-1]])])
        else:  # fewer words than a shingle are one shingle
            out.append(_chained(hashes[begin:end], end - begin) if end > begin else hashes[:0])
    return out


def signature(values: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """The first ``coordinates`` coordinates of one set."""
    places = (tb.mix(values ^ np.uint64(0xA5A5F00D12345678)) % np.uint64(PLACES)).astype(np.int64)
    table = shifted_permutation()[:, :coordinates]
    out = np.full(coordinates, np.iinfo(np.uint32).max, dtype=np.uint32)
    for i in range(0, len(places), 2048):
        np.minimum(out, table[places[i : i + 2048]].min(axis=0), out=out)
    return out


def parities(values: np.ndarray) -> np.ndarray:
    """BITS bits: whether an odd number of the set's shingles falls on each."""
    spots = (tb.mix(values ^ np.uint64(0x2545F4914F6CDD1D)) % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(spots, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def _signatures(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = ids_of(batch.column(0))
            for part in tb.text_slices(batch.column(1)):
                sets = shingle_sets(part, size)
                counts = np.array([len(s) for s in sets], dtype=np.int64)
                some = np.flatnonzero(counts)
                marks = np.stack([signature(sets[i], bands * rows) for i in some]) if len(some) else np.zeros((0, bands * rows), np.uint32)
                bitmaps = np.stack([parities(sets[i]) for i in some]) if len(some) else np.zeros((0, BITS // 64), np.int64)
                grouped = marks.astype(np.uint64).reshape(len(some), bands, rows)
                key = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                for r in range(rows):
                    key = tb.mix(key + grouped[:, :, r] + np.uint64(1))
                zero = np.zeros(len(sets), dtype=np.uint64)
                prints = [zero, zero.copy()]
                for i in some:
                    spread = tb.mix(sets[i] ^ np.uint64(0x5851F42D4C957F2D))
                    prints[0][i], prints[1][i] = spread.sum(dtype=np.uint64), np.bitwise_xor.reduce(spread)
                at = np.concatenate([[0], np.cumsum((counts > 0).astype(np.int32))]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).view(np.int64).ravel())) for x in (key, bitmaps)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[part.first : part.first + len(part)]), batch.column(2).slice(part.first, len(part)), pa.array(counts), *(pa.array(p.view(np.int64)) for p in prints), *lists],
                    names=["id", "tag", "n_shingles", "f1", "f2", "bands", "bitmap"],
                )

    return run


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common > 0 and 100 * common >= percent * (len(both) - common)


def _confirm(size: int, percent: int):
    """Links of rows (lead, member, la, lb, text) sorted so that a lead's own row (no member) comes before its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, held = None, None
        for batch in batches:
            leads, members = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            keep = np.zeros(len(batch), dtype=bool)
            for part in tb.text_slices(batch.column(4)):
                for i, own in enumerate(shingle_sets(part, size), part.first):
                    if members[i] is None:
                        lead, held = leads[i], own
                    else:
                        keep[i] = lead == leads[i] and similar(held, own, percent)
            yield pa.RecordBatch.from_arrays(batch.columns[2:4], names=["a", "b"]).filter(pa.array(keep))

    return run


def _slots(size: int):
    """How many sets of a task hold shingles of each counter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, dtype=np.int64)
        for batch in batches:
            for part in tb.text_slices(batch.column(2)):
                for own in shingle_sets(part, size):
                    np.add.at(counts, (own % np.uint64(SLOTS)).astype(np.int64), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["slot", "n"])

    return run


def _common(size: int, frequency: np.ndarray):
    """(rep, common): the mean logarithm of the number of sets that hold a shingle of the set."""
    weight = np.log2(np.maximum(frequency, 1)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            means = []
            for part in tb.text_slices(batch.column(1)):
                means += [float(weight[(own % np.uint64(SLOTS)).astype(np.int64)].mean()) for own in shingle_sets(part, size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(means, pa.float64())], names=["rep", "common"])

    return run


def _prefixes(size: int, percent: int, frequency: np.ndarray):
    """(token, rep, label, n, at, short): the first shingles of each set, rare ones first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, labels = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for part in tb.text_slices(batch.column(2)):
                found = []
                for i, own in enumerate(shingle_sets(part, size), part.first):
                    n = len(own)
                    first = own[np.argsort(frequency[(own % np.uint64(SLOTS)).astype(np.int64)], kind="stable")][: n - -(-percent * n // 100) + 1]
                    found.append((first, np.full(len(first), i), np.full(len(first), n), np.arange(len(first))))
                token, row, n, at = (np.concatenate(x) for x in zip(*found, strict=True))
                short = at <= n - -(-2 * percent * n // (100 + percent))
                columns = [token.view(np.int64), reps[row], labels[row], n.astype(np.int32), at.astype(np.int32), short]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "rep", "label", "n", "at", "short"])

    return run


class _Open:
    """The members of buckets, their components so far (``members``: rep, label), and how links are found."""

    def __init__(self, tables: Tables, buckets: DataFrame, texts: DataFrame, marks: DataFrame, shingle: int, percent: int):
        self.tables, self.buckets, self.texts, self.marks, self.shingle, self.percent = tables, buckets, texts, marks, shingle, percent
        self.members = tables.write(buckets.select("rep", F.col("rep").alias("label")).distinct())

    def open_buckets(self) -> DataFrame:
        """(key, rep, label, hits) of buckets that hold several components."""
        known = self.buckets.join(self.members, "rep")
        mixed = known.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
        return known.join(mixed, "key")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, la, lb) whose sizes and bitmaps allow a link, and how many bits differ."""
        left, right = (self.marks.select(F.col("id").alias(c), F.col("n_shingles").alias(f"n{c}"), F.col("bitmap").alias(f"m{c}")) for c in "ab")
        apart = sum((F.bit_count(F.col("ma")[i].bitwiseXOR(F.col("mb")[i])) for i in range(BITS // 64)), F.lit(0))
        sizes = F.least("na", "nb") * 100 >= F.greatest("na", "nb") * self.percent
        known = pairs.join(left, "a").join(right, "b").where(sizes).select("a", "b", "la", "lb", apart.alias("apart"), (F.col("na") + F.col("nb")).alias("both"))
        return known.where(F.col("apart") * (100 + self.percent) <= F.col("both") * (100 - self.percent)).select("a", "b", "la", "lb", "apart")

    def sieved(self, ids: DataFrame) -> DataFrame:
        """(id, text) of all documents of ``ids(id)``, and of few others."""
        word, bit = F.pmod(F.xxhash64("id"), F.lit(SIEVE // 64)), F.pmod(F.shiftrightunsigned(F.xxhash64("id"), 40), F.lit(64))
        asked = ids.select(word.alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int")).alias("bit"))
        words = F.broadcast(asked.groupBy("word").agg(F.bit_or("bit").alias("bits")))
        return self.texts.join(words, word == words["word"]).where(F.getbit("bits", bit.cast("int")) == 1).select("id", "text")

    def absorb(self, pairs: DataFrame, text: DataFrame) -> None:
        """Confirms a table of pairs on their texts (id, text), and joins the components of those linked. ``b`` leads."""
        chunks = F.ceil(F.count("*") / CHUNK).cast("bigint").alias("chunks")
        leads = pairs.groupBy("b").agg(chunks)
        mine = pairs.join(leads, "b").select("b", F.pmod(F.xxhash64("a"), "chunks").alias("chunk"), "a", "la", "lb")
        members = mine.join(text.withColumnRenamed("id", "a"), "a").select("b", "chunk", "a", "la", "lb", "text")
        own = leads.join(text.withColumnRenamed("id", "b"), "b")
        none = F.lit(None).cast("bigint")
        own = own.select("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("chunk"), none.alias("a"), none.alias("la"), none.alias("lb"), "text")
        met = members.union(own).repartition("b", "chunk").sortWithinPartitions("b", "chunk", F.col("a").asc_nulls_first())
        found = met.select("b", "a", "la", "lb", "text").mapInArrow(_confirm(self.shingle, self.percent), "a bigint, b bigint")
        moved = contracted(found, self.tables)
        before = self.members
        now = before.join(moved.select(F.col("a").alias("label"), F.col("b").alias("low")), "label", "left")
        self.members = self.tables.write(now.select("rep", F.coalesce("low", "label").alias("label")))
        self.tables.drop(before, moved)

    def frequency(self, texts: DataFrame) -> np.ndarray:
        """How many of ``texts(rep, label, text)`` hold shingles of each counter."""
        counts = texts.mapInArrow(_slots(self.shingle), "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
        frequency = np.zeros(SLOTS, dtype=np.uint32)
        frequency[np.asarray(counts["slot"].combine_chunks())] = np.minimum(np.asarray(counts["n"].combine_chunks()), np.iinfo(np.uint32).max)
        return frequency

    def texts_of(self, opened: DataFrame) -> DataFrame:
        reps = self.tables.write(opened.select("rep", "label").distinct())
        texts = self.sieved(reps.select(F.col("rep").alias("id"))).withColumnRenamed("id", "rep")
        out = self.tables.write(reps.join(texts, "rep").select("rep", "label", "text"))
        self.tables.drop(reps)
        return out

    def meet_leaders(self, turn: int) -> None:
        """Each member of an open bucket is compared with one leader, or with one of each other component that leads its buckets."""
        opened = self.tables.write(self.open_buckets())
        ranked, texts = opened.withColumn("rank", F.col("hits").cast("double") if turn == 0 else F.lit(0.0)), []
        if turn == 1:
            texts = [self.texts_of(opened)]
            common = texts[0].select("rep", "text").mapInArrow(_common(self.shingle, self.frequency(texts[0])), "rep bigint, common double")
            ranked = opened.join(common, "rep").withColumnRenamed("common", "rank")
        order = F.struct("rank", F.xxhash64(F.col("rep"), F.lit(turn)))
        lead = ranked.groupBy("key").agg(F.max_by("rep", order).alias("b"), F.max_by("label", order).alias("lb"))
        met = opened.join(lead, "key").where("label <> lb").groupBy(F.col("rep").alias("a"), "b").agg(F.count("*").alias("n"), F.first("label").alias("la"), F.first("lb").alias("lb"))
        if turn == 1:
            near = self.bounded(met.select("a", "b", "la", "lb"))
            best = near.groupBy("a", "lb").agg(F.min_by(F.struct("b", "la"), F.struct("apart", "b")).alias("x")).select("a", "x.b", "x.la", "lb")
        else:
            best = self.bounded(met.groupBy("a").agg(F.max_by(F.struct("b", "la", "lb"), F.struct("n", "b")).alias("x")).select("a", "x.b", "x.la", "x.lb"))
        pairs = self.tables.write(best)
        self.absorb(pairs, texts[0].select(F.col("rep").alias("id"), "text") if texts else self.sieved(pairs.select(F.explode(F.array("a", "b")).alias("id"))))
        self.tables.drop(opened, pairs, *texts)

    def meet_by_prefix(self) -> None:
        """All pairs of different components that are left in open buckets and may be linked."""
        texts = self.texts_of(self.open_buckets())
        frequency = self.frequency(texts)
        first = texts.mapInArrow(_prefixes(self.shingle, self.percent, frequency), "token bigint, rep bigint, label bigint, n int, at int, short boolean")
        larger = first.select("token", F.col("rep").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("at").alias("ia"))
        smaller = first.where("short").select("token", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("at").alias("ib"))
        fits = (F.col("la") != F.col("lb")) & ((F.col("na") > F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") > F.col("b"))) & (F.col("nb") * 100 >= F.col("na") * self.percent)
        # what can still be shared from the shared one on, against what a link of these sizes shares
        reach = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) * (100 + self.percent) >= (F.col("na") + F.col("nb")) * self.percent
        near = larger.join(smaller, (larger["token"] == smaller["token"]) & fits & reach).select("a", "b", "la", "lb").distinct()
        pairs = self.tables.write(self.bounded(near))
        text = texts.select(F.col("rep").alias("id"), "text")
        one = pairs.groupBy("a", "lb").agg(F.min_by(F.struct("b", "la"), F.struct("apart", "b")).alias("x")).select("a", "x.b", "x.la", "lb")
        self.absorb(one, text)
        label = self.members.select("rep", "label")
        left = pairs.select("a", "b").join(label.toDF("a", "la"), "a").join(label.toDF("b", "lb"), "b").where("la <> lb")
        rest = self.tables.write(left)
        self.absorb(rest, text)
        self.tables.drop(texts, pairs, rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = SIMILARITY, rounds: int = ROUNDS, hash_col: str | None = None) -> DataFrame:
    """One row for each row of ``docs``: id (named as given), n_shingles, component_id, kept.

    With ``hash_col`` a column of that name holds xxhash64 of the row's text, which tells apart rows of one id.

    Documents are linked where 100 * intersection >= ``percent`` * union of their shingle sets;
    component_id is the id of the smallest document reachable by links (by id, then by a hash of the text),
    kept is whether that is the row's own document.
    """
    source = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    bands, band_rows = plan(percent)
    tables, known = Tables(docs.sparkSession), None
    if not source.groupBy("id").count().where("count > 1").isEmpty():  # ids do not tell documents apart: number them in order
        counted = source.groupBy("id", "text").agg(F.count("*").alias("n_rows")).withColumn("tag", F.xxhash64("text"))
        ranged = counted.repartitionByRange("id", "tag", "text").sortWithinPartitions("id", "tag", "text")
        numbered = tables.write(ranged.select(F.monotonically_increasing_id().alias("node"), "id", "n_rows", "text"))
        known, source = numbered.select("node", F.col("id").alias("name"), "n_rows"), numbered.select(F.col("node").alias("id"), "text")
    marks = tables.write(source.withColumn("tag", F.xxhash64("text")).mapInArrow(_signatures(shingle, bands, band_rows), _SIGNATURE))
    some = marks.where("n_shingles > 0")
    classes = tables.write(some.groupBy("f1", "f2", "n_shingles").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("bitmap").alias("bitmap")))
    # a set can only be linked with another one if its size and the next are similar enough
    keyed = classes.where(F.col("n_shingles") * 100 >= (F.col("n_shingles") + 1) * percent).select("rep", F.explode("bands").alias("key"))
    crowded = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = keyed.join(crowded, "key")
    hits = shared.groupBy("rep").agg(F.sum("size").alias("hits"))
    buckets = tables.write(shared.select("key", "rep").join(hits, "rep"))
    # texts stay where they are: only those of pairs and of open buckets move (``sieved``)
    left = _Open(tables, buckets, source, classes.select(F.col("rep").alias("id"), "n_shingles", "bitmap"), shingle, percent)
    for turn in range(rounds):
        left.meet_leaders(turn)
    left.meet_by_prefix()
    tables.drop(buckets)
    placed = marks.join(classes.select("f1", "f2", "n_shingles", "rep"), ["f1", "f2", "n_shingles"], "left").join(left.members, "rep", "left")
    out = placed.withColumn("low", F.coalesce("label", "rep", "id")).select("id", "tag", "n_shingles", "low", (F.col("id") == F.col("low")).alias("kept"))
    if known is not None:
        out = out.join(known.withColumnRenamed("node", "id"), "id").drop("id").join(known.select(F.col("node").alias("low"), F.col("name").alias("low_name")), "low")
        out = out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows")))).select(F.col("name").alias("id"), "tag", "n_shingles", F.col("low_name").alias("low"), "kept")
    out = tables.write(out)  # narrow rows; the signatures and numbered texts need not stay
    tables.drop(marks, classes, left.members, *([numbered] if known is not None else []))
    named = [F.when(F.col(c) != NO_ID, F.col(c)).alias(n) for c, n in (("id", id_col), ("low", "component_id"))]
    return out.select(named[0], "n_shingles", named[1], "kept", *([F.col("tag").alias(hash_col)] if hash_col else []))
