"""Language identification by prediction with partial matching.

Each language has a byte context tree: how often each byte followed each context of up to ``order``
bytes in the language's training texts. A byte's code length comes from the longest context that the
tree holds: seen bytes share n / (n + d) of its probability (n occurrences, d different bytes), the
escape d / (n + d) passes to the next shorter context with the bytes already seen excluded, and past
the empty context all 256 bytes are equal. Counts are frozen after training, so the code lengths of
all (context, byte) pairs are computed once into a table, and a text's exact code length under every
language is a sum of table entries. The language with the shortest code wins; the score is its
posterior probability, all languages being equally likely before.

Training takes a bounded sample: per language the texts of about ``max_docs`` documents, chosen by a
hash of their ids; their context counts are added up in Spark. The table's size is bounded by the
sample's contexts, so it can be broadcast. Scoring reads every whole text.

Defined results: texts that are null or have no letter are ``und`` with score 0 (as is every text if
nothing is labelled); repeated rows get a result each; an empty table gives an empty table; other
columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm import textbytes as tb

UNKNOWN = "und"
ORDER = 3
MAX_DOCS = 1500
_PAD = 0x0A  # texts begin as after a line's end

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


@dataclass(frozen=True)
class LanguageModel:
    """Code lengths: ``cost[row, symbol, language]`` in bits.

    ``symbols`` maps bytes to the symbols of the training texts (the last stands for all other bytes),
    ``row`` gives the table row of a context of ORDER symbols (its longest suffix that any tree holds).
    """

    languages: list[str]
    symbols: np.ndarray
    row: np.ndarray
    cost: np.ndarray

    def bits(self, part: tb.Slice) -> np.ndarray:
        """Code lengths of the texts of a slice under each language."""
        out = np.zeros((len(part), len(self.languages)))
        if not len(part.data):
            return out
        codes, kinds = self.symbols[part.data], int(self.symbols.max()) + 1
        context = np.zeros(len(codes), dtype=np.int64)
        for back in range(ORDER, 0, -1):
            earlier = np.full(len(codes), self.symbols[_PAD])
            earlier[back:] = codes[:-back]
            for k in range(back):  # the first bytes of a text do not see the text before it
                at = part.offsets[:-1] + k
                earlier[at[at < part.offsets[1:]]] = self.symbols[_PAD]
            context = context * kinds + earlier
        each = self.cost[self.row[context], codes]
        full = np.flatnonzero(np.diff(part.offsets))
        out[full] = np.add.reduceat(each, part.offsets[full], axis=0, dtype=np.float64)
        return out


def _count_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n): how often ORDER bytes and the next byte occur, packed in one integer."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        for part in tb.text_slices(batch.column(1)):
            grams: dict[str, list[np.ndarray]] = {}
            for i in range(len(part)):
                data = part.data[part.offsets[i] : part.offsets[i + 1]].astype(np.int64)
                padded = np.concatenate([np.full(ORDER, _PAD), data])
                packed = np.zeros(len(data), dtype=np.int64)
                for k in range(ORDER + 1):
                    packed = packed * 256 + padded[k : k + len(data)]
                grams.setdefault(langs[part.first + i], []).append(packed)
            for lang, found in grams.items():
                distinct, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(distinct), pa.string()), pa.array(distinct), pa.array(counts.astype(np.int64))], names=["lang", "gram", "n"])


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """The model of each language's (grams, counts)."""
    languages = sorted(counts)
    seen = np.unique(np.concatenate([g % 256 for g, _ in counts.values()] + [np.array([_PAD])]))
    kinds = len(seen) + 1
    symbols = np.full(256, kinds - 1, dtype=np.int64)
    symbols[seen] = np.arange(len(seen))
    others = 256 - len(seen)
    flat = np.append(np.ones(len(seen)), others) / 256  # past the empty context; the last entry is all other bytes together

    grams = {}
    for lang, (gram, n) in counts.items():
        code = np.zeros(len(gram), dtype=np.int64)
        for k in range(ORDER, -1, -1):
            code = code * kinds + symbols[(gram >> (8 * k)) & 255]
        grams[lang] = (code, n)
    # contexts of each order that any language holds, in rows: the empty one first, the longest last
    held = [np.unique(np.concatenate([c // kinds % kinds**k for c, _ in grams.values()])) for k in range(ORDER + 1)]
    first = np.concatenate([[0], np.cumsum([len(h) for h in held])])
    cost = np.empty((first[-1], kinds, len(languages)), dtype=np.float32)
    for at, lang in enumerate(languages):
        code, n = grams[lang]
        shorter = flat[None, :]
        for k in range(ORDER + 1):
            context, symbol = code // kinds % kinds**k, code % kinds
            table = np.zeros((len(held[k]), kinds))
            np.add.at(table, (np.searchsorted(held[k], context), symbol), n)
            known = table > 0
            total, different = table.sum(axis=1, keepdims=True), known.sum(axis=1, keepdims=True)
            below = shorter[np.searchsorted(held[k - 1], held[k] % kinds ** (k - 1))] if k else np.repeat(shorter, len(held[0]), axis=0)
            rest = np.where(known, 0, below)
            left = rest.sum(axis=1, keepdims=True)
            escape = np.where(left > 0, different / np.maximum(total + different, 1), 0)  # all bytes seen: nothing to escape to
            shared = table / np.maximum(total, 1) * (1 - escape)
            shorter = np.where(total > 0, shared + escape * rest / np.where(left > 0, left, 1), below)
            each = shorter.copy()
            each[:, -1] /= max(others, 1)
            cost[first[k] : first[k + 1], :, at] = -np.log2(np.maximum(each, 1e-12))
    row = np.zeros(kinds**ORDER, dtype=np.int32)
    every = np.arange(kinds**ORDER)
    for k in range(1, ORDER + 1):
        suffix = every % kinds**k
        place = np.minimum(np.searchsorted(held[k], suffix), len(held[k]) - 1)
        row = np.where(held[k][place] == suffix, first[k] + place, row).astype(np.int32)
    return LanguageModel(languages, symbols, row, cost)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> LanguageModel | None:
    """A model of the rows with a language and a text; None if there are none."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    sizes = {r.lang: r.n for r in labelled.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.lit(0)
    for lang, n in sizes.items():  # a language with few documents gives all of them
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, -(-(1 << 20) * max_docs // n)))).otherwise(share)
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share).select("lang", "text")
    counts = sample.mapInArrow(_count_contexts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()  # bounded by the sample
    if not len(counts):
        return None
    lang, gram, n = (counts[c].combine_chunks() for c in ("lang", "gram", "n"))
    each = {name: pa.compute.equal(lang, name) for name in lang.unique().to_pylist()}
    return build({name: (np.asarray(gram.filter(mine)), np.asarray(n.filter(mine))) for name, mine in each.items()})


def _classifier(model, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.value if model is not None else None
        for batch in batches:
            texts = batch.column(column)
            lang, score = np.full(len(batch), UNKNOWN, dtype=object), np.zeros(len(batch))
            for part in tb.text_slices(texts) if own is not None else ():
                letters = np.concatenate([[0], np.cumsum(_LETTER[part.data])])
                has = letters[part.offsets[1:]] > letters[part.offsets[:-1]]
                for i in np.flatnonzero(~has & (np.diff(part.offsets) > 0)):
                    has[i] = any(map(str.isalpha, texts[part.first + int(i)].as_py()))
                bits = own.bits(part)
                best = bits.argmin(axis=1)
                share = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
                at = np.flatnonzero(has)
                lang[part.first + at] = np.array(own.languages, dtype=object)[best[at]]
                score[part.first + at] = share[at]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names, "lang_pred", "lang_score"])

    return run


def classify(docs: DataFrame, model: LanguageModel | None, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "lang_score") -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1)."""
    names = docs.columns
    inner = docs.toDF(*[f"c{i}" for i in range(len(names))])
    shared = docs.sparkSession.sparkContext.broadcast(model) if model is not None else None
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema) + ", lang_pred string, lang_score double"
    out = inner.mapInArrow(_classifier(shared, names.index(text_col)), ddl)
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col("lang_pred").alias(lang_out), F.col("lang_score").alias(score_out))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text is a multiple of five."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = MAX_DOCS) -> DataFrame:
    """Learns from the labelled documents that are not held out, and classifies all of them."""
    return classify(docs, train(docs.where(~held_out(id_col)).where(F.col(id_col).isNotNull()), id_col, text_col, lang_col, max_docs), text_col)
