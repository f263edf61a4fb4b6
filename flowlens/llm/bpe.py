"""Exact BPE encoding in linear time, and decoding from an offset table.

The vocabulary file (its path is a parameter) is a BPE with word ends: text is NFC-normalised and
lower-cased, split by a pattern that drops white space, and the bytes of each piece are merged by rank.
``WordBPE`` finds the same tokens without replaying merges: an Aho-Corasick automaton gives all tokens
that match in a piece, the longest at each place is tried first, and a token is accepted if the pair with
its predecessor is compatible, that is, if merging by rank could leave that boundary standing. If none
fits, the last token is taken back and its next shorter prefix tried; places found to be dead ends are
never entered again, so each piece takes linear time. Pieces are remembered in a bounded table; the short
ones that are new to it take these steps together (``bpe_batch``), long ones one by one.

Decoding concatenates the vocabulary's strings, a space between tokens (the file names no decoder), by
one gather over a table of all strings and their offsets.

Defined results: null text is empty text (no tokens, decoded empty); special-token strings in a text
are their ids, as in the tokenizers library; texts of any length are encoded whole; rows and other
columns are kept as they are.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm import textbytes as tb
from flowlens.llm.bpe_batch import Batch

REMEMBERED = 400_000
WORDS = 1 << 18
SHORT = 64  # characters of a piece that is encoded with others and remembered
_SIGNS = frozenset(".,;:!?")
_CONTROLS = regex.compile(r"[\x1c-\x1f]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, spare = [""] * 256, 0x100
    for b in range(256):
        if b in plain:
            letters[b] = chr(b)
        else:
            letters[b], spare = chr(spare), spare + 1
    return letters


class WordBPE:
    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab = {**model["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.letters = _byte_letters()
        # a symbol for each byte, and another for a byte that ends a word
        self.symbol = [chr(b) for b in range(256)]
        self.last = [chr(256 + b) for b in range(256)]
        back = {c: b for b, c in enumerate(self.letters)}

        def spell(token: str) -> str:
            body = token.removesuffix(self.end)
            out = [self.symbol[back[c]] for c in body]
            return "".join(out if body == token else [*out[:-1], self.last[back[body[-1]]]])

        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        size = max(vocab.values()) + 1
        self.left, self.right = np.arange(size).tolist(), np.arange(size).tolist()
        self.rank = [-1] * size  # of the merge that makes a token; -1 for single symbols
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            made, x, y = vocab[a + b], vocab[a], vocab[b]
            self.pairs[x, y] = rank
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, x, y
        used = {t: i for t, i in model["vocab"].items() if self.rank[i] >= 0 or len(t.removesuffix(self.end)) == 1}
        self.length = [0] * size
        self.automaton = ahocorasick.Automaton()
        spelled = {spell(t): i for t, i in used.items()}
        for text, i in spelled.items():
            self.length[i] = len(text)
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.longest = max(self.length)  # symbols; a search looks no farther
        self.shorter = [-1] * size  # the longest token that is a proper prefix
        for text, i in spelled.items():
            self.shorter[i] = next((spelled[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in spelled), -1)
        self.batch = Batch(spelled, self.pairs, self.rank, self.left, self.right, self.length, self.shorter)
        self.fits = lru_cache(1 << 18)(self._fits)
        self.packed = [i.to_bytes(4, "little") for i in range(size)]
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        names = [""] * size
        for t, i in vocab.items():
            names[i] = t
        table = [(n + " ").encode() for n in names]
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in table])])
        self.strings = np.frombuffer(b"".join(table), dtype=np.uint8)

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging by rank leaves the boundary between tokens a and b.

        Both are undone from their last merge back. A merge across the boundary would win if its rank is
        lower than that of the merges undone so far, which come later (on the left of the boundary an
        equal rank would come first as well).
        """
        limit, left_first = len(self.pairs), False
        while True:
            across = self.pairs.get((a, b))
            if across is not None and (across < limit or across == limit and left_first):
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # of equal ranks the left one is merged first, so the right one is undone first
                limit, left_first, a = ra, False, self.right[a]
            else:
                limit, left_first, b = rb, True, self.left[b]

    def encode_piece(self, piece: str) -> list[int]:
        """Tokens of one piece (at least one character)."""
        raw = piece.encode()
        spelled = raw[:-1].decode("latin-1") + self.last[raw[-1]]
        n, length, fits = len(spelled), self.length, self.fits
        out = [i for _, i in self.automaton.iter_long(spelled)]  # the longest at each place, taken in turn
        fit = list(map(fits, out, out[1:]))
        if False not in fit:
            return out
        # up to the first pair that does not fit, this is the answer; from there on, step by step
        keep = fit.index(False) + 1
        token, out = out[keep], out[:keep]
        at = sum([length[i] for i in out])
        dead = set()
        longest = self.automaton.iter_long
        while at < n:
            before = out[-1] if out else -1
            while token >= 0 and (at + length[token] in dead or before >= 0 and not fits(before, token)):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = next(longest(spelled[at : at + self.longest]))[1] if at < n else -1
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
                token = self.shorter[token]
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; chunks that are not remembered are encoded together, about WORDS words at a time."""
        out: list[bytes] = []
        held: list[tuple[list[str], list[bytes | None]]] = []
        words = 0
        for text in texts:
            if text and any(s in text for s in self.special):
                out += [*self._flush(held), self._encode_special(text)]
                held, words = [], 0
                continue
            chunks = self._chunks(text) if text else []
            held.append((chunks, list(map(self.memory.get, chunks))))
            words += len(chunks)
            if words >= WORDS:
                out += self._flush(held)
                held, words = [], 0
        return out + self._flush(held)

    def _encode_special(self, text: str) -> bytes:
        spans, at = [], 0
        for m in self.cut.finditer(text):
            spans, at = [*spans, (text[at : m.start()], m.group())], m.end()
        plain = [(c, list(map(self.memory.get, c))) for c in map(self._chunks, [*(t for t, _ in spans), text[at:]])]
        ids = self._flush(plain)
        return b"".join([*(x + self.packed[self.special[s]] for x, (_, s) in zip(ids, spans, strict=False)), ids[-1]])

    def _chunks(self, text: str) -> list[str]:
        """The normalised text cut at white space: no piece crosses it, and most of what stands between is one piece."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower-casing is by character: no final sigma
        text = text.lower()
        # str.split also cuts at four control characters that the pattern keeps
        return text.split() if not _CONTROLS.search(text) else self.pattern.findall(text)

    def _flush(self, held: list[tuple[list[str], list[bytes | None]]]) -> list[bytes]:
        new: set[str] = set()
        for chunks, found in held:
            if None in found:
                new.update([c for c, ids in zip(chunks, found, strict=True) if ids is None])
        if not new:
            return [b"".join(found) for _, found in held]
        ids_of = self._encode_new(new)
        return [b"".join([ids_of[c] if ids is None else ids for c, ids in zip(chunks, found, strict=True)]) for chunks, found in held]

    @cached_property
    def newer(self) -> frozenset[str]:
        """Characters that this Python's tables do not know (none is alphabetic or printable)."""
        return frozenset(c for c in map(chr, range(0x110000)) if unicodedata.category(c) == "Cn")

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @lru_cache(1 << 12)
    def _stand_in(self, c: str) -> str:
        """A letter, digit or sign for one that only the library's tables know, of the class that it has there."""
        cut = self.library.pre_tokenizer.pre_tokenize_str
        return "q" if len(cut("q" + c)) == 1 else "~" if len(cut("~" + c)) == 1 else "1"

    def _encode_newer(self, text: str) -> bytes:
        """Ids of a chunk with characters newer than this Python: the library's tables lower them and tell their class."""
        text = self.library.normalizer.normalize_str(text)
        stand = text.translate({ord(c): self._stand_in(c) for c in set(text) & self.newer})
        pieces = [text[m.start() : m.end()] for m in self.pattern.finditer(stand)]
        return b"".join([self.packed[i] for p in pieces for i in self.encode_piece(p)])

    def _encode_new(self, new: set[str]) -> dict[str, bytes]:
        """Ids of chunks that stand between white space: one piece, or several (a word and its comma)."""
        done: dict[str, bytes] = {}
        cuts: dict[str, tuple[str, ...] | list[str]] = {}
        pieces: dict[str, bytes | None] = {}
        for chunk in new:
            if (ids := self.older.get(chunk)) is not None:
                done[chunk] = ids
            elif chunk.isalpha():
                pieces[chunk] = None
            elif not chunk.isascii() and (not chunk.isprintable() or len(chunk) > 64) and not self.newer.isdisjoint(chunk):
                done[chunk] = self._encode_newer(chunk)
            else:
                word, sign = chunk[:-1], chunk[-1]
                cuts[chunk] = parts = (word, sign) if sign in _SIGNS and word.isalpha() else self.pattern.findall(chunk)
                for p in parts:
                    if p not in pieces:
                        pieces[p] = self.memory.get(p) or self.older.get(p)
        open_ = [p for p, ids in pieces.items() if ids is None]
        short = [p for p in open_ if len(p) <= SHORT]
        pieces.update(zip(short, self.batch.encode(short), strict=True))
        pieces.update((p, b"".join([self.packed[i] for i in self.encode_piece(p)])) for p in open_ if len(p) > SHORT)
        for chunk, parts in cuts.items():
            done[chunk] = b"".join([pieces[p] for p in parts])
        done = pieces | done
        if len(self.memory) >= REMEMBERED:  # two generations: what was not met lately is forgotten
            self.older, self.memory = self.memory, {}
        self.memory.update((c, ids) for c, ids in done.items() if len(c) <= SHORT)
        return done

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts whose ids lie between ``ends``."""
        ids = ids.astype(np.int64)
        size = self.offsets[ids + 1] - self.offsets[ids]
        size[ends[1:][np.diff(ends) > 0] - 1] -= 1  # no space after a text's last token
        total = np.concatenate([[0], np.cumsum(size)])
        return self.strings[tb.ranges(self.offsets[ids], size)], total[ends]


@lru_cache(2)
def load(path: str) -> WordBPE:
    return WordBPE(path)


def _encoder(path: str, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            texts = batch.column(column)
            for first in range(0, len(texts), 1024):
                part = texts.slice(first, 1024)
                ids = pa.array(bpe.encode_many(part.to_pylist()), pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(first, 1024) for c in batch.columns), ids], names=[*batch.schema.names, "ids"])

    return run


def _decoder(path: str, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            for part in tb.text_slices_binary(batch.column(column)):
                ids = part.data.view("<u4") if len(part.data) else np.zeros(0, dtype=np.uint32)
                data, offsets = bpe.decode(ids, part.offsets // 4)
                texts = pa.LargeStringArray.from_buffers(len(part), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([*(c.slice(part.first, len(part)) for c in batch.columns), texts], names=[*batch.schema.names, "decoded"])

    return run


def _mapped(df: DataFrame, make, added: str, kind: str, name: str) -> DataFrame:
    """``df`` with a column made by a task function; inner names keep given names from clashing."""
    names = df.columns
    inner = df.toDF(*[f"c{i}" for i in range(len(names))])
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema) + f", {added} {kind}"
    out = inner.mapInArrow(make, ddl)
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], F.col(added).alias(name))


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "token_ids", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with the tokens of each whole text: binary, little-endian unsigned 32-bit ids."""
    return _mapped(docs, _encoder(vocabulary or default_vocabulary(), docs.columns.index(text_col)), "ids", "binary", ids_col)


def decode(df: DataFrame, ids_col: str = "token_ids", out_col: str = "decoded", vocabulary: str | None = None) -> DataFrame:
    """``df`` with the text of each id sequence (null ids read as none)."""
    return _mapped(df, _decoder(vocabulary or default_vocabulary(), df.columns.index(ids_col)), "decoded", "string", out_col)
