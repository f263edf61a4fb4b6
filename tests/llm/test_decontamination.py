import random
import re

import pytest

from flowlens.llm import decontamination as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(texts, items, window):
    """[(n_words, spans, items)] of each text."""
    strings = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            strings.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        w, hit, names = words(text), set(), set()
        for n in range(1, window + 1):
            for i in range(len(w) - n + 1):
                if (found := strings.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    names |= found
        starts = [i for i in sorted(hit) if i - 1 not in hit]
        ends = [i + 1 for i in sorted(hit) if i + 1 not in hit]
        out.append((len(w), list(zip(starts, ends, strict=True)), sorted(names)))
    return out


@pytest.mark.parametrize(("window", "block"), [(3, d.BLOCK), (3, 300), (10, d.BLOCK), (1, d.BLOCK)])
def test_against_brute_force(spark, window, block):
    rng = random.Random(window)
    vocabulary = ["a", "B", "Añ", "x1", "the", "THE", "language", "é", "ünder", "z" * 70, "0", "of"]
    sep = [" ", ", ", "\n", "--", "\x00", "\t.", "_"]
    make = lambda n: "".join(rng.choice(vocabulary) + rng.choice(sep) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 2, 3, 5, 14, 20]))) for i in range(30)] + [(None, make(12)), (None, make(4)), (7, make(9)), (3, None), (4, ""), (5, " .. ")]
    texts = [make(rng.choice([0, 1, 2, 9, 40, 300])) for _ in range(80)] + [items[k][1] + make(5) + items[k + 1][1] for k in range(20)] + [None, "", "...", make(30000)]
    texts += texts[:5]
    rows = [(i if i % 9 else None, t, i, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item bigint, spans string").repartition(3)
    got = d.find_passages(docs, spark.createDataFrame(items, "item_id int, text string"), window=window, block=block)
    assert got.columns == ["doc_id", "text", "item", "spans", "leak_n_words", "leak_spans", "leak_items"]
    want = plain(texts, items, window)
    found = {r["item"]: r for r in got.collect()}
    assert len(found) == len(texts)
    for i, w in enumerate(want):
        r = found[i]
        assert (r.doc_id, r.text) == rows[i][:2] and (r.leak_n_words, [tuple(s) for s in r.leak_spans], r.leak_items) == w, i
    assert any(w[1] for w in want)
    kept = d.find_passages(docs, spark.createDataFrame(items, "item_id int, text string"), window=window, block=block, keep=["item"])
    assert kept.columns == ["item", "leak_n_words", "leak_spans", "leak_items"] and {(r["item"], r.leak_n_words) for r in kept.collect()} == {(i, w[0]) for i, w in enumerate(want)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id bigint, text string")
    assert {(r.doc_id, r.leak_n_words, len(r.leak_spans), len(r.leak_items)) for r in d.find_passages(docs, none).collect()} == {(1, 2, 0, 0), (2, 0, 0, 0)}
    assert d.find_passages(docs.limit(0), none).count() == 0


def test_positions_are_skipped():
    """Where no pair of words occurs in a string, a cursor looks at few words only."""
    block = d.Block([b"a b c d e f g h i j "], ["1"], 10)
    assert block.span == 9 and (block.shift == 9).mean() > 0.9
    stops = []
    shift = block.shift
    block.shift = type("S", (), {"__getitem__": lambda self, at: (stops.append(len(at)), shift[at])[1]})()
    text = " ".join(["q"] * 5000 + list("abcdefghij") + ["r"] * 5000).encode()
    part = d.tb.Slice(0, d.np.frombuffer(text, d.np.uint8), d.np.array([0, len(text)]))
    first, _ = block.find(part, *d.lowered(part))
    assert first.tolist() == [5000] and sum(stops) < 2000
