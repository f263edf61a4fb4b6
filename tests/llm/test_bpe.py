import random
import time

import numpy as np
import pytest

from flowlens.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

ODD = [
    "", " ", "a", "I'll we've THEY'RE don't 'S ''s", "ΣΑΣ Σ ΟΔΟΣ", "İstanbul", "été Å", "ﬁ ½ ² 123 4", "x<|endoftext|>y <|STARTOFTEXT|> <|startoftext|>",
    "日本語テキスト", "🙂🙂 👩‍👩‍👧", " 　\x85 a\x00b", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "the" * 400, "<|", "----====!!!!", "́a", "ǅ Ǆ", "﻿x ​z", "ththth" * 90, "z" * 5000,
]


@pytest.fixture(scope="module")
def theirs():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def samples():
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzéüßñ'.,-019 \n"
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 300))) for _ in range(400)] + ["".join(rng.choice(["in", "th", "er", "an", "on"]) for _ in range(rng.randrange(1, 60))) for _ in range(400)]


def test_ids_and_text_equal_the_library(spark, theirs):
    texts = samples()
    df = spark.createDataFrame(list(enumerate(texts)) + [(-1, None)], "ids bigint, text string").repartition(3)
    out = bpe.decode(bpe.encode(df)).collect()
    assert len(out) == len(texts) + 1
    for r in out:
        want = theirs.encode(r.text or "", add_special_tokens=False).ids
        got = [int.from_bytes(r.token_ids[i : i + 4], "little") for i in range(0, len(r.token_ids), 4)]
        assert got == want, r.text
        assert r.decoded == theirs.decode(want, skip_special_tokens=False)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, decoded int")
    assert bpe.decode(bpe.encode(df), out_col="again").count() == 0


def test_characters_newer_than_the_tables(theirs):
    mine = bpe.load(bpe.default_vocabulary())
    newer = sorted(c for c in mine.newer if c < "\U00033500" or "\U000E0000" <= c < "\U000E0200")
    assert newer
    for first in range(0, len(newer), 400):
        text = " ".join(f"a{c}B 1{c}2 ~{c}" for c in newer[first : first + 400])
        got = np.frombuffer(mine.encode(text), "<u4").tolist()
        assert got == theirs.encode(text, add_special_tokens=False).ids, first


def test_many_texts_together_equal_each_alone(theirs, monkeypatch):
    """Small batches and a small memory: words are forgotten, met again, and shared by texts of one batch."""
    monkeypatch.setattr(bpe, "WORDS", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    mine = bpe.WordBPE(bpe.default_vocabulary())
    texts = [*samples(), None, "<|endoftext|>", "", "a, b. <|endoftext|>c! " * 3, "é" * 70 + ". " + "q" * 65, *samples()]
    got = [np.frombuffer(x, "<u4").tolist() for x in mine.encode_many(texts)]
    assert got == [theirs.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pairs_fit_alike_one_by_one_and_together():
    mine = bpe.load(bpe.default_vocabulary())
    rng = np.random.default_rng(3)
    used = np.array([i for i, n in enumerate(mine.length) if n])
    a, b = rng.choice(used, 20_000).astype(np.int32), rng.choice(used, 20_000).astype(np.int32)
    want = [mine._fits(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert mine.batch.fits(a, b).tolist() == want
    assert mine.batch.fits(a, b).tolist() == want  # from the table
    assert 0 < sum(want) < len(want)


@pytest.mark.parametrize("piece", ["ab", "acgt", "z", "thin"])
def test_one_long_piece_takes_linear_time(theirs, piece):
    mine = bpe.load(bpe.default_vocabulary())
    text = piece * (100_000 // len(piece))
    assert np.frombuffer(mine.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids
    began = time.process_time()
    assert mine.encode(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 15
