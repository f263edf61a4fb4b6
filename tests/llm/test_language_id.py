import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from flowlens.llm import language_id as lid
from flowlens.llm.textbytes import text_slices


def plain_bits(train, text):
    """Code length of bytes under PPM with exclusion by the published recursion, context by context."""
    trees = [defaultdict(Counter) for _ in range(lid.ORDER + 1)]
    for t in train:
        raw = b"\n" * lid.ORDER + t.encode()
        for i in range(lid.ORDER, len(raw)):
            for k in range(lid.ORDER + 1):
                trees[k][raw[i - k : i]][raw[i]] += 1

    def prob(context, byte, k):
        if k < 0:
            return 1 / 256
        seen = trees[k][context[len(context) - k :]]
        if not seen:
            return prob(context, byte, k - 1)
        n, d = sum(seen.values()), len(seen)
        left = 1 - sum(prob(context, b, k - 1) for b in seen)
        if byte in seen:
            return seen[byte] / (n + d) if left > 1e-15 else seen[byte] / n
        return d / (n + d) * prob(context, byte, k - 1) / left

    raw = b"\n" * lid.ORDER + text.encode()
    return sum(-math.log2(prob(raw[:i], raw[i], lid.ORDER)) for i in range(lid.ORDER, len(raw)))


def test_code_lengths_are_exact():
    train = {"x": ["abracadabra abra", "aé b"], "y": ["zzz yxz\nzy", "a"]}
    counts = {}
    for lang, texts in train.items():
        batch = pa.RecordBatch.from_arrays([pa.array([lang] * len(texts)), pa.array(texts)], names=["lang", "text"])
        found = pa.Table.from_batches(list(lid._count_contexts(iter([batch]))))
        counts[lang] = (found["gram"].to_numpy(), found["n"].to_numpy())
    model = lid.build(counts)
    texts = ["abra", "", "zy zx", "aé☃ab", "cadabra"]
    (part,) = text_slices(pa.array(texts))
    got = model.bits(part)
    for i, t in enumerate(texts):
        want = [plain_bits(train[lang], t) for lang in model.languages]
        assert np.allclose(got[i], want, rtol=1e-5), t
    total = np.exp2(-model.cost.astype(float))
    total[:, -1] *= 256 - (model.cost.shape[1] - 1)
    assert np.allclose(total.sum(axis=1), 1, atol=1e-4)  # each context's code is complete


def test_accuracy_on_held_out(spark):
    rng = random.Random(3)
    parts = {"aa": ["the", "ing", "tion", "and"], "bb": ["der", "und", "heit", "sch"], "cc": ["que", "eau", "oi", "les"]}
    docs = []
    for i in range(300):
        lang = rng.choice(sorted(parts))
        docs.append((i, " ".join(rng.choice(parts[lang]) + rng.choice(parts[lang]) for _ in range(rng.randrange(3, 40))), lang if rng.random() < 0.9 else None, lang))
    docs += [(1000, None, "aa", "und"), (1001, "", "aa", "und"), (1002, "12 - !?", None, "und"), (None, "the and", "bb", "aa"), (3, docs[3][1], docs[3][2], docs[3][3]), (1003, "日本", None, None)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id bigint, text string, lang string, truth string, c0 int").repartition(3)
    rows = lid.identify(df.withColumn("held", lid.held_out())).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.truth is None or r.lang_pred == r.truth
        assert 0 <= r.lang_score <= 1
        assert r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert {r.lang_pred for r in rows if r.doc_id == 1003} < {"aa", "bb", "cc"}
    assert lid.identify(df.limit(0)).count() == 0
    unlabelled = df.withColumn("lang", df.lang.substr(1, 0)).where("false").unionByName(df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang", "truth", "c0"))
    assert {(r.lang_pred, r.lang_score) for r in lid.identify(unlabelled).collect()} == {(lid.UNKNOWN, 0.0)}
