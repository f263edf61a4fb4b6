"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``with_features`` adds the counts that rules read; ``cascade`` gives the name of the first rule that a
document fails (null: it passes all). The counts are part of the result, so every document pays for all of
them; a rule's expression stands in a branch of one CASE, so an earlier rejection saves only what later
rules compute beyond the counts (few_letters, capitals). The order comes from a sample of ``sample_rows``
documents: each rule's time, without that of its counts, and rejections are measured there, and rules are
sorted by rejections per second. The verdict does not depend on the order, only the name of the first rule does.

Defined results: null text is empty text (no words, base_failed, not kept); words are
``[^\\x20\\x09-\\x0D]+`` of the whole text; repeated rows get a result each; an empty table gives an
empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 1000
MIN_WORDS = 50
_PREFIX = "quality_"
_SPACE = r"[\x20\x09-\x0D]+"
_LETTERED = r"[^\x20\x09-\x0D]*?\p{L}[^\x20\x09-\x0D]*"


@dataclass(frozen=True)
class Rule:
    """A named rejection. ``fails`` makes its condition from a function that gives a feature or the text."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: Thresholds in whole numbers, so that every engine decides alike.
RULES = (
    Rule("few_words", lambda c: c("n_words") < MIN_WORDS),
    Rule("repeated_words", lambda c: 100 * c("n_repeat_words") > 50 * c("n_words")),
    Rule("symbols", lambda c: 10 * c("n_symbols") > c("n_words")),
    Rule("duplicate_lines", lambda c: 2 * c("n_dup_lines") > c("n_lines")),
    Rule("word_length", lambda c: (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 20 * c("n_words"))),
    Rule("few_letters", lambda c: 10 * F.regexp_count(c("text"), F.lit(_LETTERED)) < 6 * c("n_words")),
    Rule("capitals", lambda c: 10 * (F.length(c("text")) - F.length(F.regexp_replace(c("text"), "[A-Z]", ""))) > 4 * c("word_chars")),
)
BASE = ("few_words", "repeated_words")


def with_features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with quality_text (null as empty), quality_n_words, _word_chars, _n_symbols, _n_lines,
    _n_dup_lines and _n_repeat_words (words in 3-word windows found twice or more).

    Windows are first compared by hash, as most documents repeat none; where hashes repeat, the windows
    themselves are sorted with their places, equal neighbours are the repeats, and each covers as many
    words as lie before the next.
    """
    p = _PREFIX
    docs = docs.select([F.col(f"`{c}`") for c in docs.columns if not c.lower().startswith(p) or c == text_col])
    own = [c for c in docs.columns if not c.lower().startswith(p)]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    step = docs.select("*", text.alias(f"{p}text")).select("*", F.array_remove(F.split(f"{p}text", _SPACE), "").alias(f"{p}w"), F.split(f"{p}text", "\n").alias(f"{p}all_lines"))
    step = step.select(
        "*", F.size(f"{p}w").cast("bigint").alias(f"{p}n_words"), F.length(F.concat_ws("", f"{p}w")).cast("bigint").alias(f"{p}word_chars"),
        (F.length(f"{p}text") - F.length(F.regexp_replace(f"{p}text", r"[#*$%&|<>]", ""))).cast("bigint").alias(f"{p}n_symbols"),
        F.filter(f"{p}all_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(f"{p}lines"),
        F.expr(f"CASE WHEN size({p}w) >= 3 THEN transform(slice({p}w, 1, size({p}w) - 2), (x, i) -> xxhash64(x, {p}w[i + 1], {p}w[i + 2])) ELSE CAST(array() AS array<bigint>) END").alias(f"{p}h"),
    )
    step = step.select(
        "*", F.size(f"{p}lines").cast("bigint").alias(f"{p}n_lines"), (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("bigint").alias(f"{p}n_dup_lines"),
        F.expr(f"""CASE WHEN size(array_distinct({p}h)) < size({p}h) THEN sort_array(transform(slice({p}w, 1, size({p}w) - 2),
            (x, i) -> concat_ws(' ', x, {p}w[i + 1], {p}w[i + 2], lpad(CAST(i AS string), 10, '0')))) ELSE CAST(array() AS array<string>) END""").alias(f"{p}g"),
    )
    step = step.select("*", F.expr(f"transform({p}g, x -> substring_index(x, ' ', 3))").alias(f"{p}t"))
    step = step.select("*", F.expr(f"""sort_array(filter(transform({p}t, (x, k) -> CASE WHEN x = get({p}t, k - 1) OR x = get({p}t, k + 1)
        THEN CAST(right({p}g[k], 10) AS int) END), v -> v IS NOT NULL))""").alias(f"{p}at"))  # fmt: skip
    step = step.select("*", F.expr(f"aggregate(transform({p}at, (v, k) -> CAST(least(3, coalesce(get({p}at, k + 1) - v, 3)) AS bigint)), 0L, (a, b) -> a + b)").alias(f"{p}n_repeat_words"))
    keep = ["text", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    # a filter on a feature stops at this one-element array (an outer explode: an inner one brings a filter of its
    # own); pushed further down, it would hold a copy of all
    # steps for each mention of a feature
    boxed = step.select(*[F.col(f"`{c}`") for c in own], F.array(F.struct(*[F.col(f"{p}{k}").alias(k) for k in keep])).alias(f"{p}box"))
    opened = boxed.select(*[F.col(f"`{c}`") for c in own], F.explode_outer(f"{p}box").alias(f"{p}f"))
    return opened.select(*[F.col(f"`{c}`") for c in own], *[F.col(f"{p}f.{k}").alias(f"{p}{k}") for k in keep])


def _feature(name: str) -> Column:
    return F.col(f"{_PREFIX}{name}")


def cascade(rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """The first rule that fails, over the columns of ``with_features``."""
    out = F
    for rule in rules:
        out = out.when(rule.fails(_feature), F.lit(rule.name))
    return out if rules else F.lit(None).cast("string")


def order_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second, both measured on a sample of ``sample_rows`` documents."""
    sample = with_features(docs.select(F.col(f"`{text_col}`").alias("text")).limit(sample_rows)).cache()
    try:
        rows = sample.count()

        def run(condition: Column) -> tuple[float, int]:
            query, best, hits = sample.agg(F.count_if(condition)), float("inf"), 0
            for _ in range(2):
                began = time.perf_counter()
                hits = query.first()[0]
                best = min(best, time.perf_counter() - began)
            return best, hits

        floor, _ = run(F.lit(False))
        measured = {r.name: run(r.fails(_feature)) for r in rules}
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: -(measured[r.name][1] + 0.5) / (rows + 1) / max(measured[r.name][0] - floor, 1e-4))


def apply_rules(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with its features, quality_base_failed, quality_failed (a rule's name or null) and quality_kept."""
    ordered = order_rules(docs, text_col, rules, sample_rows)
    featured = with_features(docs, text_col)
    base = [r.fails(_feature) for r in rules if r.name in BASE]
    failed = F.lit(False)
    for condition in base:
        failed = failed | condition
    out = featured.withColumn("quality_base_failed", failed).withColumn("quality_failed", cascade(ordered))
    return out.withColumn("quality_kept", F.col("quality_failed").isNull()).drop("quality_text")


#: The same features and verdict in DuckDB.
FEATURES_SQL = r"""
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  CASE WHEN len(w) < 3 THEN 0 ELSE coalesce((
    SELECT count(DISTINCT spot + step) FROM (
      SELECT spot, count(*) OVER (PARTITION BY g) AS n FROM (
        SELECT i AS spot, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT unnest(generate_series(1, len(w) - 2)) AS i))),
      (SELECT unnest([0, 1, 2]) AS step) WHERE n > 1), 0) END::BIGINT AS n_repeat_words,
  len(regexp_extract_all(t, '[^\x20\x09-\x0D]*?\p{L}[^\x20\x09-\x0D]*')) AS n_lettered,
  length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals
FROM (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines
  FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))
"""
ORACLE_SQL = f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_lettered < 6 * n_words OR 10 * n_capitals > 4 * word_chars) AS kept
FROM ({FEATURES_SQL})
"""
