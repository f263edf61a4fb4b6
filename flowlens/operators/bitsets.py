"""Sparse bit sets of many owners: tables (owner, word, bits) of 64 members a row, with words of no members left out.

Every operation is a grouping or a join on (owner, word), so one huge set is dealt by its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_KEYS = ["owner", "word"]


def _bit(item: str):
    return F.expr(f"shiftleft(1L, cast({item} & 63 AS int))")


def packed(facts: DataFrame, owner: str, item: str) -> DataFrame:
    """The sets of the integers ``item`` of each owner; nulls are no members."""
    rows = facts.select(F.col(owner).alias("owner"), F.col(item).cast("bigint").alias("item")).where("owner IS NOT NULL AND item IS NOT NULL")
    return rows.groupBy("owner", F.shiftright("item", 6).alias("word")).agg(F.bit_or(_bit("item")).alias("bits"))


def side_by_side(facts: DataFrame, owner: str, item: str, **which: Column) -> DataFrame:
    """(owner, word, <name>...): one set for each name, of the facts for which its condition holds, found in one grouping; 0 where a set
    has no member in a word that another has."""
    rows = facts.select(F.col(owner).alias("owner"), F.col(item).cast("bigint").alias("item"), *[c.alias(f"_{name}") for name, c in which.items()])
    rows = rows.where("owner IS NOT NULL AND item IS NOT NULL AND (" + " OR ".join(f"_{name}" for name in which) + ")")
    sets = [F.coalesce(F.bit_or(F.when(F.col(f"_{name}"), _bit("item"))), F.lit(0).cast("bigint")).alias(name) for name in which]
    return rows.groupBy("owner", F.shiftright("item", 6).alias("word")).agg(*sets)


def total(word: Column, bits: Column) -> Column:
    """The sum of a word's members: a place's k-th binary digit is set in every second run of 2^k places."""
    digits = [sum(1 << i for i in range(64) if i >> k & 1) for k in range(6)]
    places = sum((F.bit_count(bits.bitwiseAND(F.lit(d - (1 << 64) if d >> 63 else d).cast("bigint"))) * (1 << k) for k, d in enumerate(digits)), F.lit(0))
    return F.when(bits != 0, word * 64 * F.bit_count(bits) + places)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy(*_KEYS).agg(F.bit_or("bits").alias("bits"))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.join(b.withColumnRenamed("bits", "other"), _KEYS)
    return both.select(*_KEYS, F.col("bits").bitwiseAND(F.col("other")).alias("bits")).where("bits <> 0")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Members of a that are not in b (also: a with the members of b reset)."""
    both = a.join(b.withColumnRenamed("bits", "other"), _KEYS, "left")
    return both.select(*_KEYS, F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("other", F.lit(0).cast("bigint")))).alias("bits")).where("bits <> 0")


def tested(a: DataFrame, items: DataFrame) -> DataFrame:
    """``items(owner, item)`` and ``present``."""
    at = items.withColumn("word", F.shiftright(F.col("item").cast("bigint"), 6)).join(a, _KEYS, "left")
    return at.select("owner", "item", F.coalesce(F.col("bits").bitwiseAND(_bit("item")) != 0, F.lit(False)).alias("present"))


def test_and_set(a: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets with ``items(owner, item)`` set, and those of them (owner, item) that were not set before, once each."""
    return union(a, packed(items, "owner", "item")), tested(a, items).where("NOT present AND item IS NOT NULL").select("owner", "item").distinct()


def counts(a: DataFrame) -> DataFrame:
    """(owner, n); an owner without members has no row."""
    return a.groupBy("owner").agg(F.sum(F.bit_count("bits")).cast("bigint").alias("n"))


def members(a: DataFrame) -> DataFrame:
    """(owner, item)"""
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftright", F.col("bits"), i).bitwiseAND(F.lit(1).cast("bigint")) != 0)
    return a.select("owner", F.explode(places).alias("i"), "word").select("owner", (F.col("word") * 64 + F.col("i")).alias("item"))
