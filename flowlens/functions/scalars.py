"""Scalar, list and bit functions as column expressions."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def shift_left(x: Column, n: int) -> Column:
    return F.shiftleft(x, n)


def shift_right_unsigned(x: Column, n: int) -> Column:
    return F.shiftrightunsigned(x, n)


def substitute(text: Column, old: str, new: str) -> Column:
    """Every occurrence replaced; the result is not scanned again."""
    return F.replace(text, F.lit(old), F.lit(new))


def head(items: Column) -> Column:
    return F.get(items, F.lit(0))


def tail(items: Column) -> Column:
    return F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))


def is_empty(items: Column) -> Column:
    return F.size(items) == 0


def pick(items: Column, places: list[int]) -> Column:
    """Items at 0-based places, in the order given; places past the end are null."""
    return F.array(*[F.get(items, F.lit(i)) for i in places])


def places(spec: str) -> list[int]:
    """``2-4,2,0-1`` as places: ranges are inclusive and may run down."""
    out: list[int] = []
    for part in spec.split(","):
        a, _, b = part.strip().partition("-")
        first, last = int(a), int(b or a)
        out += range(first, last + 1) if first <= last else range(first, last - 1, -1)
    return out


def bit(x: Column, n: int) -> Column:
    return F.getbit(x, F.lit(n)).cast("bigint")


def bits(x: Column, high: int, low: int) -> Column:
    """Bits high .. low as a number."""
    return F.shiftrightunsigned(x, low).bitwiseAND(F.lit((1 << (high - low + 1)) - 1)).cast("bigint")


def interval(lo: Column, hi: Column) -> Column:
    """[lo, hi]; an interval whose ends are crossed collapses to the smallest value twice."""
    least = F.lit(-(1 << 63)).cast("bigint")
    ok = lo <= hi
    return F.struct(F.when(ok, lo).otherwise(least).alias("lo"), F.when(ok, hi).otherwise(least).alias("hi"))


def key_hash(text: Column) -> Column:
    """The first eight bytes of MD5, little-endian, as DECIMAL(20,0)."""
    digest = F.md5(text.cast("binary"))
    turned = F.concat(*[F.substring(digest, 2 * i + 1, 2) for i in range(7, -1, -1)])
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def printable(text: Column) -> Column:
    """Characters outside printable ASCII as hexadecimal escapes of their UTF-8 bytes."""
    pairs = F.regexp_extract_all(F.hex(text.cast("binary")), F.lit("(..)"), F.lit(1))
    shown = F.transform(pairs, lambda h: F.when((h >= "20") & (h <= "7E"), F.char(F.conv(h, 16, 10).cast("bigint"))).otherwise(F.concat(F.lit("\\x"), h)))
    return F.array_join(shown, "")


def close(a: Column, b: Column, absolute: float = 0.0, relative: float = 0.0) -> Column:
    """Whether two floats differ by no more than either tolerance (the relative one of the second)."""
    return F.abs(a - b) <= F.greatest(F.lit(absolute), F.abs(b) * relative)


def override(*levels: Column) -> Column:
    """Record fields through inheritance: the last level that sets a field wins."""
    return F.coalesce(*reversed(levels))


def _double_hashes(items: pd.Series) -> pd.Series:
    """One step of all items at a time, the longest first; unsigned numbers wrap at 64 bits by themselves."""
    out = pd.Series([None] * len(items), dtype=object)
    known = np.flatnonzero(items.notna().to_numpy())
    codes = [np.frombuffer(b, np.uint8) for b in items.iloc[known]]
    size = np.array([len(c) for c in codes], np.int64)
    order = np.argsort(-size, kind="stable")
    size, flat = size[order], np.concatenate([np.zeros(0, np.uint8), *(codes[i] for i in order)])
    start, add, mul = np.cumsum(size) - size, np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    left = len(size)
    for at in range(int(size[0]) if len(size) else 0):
        while size[left - 1] <= at:
            left -= 1
        b = flat[start[:left] + at].astype(np.uint64)
        add[:left] = add[:left] * np.uint64(11) + b
        mul[:left] = mul[:left] * np.uint64(7) ^ b
    out.iloc[known[order]] = [f"{a}{m}" for a, m in zip(add.tolist(), mul.tolist(), strict=True)]
    return out


def double_hash(items: Column) -> Column:
    """Additive and multiplicative hashes of bytes, wrapping at 64 bits, as two decimal numbers joined."""
    return F.pandas_udf(_double_hashes, "string")(items)
