"""Partition transforms of a lake table, as column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MASK = 0xFFFFFFFF


def year(c: Column) -> Column:
    """Years since 1970."""
    return F.year(c) - 1970


def month(c: Column) -> Column:
    """Months since 1970-01."""
    return (F.year(c) - 1970) * 12 + F.month(c) - 1


def day(c: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(F.to_date(c))


def hour(c: Column) -> Column:
    """Hours since 1970-01-01."""
    return F.unix_date(F.to_date(c)) * 24 + F.hour(c)


def truncate_number(c: Column, width: int) -> Column:
    """Down to a multiple of the width, also below zero."""
    return c - F.pmod(c, F.lit(width))


def truncate_text(c: Column, width: int) -> Column:
    """The first characters."""
    return F.substring(c, 1, width)


def _u32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_MASK))


def _mul32(c: Column, k: int) -> Column:
    """Product of a 32-bit value and a constant modulo 2^32, by halves so that no product leaves 64 bits."""
    low = c * F.lit(k & 0xFFFF)
    high = F.shiftleft(_u32(c * F.lit(k >> 16)).bitwiseAND(F.lit(0xFFFF)), 16)
    return _u32(low + high)


def _rotl(c: Column, n: int) -> Column:
    return _u32(F.shiftleft(c, n)).bitwiseOR(F.shiftrightunsigned(c, 32 - n))


def murmur3_long(c: Column) -> Column:
    """32-bit Murmur3 with seed 0 of the eight little-endian bytes of a number: what a lake's bucket transform takes for int, long, date and timestamps (the built-in hash has another seed)."""
    x = c.cast("bigint")
    h: Column = F.lit(0).cast("bigint")
    for word in (_u32(x), _u32(F.shiftrightunsigned(x, 32))):
        k = _mul32(_rotl(_mul32(word, 0xCC9E2D51), 15), 0x1B873593)
        h = _u32(_rotl(h.bitwiseXOR(k), 13) * F.lit(5) + F.lit(0xE6546B64))
    h = h.bitwiseXOR(F.lit(8))
    h = _mul32(h.bitwiseXOR(F.shiftrightunsigned(h, 16)), 0x85EBCA6B)
    h = _mul32(h.bitwiseXOR(F.shiftrightunsigned(h, 13)), 0xC2B2AE35)
    return h.bitwiseXOR(F.shiftrightunsigned(h, 16))


def murmur3_bytes(data: bytes) -> int:
    """The same of any bytes, unsigned."""
    h, n = 0, len(data)

    def mix(k: int) -> int:
        k = k * 0xCC9E2D51 & _MASK
        return (k << 15 | k >> 17) * 0x1B873593 & _MASK

    for i in range(0, n - n % 4, 4):
        h ^= mix(int.from_bytes(data[i : i + 4], "little"))
        h = ((h << 13 | h >> 19) & _MASK) * 5 + 0xE6546B64 & _MASK
    if n % 4:
        h ^= mix(int.from_bytes(data[n - n % 4 :], "little"))
    h ^= n
    for shift, k in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> shift) * k & _MASK
    return h ^ h >> 16


def _bucket_text(n: int):
    @F.pandas_udf(T.IntegerType())
    def run(s: pd.Series) -> pd.Series:
        known: dict = {}
        for v in s.dropna().unique():
            known[v] = (murmur3_bytes(v.encode() if isinstance(v, str) else bytes(v)) & 0x7FFFFFFF) % n
        return s.map(known).astype("Int32")

    return run


def bucket(df: DataFrame, name: str, n: int) -> Column:
    """Bucket of a column: numbers, dates and timestamps in the JVM, text and binary by a vectorised function over distinct values of a batch. Null stays null."""
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return _bucket_text(n)(c)
    if isinstance(kind, T.DateType):
        c = F.unix_date(c)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        from ..session import micros

        c = micros(df, name)
    elif not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"no bucket of {kind.simpleString()}")
    return F.pmod(murmur3_long(c).bitwiseAND(F.lit(0x7FFFFFFF)), F.lit(n)).cast("int")


def transform(df: DataFrame, spec: str) -> tuple[str, Column]:
    """Name and expression of a partition field such as ``identity(a)``, ``bucket[16](a)``, ``truncate[50](a)``, ``month(a)``, ``void(a)`` or plain ``a``."""
    m = re.fullmatch(r"\s*(?:(\w+)(?:\[(\d+)])?\(\s*([\w.]+)\s*\)|([\w.]+))\s*", spec)
    if not m:
        raise ValueError(f"no partition field: {spec!r}")
    kind, width, name = (m[1].lower(), m[2], m[3]) if m[1] else ("identity", None, m[4])
    c, flat = F.col(name), name.replace(".", "_")
    simple = {"year": year, "month": month, "day": day, "hour": hour}
    if kind == "identity":
        return flat, c
    if kind in simple or kind.rstrip("s") in simple:
        k = kind if kind in simple else kind.rstrip("s")
        return f"{flat}_{k}", simple[k](c)
    if kind == "bucket" and width:
        return f"{flat}_bucket", bucket(df, name, int(width))
    if kind in ("truncate", "trunc") and width:
        text = isinstance(df.schema[name].dataType, T.StringType)
        return f"{flat}_trunc", truncate_text(c, int(width)) if text else truncate_number(c, int(width))
    if kind in ("void", "alwaysnull"):
        return f"{flat}_null", F.lit(None).cast(df.schema[name].dataType)
    raise ValueError(f"unknown transform: {spec!r}")
