"""Stable fractions, digests, share codes and seeded orders."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from quillspan.functions.text import browser_trim

#: The digits of share codes, and how many a code has.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CODE_LENGTH = 7


def hash_fraction(text: Column) -> Column:
    """The first 32 bits of SHA-1 as a fraction of 2**32."""
    return F.conv(F.substring(F.sha1(text), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)


def short_sha1(text: Column, digits: int = 16) -> Column:
    return F.substring(F.sha1(text), 1, digits)


def _code(text: Column) -> Column:
    n = F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")
    digit = lambda i: F.substring(F.lit(BASE62), F.lit(1) + F.pmod(F.floor(n / F.lit(62**i)).cast("bigint"), F.lit(62)).cast("int"), F.lit(1))
    return F.concat(*[digit(i) for i in range(CODE_LENGTH - 1, -1, -1)])


def share_code(text: Column) -> Column:
    """Seven base-62 digits of the first 48 bits of SHA-256 of the trimmed text."""
    return _code(browser_trim(text))


def path_code(text: Column, trail: Column, bundle: Column) -> Column:
    """The code of a path: the keys in this order, behind a line break no trimmed text begins with."""
    return _code(F.concat(F.lit("\n"), F.to_json(F.struct(bundle.alias("bundle"), browser_trim(text).alias("text"), trail.alias("trail")))))


def content_version(table: DataFrame, name: str, digest: str) -> DataFrame:
    """One row: the first 8 digits of SHA-256 over the sorted names and digests. Lines are joined
    within ranges of equal first characters of the name's hash, and only one digest of each of
    the 256 ranges comes together, so no task holds the whole table."""
    line = F.concat(F.col(name), F.lit("\0"), F.col(digest), F.lit("\n"))
    joined = lambda c: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("k"), c.alias("v")))), lambda x: x["v"]), ""), 256)
    ranges = table.select(F.col(name).alias("k"), line.alias("line"), F.substring(F.sha1(F.col(name)), 1, 2).alias("r")).groupBy("r").agg(joined(F.col("line")).alias("d"))
    return ranges.select(F.col("r").alias("k"), "d").agg(F.substring(joined(F.col("d")), 1, 8).alias("version"))


def _places(n: int, seed: str) -> list[int]:
    """A permutation of 0..n-1: a 32-bit FNV-1a hash of the seed's UTF-16 units starts a
    mulberry32 generator, and places are exchanged from the last to the second."""
    mask, state = 0xFFFFFFFF, 0x811C9DC5
    units = seed.encode("utf-16-le")
    for k in range(0, len(units), 2):
        state = (state ^ int.from_bytes(units[k : k + 2], "little")) * 0x01000193 & mask
    out = list(range(n))
    for last in range(n - 1, 0, -1):
        state = state + 0x6D2B79F5 & mask
        t = (state ^ state >> 15) * (state | 1) & mask
        t ^= t + ((t ^ t >> 7) * (t | 61) & mask) & mask
        other = math.floor((t ^ t >> 14) / 2**32 * (last + 1))
        out[last], out[other] = out[other], out[last]
    return out


@F.pandas_udf(ArrayType(IntegerType()))
def seeded_places(size: pd.Series, seed: pd.Series) -> pd.Series:
    """For a list of this size: the index (from 0) of the element that comes at each place."""
    return pd.Series([_places(int(n), s) for n, s in zip(size, seed, strict=True)])


def seeded_shuffle(values: Column, seed: Column) -> Column:
    """The array in an order that the seed fixes."""
    return F.transform(seeded_places(F.size(values), seed), lambda i: F.get(values, i))
