"""Ranges of rows in the order of a key, from the rows alone.

The bounds are quantiles of a sample that a hash of the key draws, so equal rows give equal ranges
however they are partitioned and whichever task runs again.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges at most; beyond it they grow. A range is worked on as a stream, so its size bounds no memory.
MOST_RANGES = 20_000
#: Keys that are drawn for each range, about; those of all ranges are ordered in one task (1.3 million at most).
PER_RANGE = 64
_LEAST = -(1 << 63)


def _hex(number: Column) -> Column:
    return F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(_LEAST))), 16, "0")


def sort_key(number: Column, *rest: Column, descending: bool = False) -> Column:
    """A string whose bytes order rows by a whole number, then by rest (hexadecimal strings); a null is before
    all numbers, or after them where they descend."""
    shown = F.concat(F.lit("1"), _hex(F.bitwise_not(number.cast("long")) if descending else number))
    return F.concat(F.coalesce(shown, F.lit("2" if descending else "0")), *rest)


def hash_key(value: Column) -> Column:
    return _hex(F.xxhash64(value))


def first_keys(keyed: DataFrame, rows: int, size: int, range_bytes: int, most: int = MOST_RANGES) -> list[str]:
    """The first keys of the ranges after the first, of about range_bytes each; keyed: (key, size) of all rows, whose
    number and sum are given. Rows of one key are in one range. The driver gets less than `most` keys."""
    ranges = min(most, rows, max(1, -(-size // range_bytes)))
    if ranges <= 1:
        return []
    chance = F.least(F.lit(1.0), F.col("n") * (PER_RANGE * ranges / rows))  # a key of many rows is drawn for certain
    each = keyed.groupBy("key").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).withColumn("chance", chance)
    drawn = each.where(F.xxhash64(F.lit("range"), F.col("key")) / F.lit(2.0**64) + 0.5 < F.col("chance")).select("key", (F.col("size") / F.col("chance")).cast("long").alias("size"))
    before = F.sum("size").over(Window.orderBy("key")) - F.col("size")
    number = F.floor(before * ranges / F.sum("size").over(Window.partitionBy()))
    firsts = drawn.select("key", number.alias("number")).groupBy("number").agg(F.min("key").alias("key")).collect()
    return sorted(r["key"] for r in firsts)[1:]


def range_of(key: Column, firsts: list[str]) -> Column:
    """The number of the range of a key."""
    if not firsts:
        return F.lit(0)
    bounds = np.array([x.encode() for x in firsts])

    @F.pandas_udf("int")
    def number(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy().astype("S"), "right").astype(np.int32))

    return number(key)
