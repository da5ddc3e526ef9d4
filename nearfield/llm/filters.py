"""Bloom filters of bounded size: they spare rows from a shuffle, and an exact join follows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter, at most (16 MB); with more keys than that serves, more rows pass it, and results stay the same.
FILTER_BITS = 1 << 27


def key_filter(keys: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A Bloom filter of a column of 64-bit keys: two bits for each, built on the executors. At most FILTER_BITS come to the driver."""
    n = max(1, keys.count())
    bits = min(FILTER_BITS, max(1 << 16, 1 << (16 * n - 1).bit_length()))
    one, two = (F.col(column).bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(column, 32).bitwiseAND(F.lit(bits - 1)))
    places = keys.select(F.explode(F.array(one, two)).alias("p")).distinct()

    def block(g: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << 16, dtype=np.uint8)
        flags[g["p"].to_numpy() & 0xFFFF] = 1
        return pd.DataFrame({"b": [int(g["p"].iloc[0]) >> 16], "flags": [np.packbits(flags, bitorder="little").tobytes()]})

    table = np.zeros(bits // 8, dtype=np.uint8)
    for r in places.groupBy(F.shiftright("p", 16).alias("b")).applyInPandas(block, "b long, flags binary").toLocalIterator():
        table[r.b << 13 : (r.b + 1) << 13] = np.frombuffer(r.flags, np.uint8)
    return table, bits


def passes(table: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    low, mask = np.uint64(7), np.uint64(bits - 1)
    out = np.ones(len(h), dtype=bool)
    for p in (h & mask, (h >> np.uint64(32)) & mask):
        out &= (table[(p >> np.uint64(3)).astype(np.int64)] >> (p & low).astype(np.uint8)) & 1 == 1
    return out


def maybe(key: Column, spark, keys: DataFrame, column: str) -> Column:
    """Whether a 64-bit key may be among keys; never false for one that is. Null: false."""
    shared = spark.sparkContext.broadcast(key_filter(keys, column))

    @F.pandas_udf("boolean")
    def test(values: pd.Series) -> pd.Series:
        table, bits = shared.value
        return pd.Series(passes(table, bits, values.to_numpy().astype(np.int64).view(np.uint64)))

    return key.isNotNull() & test(F.coalesce(key, F.lit(0)))
