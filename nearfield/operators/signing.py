"""Embeddings to signatures, and signatures to an exploded band table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.columns import bands, words64
from nearfield.functions.hyperplanes import hyperplanes


def simhash(vector: Column, family: int = 0, bits: int = 256) -> Column:
    """Hex signature: a bit is set where the dot product with its hyperplane is over 0. bits is a multiple of 8."""
    if bits % 8 or bits < 64:
        raise ValueError("bits must be a multiple of 8, 64 at least")

    @F.pandas_udf("string")
    def sign(vectors: pd.Series) -> pd.Series:
        out: list[str | None] = [None] * len(vectors)
        by_size: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            if v is not None:
                by_size.setdefault(len(v), []).append(i)
        for dims, rows in by_size.items():
            x = np.stack([vectors.iloc[i] for i in rows]).astype(np.float64)
            packed = np.packbits(x @ hyperplanes(family, bits, dims).T > 0, axis=1)
            for i, p in zip(rows, packed, strict=True):
                out[i] = p.tobytes().hex()
        return pd.Series(out)

    return sign(vector)


def sign(embeddings: DataFrame, families: int = 1, bits: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, family, signature), one row for each family."""
    each = F.array(*[F.struct(F.lit(f).alias("family"), simhash(F.col(vector), f, bits).alias("signature")) for f in range(max(1, families))])
    return embeddings.select(key, F.explode(each).alias("s")).select(key, "s.family", "s.signature")


def band_table(signed: DataFrame, n: int = 16, key: str = "vec_id") -> DataFrame:
    """(key, family, band, value, words): the index, one row for each band."""
    return signed.select(key, "family", words64(F.col("signature")).alias("words"), F.posexplode(bands(F.col("signature"), n)).alias("band", "value"))
