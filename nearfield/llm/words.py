"""The one definition of a word that the operators share, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATORS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    bare = F.btrim(text, F.lit(SEPARATORS))
    return F.when(F.length(bare) > 0, F.split(bare, GAP, -1)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
