"""Verdicts of a chunk scorer: per text, against a second scorer, and together with corpus matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.columns import label, windows


def score_chunks(texts: DataFrame, tokens: Column, scorer: Callable[[Column], Column], key: str, threshold: float = 0.5) -> DataFrame:
    """(key, chunk, score, suspicious): a scorer (array of tokens -> double) over the windows of each text."""
    chunks = texts.select(key, F.posexplode(windows(tokens)).alias("chunk", "w"))
    return chunks.select(key, "chunk", scorer(F.col("w")).alias("score")).withColumn("suspicious", label(F.col("score"), threshold) == "suspicious")


def reduce_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """(key, n_chunks, suspicious, max_score, first_score): a text is suspicious if a chunk is."""
    return chunks.groupBy(key).agg(F.count("*").alias("n_chunks"), F.bool_or("suspicious").alias("suspicious"), F.max("score").alias("max_score"), F.min_by("score", "chunk").alias("first_score"))


def divergence(primary: DataFrame, shadow: DataFrame, key: str) -> DataFrame:
    """Of each text of primary: n_primary, n_shadow, max_delta, label_mismatch, verdict_mismatch.

    Chunks are compared place by place, as far as both have them. A text
    without a shadow score keeps its row, with nulls: a failed shadow is no
    divergence.
    """
    p = primary.select(key, "chunk", F.col("score").alias("ps"), F.col("suspicious").alias("pf"))
    s = shadow.select(key, "chunk", F.col("score").alias("ss"), F.col("suspicious").alias("sf"))
    both = p.join(s, [key, "chunk"], "full").groupBy(key).agg(
        F.count("ps").alias("n_primary"), F.count("ss").alias("n_shadow"), F.max(F.abs(F.col("ps") - F.col("ss"))).alias("max_delta"),
        F.bool_or(F.col("pf") != F.col("sf")).alias("label_mismatch"), (F.bool_or("pf") != F.bool_or("sf")).alias("verdict_mismatch"),
    )
    return both.filter("n_primary > 0")


def layered(verdicts: DataFrame, corpus_hits: DataFrame, blocked_hits: DataFrame, key: str) -> DataFrame:
    """(key, blocked, layer): the first of classifier, corpus and earlier blocks that speaks against a text.

    verdicts: (key, suspicious); hits: tables with ``key`` of texts that match.
    """
    mark = lambda hits, name: hits.select(key).distinct().withColumn(name, F.lit(True))
    all_three = verdicts.join(mark(corpus_hits, "__feed"), key, "left").join(mark(blocked_hits, "__seen"), key, "left")
    layer = F.when(F.col("suspicious"), "classifier").when(F.col("__feed"), "feed").when(F.col("__seen"), "dedup")
    return all_three.select(key, layer.isNotNull().alias("blocked"), layer.alias("layer"))
