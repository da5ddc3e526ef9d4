"""Corpus upkeep: the latest record of each key over the cached ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(batch: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """The last record of each key, by order and then tie."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc(), F.col(tie).desc()))
    return batch.withColumn("__n", last).filter("__n = 1").drop("__n")


def upsert(cached: DataFrame, batch: DataFrame, key: str, order: str, tie: str) -> DataFrame:
    """cached with the batch's last record of each key in place of its own; nothing is deleted."""
    new = latest(batch, key, order, tie)
    return cached.join(new, key, "left_anti").unionByName(new)


def sync_counts(cached: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """One row added, updated, total. A key that the batch repeats counts as updated each further time."""
    seen = cached.select(key).distinct().withColumn("__old", F.lit(1))
    per_key = batch.groupBy(key).agg(F.count("*").alias("n")).join(seen, key, "left")
    added = F.when(F.col("__old").isNull(), 1).otherwise(0)
    counts = per_key.agg(F.coalesce(F.sum(added), F.lit(0)).alias("added"), F.coalesce(F.sum(F.col("n") - added), F.lit(0)).alias("updated"))
    return counts.crossJoin(cached.agg(F.count("*").alias("n_cached"))).select("added", "updated", (F.col("n_cached") + F.col("added")).alias("total"))
