"""A corpus kept up to date from a stream: each micro-batch writes the next version of the table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from nearfield.functions.columns import bands, hamming_words, largest_distance, words64
from nearfield.operators.upsert import latest, upsert
from nearfield.scratch import drop_scratch, materialise, scratch_path


def sync_stream(stream: DataFrame, key: str, order: str, tie: str, folder: str | None = None) -> DataFrame:
    """Run a stream to its present end; the latest record of each key.

    Batch n reads version n - 1 and writes version n whole, so a batch that
    is run again after a failure gives the same table; older versions go. A
    folder that is given keeps the last two versions and the stream's place,
    and the next run goes on there.
    """

    def merge(cached: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = latest(batch, key, order, tie)
        if cached is not None:
            both = cached.join(batch.select(key), key, "left_semi").select(*stream.columns).unionByName(batch)
            new = upsert(cached, both, key, order, tie)  # a late, older record does not replace a newer one
        return new.select(*stream.columns)

    return _versions(stream, merge, stream.schema, folder or scratch_path(stream.sparkSession, "sync"))


def _versions(stream: DataFrame, merge: Callable[[DataFrame | None, DataFrame], DataFrame], schema: StructType, folder: str) -> DataFrame:
    """The table that merge(table so far, batch) makes of each batch, after the last."""
    spark: SparkSession = stream.sparkSession

    def step(batch: DataFrame, n: int) -> None:
        session = batch.sparkSession
        known = [v for v in versions(session, folder) if v < n]
        cached = session.read.schema(schema).parquet(f"{folder}/v{known[-1]}") if known else None
        merge(cached, batch).write.mode("overwrite").parquet(f"{folder}/v{n}")
        drop_scratch(session, [f"{folder}/v{v}" for v in known[:-1]])

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    last = versions(spark, folder)
    return spark.read.schema(schema).parquet(f"{folder}/v{last[-1]}") if last else spark.createDataFrame([], schema)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions that were written to the end, in order."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(at)] if files.exists(at) else []
    whole = lambda n: files.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n) and whole(n))


def screen(batch: DataFrame, blocked: DataFrame | None, threshold: float = 0.85, key: str = "vec_id", n: int = 16) -> DataFrame:
    """Rows of batch (key, signature, suspicious) that are blocked: (key, signature, why).

    ``why`` is classifier for a suspicious row, else state for one that a row
    blocked earlier (in ``blocked``, or in the batch by a smaller key) shares a
    band and the threshold's similarity with; such a row blocks later ones in
    turn. Rows without a signature are blocked by the classifier alone.
    """
    rows = materialise(batch.select(key, "signature", F.coalesce("suspicious", F.lit(False)).alias("suspicious")), "screened")
    sides = lambda d: d.filter(F.col("signature").isNotNull()).select(F.col(key), words64(F.col("signature")).alias("words"), F.posexplode(bands(F.col("signature"), n)).alias("band", "value"))
    index, most = sides(rows), largest_distance(threshold)

    def met(earlier: DataFrame, later: DataFrame, ordered: bool) -> DataFrame:
        e = earlier.select(F.col(key).alias("__from"), F.col("words").alias("__w"), "band", "value")
        hit = e.join(later, ["band", "value"]).filter(hamming_words(F.col("words"), F.col("__w")) <= most)
        return hit.filter(F.col("__from") < F.col(key)) if ordered else hit

    pairs = materialise(met(index, index, True).select(F.col("__from").alias("a"), F.col(key).alias("b")).distinct(), "screen-pairs")
    found = rows.filter("suspicious").select(F.col(key).alias("k"))
    if blocked is not None:
        found = found.union(met(sides(blocked), index, False).select(key))
    found = materialise(found.distinct(), "blocked")
    frontier = found
    while not frontier.isEmpty():  # as many rounds as the longest chain of pairs in the batch
        new = pairs.join(frontier, pairs["a"] == frontier["k"], "left_semi").select(F.col("b").alias("k")).distinct().join(found, "k", "left_anti")
        frontier = materialise(new, "frontier")
        found = found.union(frontier)
    why = F.when(F.col("suspicious"), "classifier").otherwise("state")
    return rows.join(found.withColumnRenamed("k", key), key, "left_semi").select(key, "signature", why.alias("why"))


def block_stream(stream: DataFrame, threshold: float = 0.85, key: str = "vec_id", folder: str | None = None) -> DataFrame:
    """The signatures blocked so far, after a stream of (key, signature, suspicious): each batch is screened against them and adds its own."""
    schema = StructType([stream.schema[key], StructField("signature", StringType()), StructField("why", StringType())])

    def merge(blocked: DataFrame | None, batch: DataFrame) -> DataFrame:
        new = screen(batch, blocked, threshold, key)
        return new if blocked is None else blocked.unionByName(new.join(blocked.select(key), key, "left_anti"))

    return _versions(stream, merge, schema, folder or scratch_path(stream.sparkSession, "blocked"))
