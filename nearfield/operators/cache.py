"""A signature corpus and its band index in a folder: written, loaded, added to, and replaced in parts.

A folder holds generations ``g0``, ``g1``, ... of two Parquet tables,
``entries`` and ``index``, both partitioned by a hash of the key. A generation
counts once its ``meta`` file is there, which is written last, so a write that
breaks off leaves the one before in force.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.signing import band_table
from nearfield.scratch import discard, drop_scratch, materialise

#: Layout of the folder; a cache of another layout is not loaded.
SCHEMA_VERSION = 1
PARTS = 32


@dataclass(frozen=True)
class Cache:
    """entries (key, family, signature and more), index (key, family, band, value, words) and what the meta file says."""

    entries: DataFrame
    index: DataFrame
    meta: dict
    folder: str


def _path(spark: SparkSession, name: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def generations(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the generations whose meta file is there, in order."""
    at, files = _path(spark, folder)
    if not files.exists(at):
        return []
    names = [s.getPath().getName() for s in files.listStatus(at)]
    found = sorted(int(n[1:]) for n in names if re.fullmatch(r"g\d+", n))
    return [g for g in found if _path(spark, f"{folder}/g{g}/meta")[1].exists(_path(spark, f"{folder}/g{g}/meta")[0])]


def _part(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


def _index(signed: DataFrame, bands: int, key: str) -> DataFrame:
    return band_table(signed, bands, key).withColumn("part", _part(F.col(key)))


def save(signed: DataFrame, folder: str, version: str = "v1", source: str = "", bands: int = 16, key: str = "vec_id", synced_at: str | None = None) -> None:
    """Write signed (key, family, signature and more) and its index as the next generation; the one before the last is removed.

    signed may be read from the folder itself.
    """
    spark = signed.sparkSession
    known = generations(spark, folder)
    new = f"{folder}/g{known[-1] + 1 if known else 0}"
    at, files = _path(spark, new)
    files.delete(at, True)  # of a write that broke off
    signed.withColumn("part", _part(F.col(key))).repartition("part").write.partitionBy("part").parquet(f"{new}/entries")
    kept = spark.read.parquet(f"{new}/entries").drop("part")
    _index(kept, bands, key).repartition("part").write.partitionBy("part").parquet(f"{new}/index")
    meta = {"schema_version": SCHEMA_VERSION, "signature_version": version, "synced_at": synced_at, "source": source, "entry_count": kept.count(), "bands": bands, "key": key}
    _write(spark, f"{new}/meta", json.dumps(meta))
    drop_scratch(spark, [f"{folder}/g{g}" for g in known[:-1]])


def _write(spark: SparkSession, name: str, text: str) -> None:
    """A small file that appears whole: written beside and renamed."""
    at, files = _path(spark, name)
    beside, _ = _path(spark, name + ".new")
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.delete(at, False)
    files.rename(beside, at)


def load(spark: SparkSession, folder: str, version: str = "v1") -> Cache | None:
    """The last generation; None where there is none, or where layout or signature version differ. A meta file that is no JSON is an error."""
    known = generations(spark, folder)
    if not known:
        return None
    at = f"{folder}/g{known[-1]}"
    body = "".join(r.value for r in spark.read.text(f"{at}/meta").collect())
    try:
        meta = json.loads(body)
    except ValueError as e:
        raise ValueError(f"corrupt cache: {at}/meta") from e
    if meta.get("schema_version") != SCHEMA_VERSION or meta.get("signature_version") != version:
        return None
    return Cache(spark.read.parquet(f"{at}/entries").drop("part"), spark.read.parquet(f"{at}/index").drop("part"), meta, at)


def append(cache: Cache, signed: DataFrame) -> Cache:
    """Add signatures of new keys to entries and index, without a rebuild. Keys that are there already must go through replace."""
    spark, key = signed.sparkSession, cache.meta["key"]
    new = materialise(signed.withColumn("part", _part(F.col(key))), "appended")
    new.repartition("part").write.mode("append").partitionBy("part").parquet(f"{cache.folder}/entries")
    _index(new.drop("part"), cache.meta["bands"], key).repartition("part").write.mode("append").partitionBy("part").parquet(f"{cache.folder}/index")
    discard(new)
    return _again(spark, cache)


def replace(cache: Cache, signed: DataFrame, gone: DataFrame | None = None) -> Cache:
    """Delete and reinsert: the rows of signed in place of those of their keys, and without the keys of gone.

    Only the partitions that hold such a key are written anew: first the new
    files, then the old ones go. Where that breaks off, running it again
    gives the same table.
    """
    spark, key = signed.sparkSession, cache.meta["key"]
    keys = signed.select(key) if gone is None else signed.select(key).unionByName(gone.select(key))
    keys = materialise(keys.distinct().withColumn("part", _part(F.col(key))), "keys")
    parts = [r.part for r in keys.select("part").distinct().collect()]  # PARTS rows at most
    new = signed.withColumn("part", _part(F.col(key)))
    for name, rows in (("entries", new), ("index", _index(signed, cache.meta["bands"], key))):
        old = spark.read.parquet(f"{cache.folder}/{name}").filter(F.col("part").isin(parts)).distinct()
        files = [s.getPath().toString() for p in parts for s in _listed(spark, f"{cache.folder}/{name}/part={p}")]
        merged = materialise(old.join(keys.select(key), key, "left_anti").unionByName(rows.select(*old.columns)), name)
        merged.repartition("part").write.mode("append").partitionBy("part").parquet(f"{cache.folder}/{name}")
        drop_scratch(spark, files)
        discard(merged)
    discard(keys)
    return _again(spark, cache)


def _listed(spark: SparkSession, folder: str) -> list:
    at, files = _path(spark, folder)
    return list(files.listStatus(at)) if files.exists(at) else []


def _again(spark: SparkSession, cache: Cache) -> Cache:
    read = lambda name: spark.read.parquet(f"{cache.folder}/{name}")
    entries = read("entries").drop("part")
    meta = cache.meta | {"entry_count": entries.count()}
    _write(spark, f"{cache.folder}/meta", json.dumps(meta))
    return Cache(entries, read("index").drop("part"), meta, cache.folder)


def sync(feed: DataFrame, folder: str, full: bool = False, version: str = "v1", bands: int = 16) -> DataFrame:
    """Bring a folder up to a feed of entries (sources.feed.entries); one row added, updated, total.

    full: the feed's signatures replace the corpus. Else entries updated since
    the latest update in the corpus, that one included, are put in by uuid,
    the last of a uuid as it is ordered by its update; nothing is deleted.
    """
    from nearfield.operators.upsert import sync_counts, upsert
    from nearfield.sources.feed import cursor, signatures_of

    spark = feed.sparkSession
    old = None if full else load(spark, folder, version)
    since = cursor(old.entries).first()["since"] if old else None
    batch = signatures_of(feed, version, None if since is None else F.lit(since)).drop("bands").withColumn("family", F.lit(0))
    batch = materialise(batch, "batch")
    cached = old.entries.select(*batch.columns) if old else batch.limit(0)
    counts = materialise(sync_counts(cached, batch, "uuid"), "counts")
    dated = lambda d: d.withColumn("__o", F.coalesce("updated_at", F.lit("")))
    merged = upsert(dated(cached), dated(batch), "uuid", "__o", "signature").drop("__o")
    save(merged, folder, version, bands=bands, key="uuid", synced_at=since)
    return counts
