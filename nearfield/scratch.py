"""Intermediate tables in the folder that a cluster shares.

A table that later stages read more than once is written to the folder named
by ``spark.checkpoint.dir`` and read back, so a lost executor costs a re-read
and not a recomputation. Where that setting is absent a local master (tests,
notebooks) uses the session's warehouse folder; on a cluster that is an error,
since a folder of one machine would be missed by the others.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_root(spark: SparkSession) -> str:
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"


def scratch_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_root(spark).rstrip('/')}/nearfield-{uuid.uuid4().hex[:12]}-{tag}"
    if not _written:
        atexit.register(_clean)
    _written.append(path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and return a reader of it."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def materialise_bucketed(df: DataFrame, tag: str, key: str) -> DataFrame:
    """Like ``materialise``, in as many buckets of key as there are shuffle partitions: grouping by key needs no exchange.

    The catalog names the table only until its reader is resolved.
    """
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    name = f"nearfield_{uuid.uuid4().hex}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # of an external table: the files stay
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove materialised tables that nothing reads any more; what was made of them must be written already."""
    for t in tables:
        path = t._scratch_path
        drop_scratch(t.sparkSession, [path])
        _written.remove(path)


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def _clean() -> None:
    """At a clean exit the session's scratch tables go; elsewhere a retention rule on the folder removes them."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    try:
        drop_scratch(spark, _written)
    except Exception:  # noqa: BLE001  the JVM may be gone before the interpreter ends
        pass
