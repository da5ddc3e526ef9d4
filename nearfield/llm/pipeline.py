"""A training corpus from raw documents: five stages, each a table of the next.

Toxic documents go; one document of each group of near copies stays;
documents that hold a benchmark item go; sources are repeated to their target
weights; the rest is dealt over shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import decontaminate, mixing, sharding, simhash, toxicity
from nearfield.scratch import materialise

N_SHARDS = 8


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, scores below its threshold."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(docs, simhash.NEAR_COPIES)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover less than 0.8 of every benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the capped mix of sources takes them."""
    return mixing.repeat_rows(mixing.mix(docs)).select(*docs.columns)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot. A repeated document counts once for each repetition."""
    return sharding.shard_documents(docs, N_SHARDS).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long"))


STAGES = [
    ("toxicity", toxic),
    ("simhash_near_dedup", near_copies),
    ("benchmark_decontamination", benchmark_leaks),
    ("mixing", mixture),
    ("sharding", shards),
]

#: The classifier and the fingerprints are beyond SQL; tests/llm holds each stage's rows against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through all stages; nulls, ties and repeated rows as in the operators."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
