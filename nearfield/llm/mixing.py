"""Capped water-filling over sources, then seeded whole and fractional repetitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.words import word_count
from nearfield.operators.numbering import numbered
from nearfield.scratch import materialise

#: Order buckets of a source: only the bucket in which a fraction ends is ranked.
BUCKET_DIGITS = 3


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """sources (skey, source_size, weight) with ``target``, the level of each source.

    A source stops at max_epochs times its size; what it cannot take is
    shared again by weight, until no source is above. Each round is one sum
    over all sources, a row that the driver reads; a round clamps a source at
    least, or is the last.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    everything, weights = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(float(share)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    taken, heavy, n = 0.0, 0.0, 0
    while True:
        full = F.lit(everything - taken) * F.col("weight") >= cap * F.lit(weights - heavy)
        now = sources.filter(full).agg(F.coalesce(F.sum(cap), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0)), F.count("*")).first()
        if now[2] <= n:
            break
        taken, heavy, n = now
    level = F.lit(everything - taken) * F.col("weight") / F.lit(weights - heavy) if weights > heavy else cap
    return sources.withColumn("target", F.when(full, cap).otherwise(level))


def _keys(seed: int, doc_id: str, source: str, text: str) -> dict[str, Column]:
    """What the plan knows of a document: its source (null after every other), its place in the seeded order, its size."""
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.md5(F.col(text).cast("binary")), F.lit(""))).cast("binary"))
    return {"__source": F.coalesce(F.concat(F.lit("0"), F.col(source).cast("string")), F.lit("1")), "__order": order, "__size": word_count(F.col(text))}


def plan(thin: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """One row per source: its size, target, whole repetitions, and the cut up to which documents get one more.

    thin: (__source, __order, __size). Documents of a source are in the order
    of (__order, __size); those whose middle lies within the rest of the
    target are before the cut, given as the bucket of the last one and its
    (__order, __size). n_in of the n_at documents that equal the cut are in.
    """
    bucket = F.substring("__order", 1, BUCKET_DIGITS).alias("bucket")
    buckets = materialise(thin.groupBy("__source", bucket).agg(F.sum("__size").alias("size")), "mix-buckets")
    sources = numbered(buckets.groupBy(F.col("__source").alias("skey")).agg(F.sum("size").alias("source_size")), ["skey"], "nth")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = materialise(sources.withColumn("weight", F.element_at(cycle, (F.col("nth") % len(weights) + 1).cast("int"))), "mix-sources")
    levels = water_fill(sources.drop("nth"), share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    levels = materialise(levels.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size")), "mix-levels")

    run = Window.partitionBy("__source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 16 ** BUCKET_DIGITS rows at most
    placed = buckets.withColumn("start", F.coalesce(F.sum("size").over(run), F.lit(0))).join(levels, F.col("__source") == F.col("skey"))
    edge = placed.filter((F.col("part") > 0) & (F.col("start") <= F.col("part")) & (F.col("part") < F.col("start") + F.col("size"))).select("skey", F.col("bucket").alias("edge"), "start", "part")
    edge = materialise(edge, "mix-edges")
    rows = thin.join(edge, (F.col("__source") == F.col("skey")) & (F.substring("__order", 1, BUCKET_DIGITS) == F.col("edge")))
    inside = Window.partitionBy("skey").orderBy("__order", "__size").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("start") + F.coalesce(F.sum("__size").over(inside), F.lit(0)) + F.col("__size") / F.lit(2.0)
    tied = rows.withColumn("in", (middle <= F.col("part")).cast("long")).groupBy("skey", F.struct("__order", "__size").alias("cut")).agg(F.sum("in").alias("n_in"), F.count("*").alias("n_at"))
    cut = tied.filter("n_in > 0").groupBy("skey").agg(F.max(F.struct("cut", "n_in", "n_at")).alias("c")).select("skey", "c.*")
    out = levels.join(edge.select("skey", "edge"), "skey", "left").join(cut, "skey", "left")
    return materialise(out.select("skey", "source_size", "target", "whole", "edge", "cut", "n_in", "n_at"), "mix-plan")


def apply_plan(rows: DataFrame, made: DataFrame) -> DataFrame:
    """rows (__source, __order, __size and more) with source_size, target, reps and taken.

    The plan has a row for each source; Spark sends it to all tasks if it is
    small, and the rows then stay where they are.
    """
    key = F.struct("__order", "__size")
    bucket = F.substring("__order", 1, BUCKET_DIGITS)
    d = rows.join(made, F.col("__source") == F.col("skey"))
    at_cut = F.coalesce(key == F.col("cut"), F.lit(False))
    more = F.coalesce((bucket < F.col("edge")) | ((bucket == F.col("edge")) & (key <= F.col("cut"))), F.lit(False)).cast("long")
    if made.filter("n_in < n_at").isEmpty():
        d = d.withColumn("__more", more)
    else:  # equal documents lie on both sides of a cut: so many of them as fit
        split = at_cut & (F.col("n_in") < F.col("n_at"))
        some = d.filter(split).withColumn("__more", (F.row_number().over(Window.partitionBy("skey").orderBy("__order")) <= F.col("n_in")).cast("long"))
        d = d.filter(~F.coalesce(split, F.lit(False))).withColumn("__more", more).unionByName(some)
    d = d.withColumn("reps", F.col("whole") + F.col("__more")).withColumn("taken", F.col("reps") * F.col("__size"))
    return d.drop("skey", "whole", "edge", "cut", "n_in", "n_at", "__more")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 42, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per document: its columns and size, source_size, target, reps, taken.

    Sources in the order of their code points, null last, take ``weights`` in
    turn. Every document of a source is repeated floor(target / size of the
    source) times; the rest of the target is filled with one more repetition
    of documents in a seeded order (MD5 of seed and id, or of the text of a
    row without id), up to the document whose middle passes the target, so
    the source misses its target by half a document at most. A source at its
    cap has no rest, so no document is over max_epochs (a whole number), and
    documents of a source without words are not taken. ``taken`` is words
    taken, ``reps`` repetitions. A null text has no words. Equal rows may
    stand for each other. An empty table gives an empty result. Columns of
    docs of these names are replaced.

    The plan is made of thin rows, which are written once; texts are read
    again to have it applied, and are not shuffled.
    """
    own = ["size", "source_size", "target", "reps", "taken"]
    docs = docs.drop(*own)
    keys = _keys(seed, doc_id, source, text)
    thin = materialise(docs.select(*[c.alias(k) for k, c in keys.items()]), "mix-thin")
    out = apply_plan(docs.withColumns(keys), plan(thin, weights, share, max_epochs))
    return out.select(*docs.columns, F.col("__size").alias("size"), "source_size", "target", "reps", "taken")


def repeat_rows(mixed: DataFrame) -> DataFrame:
    """Each row as often as ``reps`` says."""
    return mixed.filter("reps > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("reps").cast("int")))).drop("__copy")


def op8_water_fill(spark, sf_dir: str) -> DataFrame:
    """All documents; nulls, ties and repeated rows as in ``mix``. The result needs no text, so texts are read once."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    thin = materialise(docs.select("doc_id", *[c.alias(k) for k, c in _keys(42, "doc_id", "source", "text").items()]), "mix-thin")
    out = apply_plan(thin, plan(thin, (3, 1, 2), 1.5, 2.0))
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('0' || source, '1') AS skey,
         md5('42|' || coalesce(doc_id::VARCHAR, md5(text), '')) AS o
  FROM documents),
per_source AS (SELECT skey, sum(size)::BIGINT AS source_size FROM sized GROUP BY skey),
weighted AS (
  SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY skey) - 1) % 3 + 1)::INT]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap
  FROM per_source),
running AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS everything, sum(weight) OVER () AS weights,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS cap_before,
         coalesce(sum(weight) OVER (ORDER BY cap / weight, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS weight_before
  FROM weighted),
clamped AS (SELECT *, (everything - cap_before) * weight >= cap * (weights - weight_before) AS is_full FROM running),
summed AS (
  SELECT *, coalesce(sum(cap) FILTER (is_full) OVER (), 0.0) AS taken_caps, coalesce(sum(weight) FILTER (is_full) OVER (), 0.0) AS heavy
  FROM clamped),
levels AS (
  SELECT skey, source_size, CASE WHEN is_full THEN cap ELSE (everything - taken_caps) * weight / (weights - heavy) END AS target
  FROM summed),
run AS (
  SELECT s.*, l.source_size, l.target, CASE WHEN l.source_size > 0 THEN floor(l.target / l.source_size)::BIGINT ELSE 0 END AS whole,
         coalesce(sum(s.size) OVER (PARTITION BY s.skey ORDER BY o, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN levels l USING (skey))
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM run
"""
