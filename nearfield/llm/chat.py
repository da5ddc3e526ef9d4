"""Multi-party perspective rotation of dialogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
USER = "user name="


def rotate(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """One row for each conversation and participant: the whole dialogue with that participant as assistant.

    A participant is any speaker but ``system``; a null speaker is named
    ``unknown``. In a participant's rendering that speaker's turns are the
    assistant's, system turns stay system, and the others are users under
    their names. ``mask`` holds the half-open code-point spans that carry
    loss: each assistant text with its closing mark. Turns are ordered by
    turn (null last), speaker and text, so repeated turns are kept, ties have
    one order, and a null text is rendered empty. A conversation of system
    turns alone has no row. A null conv_id is one conversation. Other columns
    are left out, and an empty table gives an empty result.

    Where each turn begins is a running sum over the conversation, taken as
    if all were users; a participant's own turns shift it by the same length
    each. So the work is linear in the dialogue for each participant. A row
    holds its whole dialogue, however long: that is the result asked for.
    """
    t = turns.select(F.col(conv_id).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("unknown")).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"))
    order = [F.col("t").asc_nulls_last(), "r", "x"]
    head = F.length("r") + F.when(F.col("r") == system, 0).otherwise(len(USER))
    size = head + F.length("x") + len(OPEN) + len(CLOSE) + 2
    inside = Window.partitionBy("c").orderBy(*order)
    t = t.withColumns({
        "seq": F.row_number().over(inside),
        "at": F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "own": F.row_number().over(Window.partitionBy("c", "r").orderBy(*order)) - 1,
    })
    whole = t.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("seq", "r", "x", "at", "own"))).alias("m"))
    speakers = F.array_distinct(F.transform(F.filter("m", lambda m: m["r"] != system), lambda m: m["r"]))
    whole = whole.withColumn("perspective", F.explode(speakers))

    me = F.col("perspective")
    name = lambda m: F.when(m["r"] == me, "assistant").when(m["r"] == system, system).otherwise(F.concat(F.lit(USER), m["r"]))
    rendered = F.array_join(F.transform("m", lambda m: F.concat(F.lit(OPEN), name(m), F.lit("\n"), m["x"], F.lit(CLOSE + "\n"))), "")
    shorter = F.length(me) + len(USER) - len("assistant")
    begin = lambda m: m["at"] - m["own"] * shorter + len(OPEN) + len("assistant") + 1
    span = lambda m: F.struct(begin(m).cast("int").alias("start"), (begin(m) + F.length(m["x"]) + len(CLOSE)).cast("int").alias("end"))
    mask = F.transform(F.filter("m", lambda m: m["r"] == me), span)
    return whole.select(F.col("c").alias(conv_id), "perspective", F.size("m").alias("n_turns"), rendered.alias("rendered"), mask.alias("mask"))


def op2_perspectives(spark, sf_dir: str) -> DataFrame:
    """All conversations, each rendered whole (part 0); the mask as text, ``start:end`` joined by commas. Nulls, ties and repeats as in ``rotate``."""
    out = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumn("part", F.lit(0).cast("long"))
    mask = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.withColumn("mask", mask)


OP2_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS r, coalesce(text, '') AS x,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) AS seq
  FROM conversations),
p AS (SELECT DISTINCT conv_id, r AS perspective FROM t WHERE r <> 'system'),
m AS (
  SELECT t.conv_id, perspective, seq, r = perspective AS mine, x,
         '<|im_start|>' || CASE WHEN r = perspective THEN 'assistant' WHEN r = 'system' THEN 'system' ELSE 'user name=' || r END || chr(10) AS h
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (
  SELECT *, coalesce(sum(length(h) + length(x) + 11) OVER (PARTITION BY conv_id, perspective ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(h) AS b
  FROM m)
SELECT conv_id, perspective, 0::BIGINT AS part, count(*)::INT AS n_turns,
       string_agg(h || x || '<|im_end|>' || chr(10), '' ORDER BY seq) AS rendered,
       coalesce(string_agg(b::BIGINT || ':' || (b + length(x) + 10)::BIGINT, ',' ORDER BY seq) FILTER (mine), '') AS mask
FROM o GROUP BY conv_id, perspective
"""
