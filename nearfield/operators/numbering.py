"""Places in a total order, and what is read off them, without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.scratch import materialise


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """rows with their place in the order, from 0; equal rows have any order among themselves.

    Rows are dealt by range, sorted and written; each task's count, a row for
    a task, gives the place of its first row.
    """
    order = [*order, "__u"]  # rows that are equal otherwise may go to several tasks
    dealt = rows.withColumn("__u", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("__u")
    kept = materialise(dealt.withColumn("__id", F.monotonically_increasing_id()), "numbered")
    task, row = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = kept.groupBy(task.alias("__task")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__task")) - F.col("__n")  # as many rows as there are tasks
    shift = counts.select("__task", before.alias("__before"))
    return kept.withColumn("__task", task).join(F.broadcast(shift), "__task").withColumn(name, row + F.col("__before")).drop("__id", "__task", "__before")


def exclusive_percentiles(rows: DataFrame, value: str, percents: tuple[int, ...] = (50, 95, 99), group: str | None = None) -> DataFrame:
    """(group, n, max, mean, p50, p95, p99): percentiles by the exclusive method, as ``statistics.quantiles`` has them.

    The i-th of 100 cut points lies between the values of rank j and j + 1
    for j = i * (n + 1) // 100, kept from 1 to n - 1, by the remainder. Nulls
    are left out; a group of one value has null percentiles. Without group
    there is one row.
    """
    keys = [group] if group else []
    known = rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    placed = numbered(known, [*keys, "__v"])
    total = placed.groupBy(*keys).agg(F.count("*").alias("n"), F.min("place").alias("__first"), F.max("__v").alias("max"), F.avg("__v").alias("mean"))
    each = placed.join(total.select(*keys, "n", "__first"), keys) if keys else placed.crossJoin(F.broadcast(total.select("n", "__first")))
    rank = F.col("place") - F.col("__first") + 1
    cut = {i: F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(i * (F.col("n") + 1) / 100))) for i in percents}

    def at(r: Column) -> Column:
        return F.max(F.when(rank == r, F.col("__v")))

    found = each.groupBy(*keys).agg(*[x for i, j in cut.items() for x in (at(j).alias(f"__lo{i}"), at(j + 1).alias(f"__hi{i}"))])
    out = total.join(found, keys) if keys else total.crossJoin(F.broadcast(found))
    delta = {i: i * (F.col("n") + 1) - cut[i] * 100 for i in percents}
    between = [((F.col(f"__lo{i}") * (100 - delta[i]) + F.col(f"__hi{i}") * delta[i]) / 100).alias(f"p{i}") for i in percents]
    return out.select(*keys, "n", "max", "mean", *between)
