"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.scratch import discard, materialise


def _mark(edges: DataFrame) -> tuple:
    """A digest of a set of edges."""
    r = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
    return tuple(r)


def _pointed(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller end."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node of its component.

    A round joins every edge with the least neighbour of its end, which is
    aggregated before the shuffle; a hub of many edges is split by adaptive
    skew joins. The edges of each round are a table in the shared folder, so
    the lineage stays short. The number of rounds is logarithmic.
    """
    edges = materialise(_pointed(links), "edges")
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        # large star: the larger neighbours of a node take its least neighbour
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: the smaller neighbours of a node, and the node, take its least neighbour
        large = _pointed(large)
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        before, edges = edges, materialise(_pointed(small), "edges")
        discard(before)
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(edges.select("b", "b").distinct())
