"""Consistent-hash ring with virtual nodes and bounded loads.

The ring is cut into equal cells. Every shard owns virtual nodes, each at the
start of a cell; a key belongs to the first virtual node at or after its cell
and, where that shard is full, continues clockwise to the next shard with
room. Only the number of keys in a cell matters for that walk, so the driver
walks a table of at most ``cells`` counts and the rows themselves are ranked
inside their cell, by as many tasks as there are cells. The rows of a cell
that holds very many (equal rows, which no key parts) are numbered by several
tasks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators.numbering import numbered

CELLS = 1 << 16
VNODES = 64
#: Rows of a cell from which on several tasks number them, if it holds HOT_TIMES the mean too.
HOT_ROWS = 200_000
HOT_TIMES = 4


@dataclass(frozen=True)
class Ring:
    """Virtual nodes clockwise: (cell, shard)."""

    n_shards: int
    vnodes: int = VNODES
    cells: int = CELLS
    seed: str = "ring"

    def nodes(self) -> list[tuple[int, int]]:
        points = []
        for shard in range(self.n_shards):
            for v in range(self.vnodes):
                digest = hashlib.sha256(f"{self.seed}/{shard}/{v}".encode()).digest()
                points.append((int.from_bytes(digest[:8], "big"), shard))
        return [(p * self.cells >> 64, shard) for p, shard in sorted(points)]

    def successors(self) -> list[list[int]]:
        """For each cell the shards in the order in which a key meets them clockwise."""
        nodes = self.nodes()
        n = len(nodes)
        orders = []  # of each virtual node: the shards from it on
        for k in range(n):
            orders.append(list(dict.fromkeys(nodes[(k + j) % n][1] for j in range(n))))
        out, at = [], 0
        for cell in range(self.cells):
            while at < n and nodes[at][0] < cell:
                at += 1
            out.append(orders[at % n])
        return out


def capacities(rows: int, n_shards: int, epsilon: float) -> list[int]:
    """epsilon 0: the exact split, counts at most one apart. Else ceil((1 + epsilon) * mean) for every shard."""
    if epsilon <= 0:
        return [rows // n_shards + (s < rows % n_shards) for s in range(n_shards)]
    cap = -(-int(rows * (1 + epsilon) * 1_000_000) // (n_shards * 1_000_000)) + 1
    return [cap] * n_shards


def segments(counts: dict[int, int], ring: Ring, epsilon: float) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, slot of the first rank): where the rows of each cell go."""
    room = capacities(sum(counts.values()), ring.n_shards, epsilon)
    used = [0] * ring.n_shards
    order = ring.successors()
    out = []
    for cell in sorted(counts):
        left, rank = counts[cell], 0
        for shard in order[cell]:
            n = min(left, room[shard] - used[shard])
            if n > 0:
                out.append((cell, rank, rank + n, shard, used[shard]))
                used[shard] += n
                rank += n
                left -= n
            if not left:
                break
    return out


def cell_of(key: Column, cells: int) -> Column:
    """The cell of a 64-bit key; cells is a power of two."""
    return F.shiftrightunsigned(key, 64 - (cells - 1).bit_length()).cast("int")


def moved(counts: dict[int, int], n_shards: int, epsilon: float, cells: int = CELLS) -> float:
    """Share of the keys, so many in each cell, that change their shard when one more shard joins."""
    before, after = ({(c, r): s for c, a, z, s, _ in segments(counts, Ring(n, cells=cells), epsilon) for r in range(a, z)} for n in (n_shards, n_shards + 1))
    return sum(after[k] != s for k, s in before.items()) / max(1, len(before))


def shard_documents(docs: DataFrame, n_shards: int = 8, epsilon: float = 0.0, vnodes: int = VNODES, cells: int = CELLS, doc_id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """docs with columns ``shard`` (0 to n_shards - 1) and ``slot`` (gapless from 0 in each shard).

    With epsilon 0 the numbers of rows of any two shards differ by one at
    most; a larger epsilon lets a shard run over the mean by that part and
    moves fewer keys when shards are added. Keys are the ids with the texts,
    so that an id of many rows has many keys; null id and text are a key too.
    Equal rows are placed one by one, in any order among themselves. An empty
    table gives an empty result. Columns of docs named shard or slot are
    replaced; others pass through.
    """
    ring = Ring(n_shards, vnodes, cells)
    key, cell, rank = "__ring_key", "__ring_cell", "__ring_rank"
    placed = docs.drop("shard", "slot").withColumn(key, F.xxhash64(F.col(doc_id), F.col(text)))
    placed = placed.withColumn(cell, cell_of(F.col(key), cells))
    counts = {r[0]: r[1] for r in placed.groupBy(cell).count().collect()}  # at most `cells` rows
    rows = segments(counts, ring, epsilon)
    table = docs.sparkSession.createDataFrame(rows, "__c int, __from long, __end long, shard int, __slot long")
    inside = Window.partitionBy(cell).orderBy(key, doc_id)
    limit = max(hot_rows, HOT_TIMES * sum(counts.values()) // cells)  # under cells / HOT_TIMES cells are hot, however many rows there are
    hot = [c for c, n in counts.items() if n > limit]
    few = placed.filter(~F.col(cell).isin(hot)) if hot else placed
    ranked = few.withColumn(rank, F.row_number().over(inside).cast("long") - 1)
    if hot:
        many = numbered(placed.filter(F.col(cell).isin(hot)), [cell, key], rank)
        first = many.groupBy(F.col(cell).alias("__c")).agg(F.min(rank).alias("__first"))  # a row for each hot cell
        many = many.join(F.broadcast(first), F.col(cell) == F.col("__c")).withColumn(rank, F.col(rank) - F.col("__first")).drop("__c", "__first")
        ranked = ranked.unionByName(many)
    # at most cells + cells * (n_shards - 1) rows, in practice cells + n_shards: a shard fills up once
    out = ranked.join(F.broadcast(table), (F.col(cell) == F.col("__c")) & (F.col(rank) >= F.col("__from")) & (F.col(rank) < F.col("__end")))
    return out.withColumn("slot", F.col("__slot") + F.col(rank) - F.col("__from")).drop(key, cell, rank, "__c", "__from", "__end", "__slot")


def op3_ring(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 under the law ``rows``; nulls, ties and repeated rows as in ``shard_documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).cast("long")
    # the text itself does not travel, its hash does
    thin = docs.select("doc_id", F.xxhash64("text").cast("string").alias("text"), size.alias("size"), crc.alias("text_crc32"))
    return shard_documents(thin).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
