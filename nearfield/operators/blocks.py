"""Rows in groups by key, each group meeting the others in a cell: every pair is compared once, and no pair is shuffled for it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a group, about. A worker holds the two groups of a cell.
ROWS = 8192
#: Pairs that are compared at a time: so many rows of one group with so many of the other.
TILE = (256, 4096)


def groups_of(n: int) -> int:
    """How many groups n rows make: none too large to hold, and 16 if that leaves 512 rows in each, so that tasks have work."""
    return max(1, -(-n // ROWS), min(n // 512, 16))


def self_cells(rows: DataFrame, key: str, g: int) -> DataFrame:
    """rows with (cell, right) for each cell i * g + j, i <= j, in which their group is; rows of one key share a group."""
    group = F.pmod(F.xxhash64(key), F.lit(g)).cast("long")
    met = rows.withColumn("__g", group).withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    out = met.select((F.least("__g", "__o") * g + F.greatest("__g", "__o")).alias("cell"), (F.col("__g") > F.col("__o")).alias("right"), *rows.columns)
    return out.repartition(min(g * (g + 1) // 2, 4096), "cell")


def cross_cells(left: DataFrame, right: DataFrame, left_key: str, right_key: str, g: int, h: int) -> DataFrame:
    """The rows of both, with (cell, right), for each of the g * h cells of a group of left and one of right; both have the same columns but for the key, which is ``key`` here."""

    def dealt(d, key, own, others, place):
        rest = [c for c in d.columns if c != key]
        met = d.withColumn("__g", F.pmod(F.xxhash64(key), F.lit(own)).cast("long")).withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return met.select(place.alias("cell"), F.lit(place is flipped).alias("right"), F.col(key).alias("key"), *rest)

    straight, flipped = F.col("__g") * h + F.col("__o"), F.col("__o") * h + F.col("__g")
    return dealt(left, left_key, g, h, straight).unionByName(dealt(right, right_key, h, g, flipped)).repartition(min(g * h, 4096), "cell")


def cuts(owner: np.ndarray, step: int) -> list[tuple[int, int]]:
    """Ranges of about step rows that part no rows of one owner; owner ascends."""
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    at = np.unique(starts[np.searchsorted(starts, np.arange(0, len(owner), step), side="right") - 1])
    return list(zip(at.tolist(), [*at[1:].tolist(), len(owner)], strict=True))


def piece_codes(a: np.ndarray, width: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(bands, rows): a number for each piece of the rows' hex digits, equal for equal pieces of one call; -1 for those that a row doesn't have."""
    if len(set(width.tolist())) != 1:
        raise ValueError("an index has pieces of one length")
    w = int(width[0])
    digits = np.stack([a >> 4, a & 15], axis=2).reshape(len(a), -1)
    out = np.full((digits.shape[1] // w, len(a)), -1, dtype=np.int64)
    for k in range(len(out)):
        piece = digits[:, k * w : (k + 1) * w]
        own = (((low, high)[k // 64].astype(np.uint64) >> np.uint64(k % 64)) & np.uint64(1)).astype(bool)
        if w <= 15:
            code = (piece.astype(np.int64) << (4 * np.arange(w, dtype=np.int64))).sum(axis=1)
        else:
            code = np.unique(np.ascontiguousarray(piece).view(f"V{w}").ravel(), return_inverse=True)[1].ravel()
        out[k, own] = code[own]
    return out


def likely_first(pieces: np.ndarray) -> np.ndarray:
    """Bands in the order in which to look for an equal piece: those whose commonest piece is most common come first."""
    return np.argsort([-np.unique(x, return_counts=True)[1].max() for x in pieces], kind="stable")


def share(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, bands: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows (i, j) have an equal piece, looked for in the order of bands."""
    out, rest = np.zeros(len(i), dtype=bool), np.arange(len(i))
    for k in bands:
        hit = left[k, i] == right[k, j]
        out[rest[hit]] = True
        rest, i, j = rest[~hit], i[~hit], j[~hit]
        if not len(rest):
            break
    return out
