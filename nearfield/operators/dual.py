"""Near pairs of dual hashes, and the trained rotation."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.columns import bands, words64
from nearfield.functions.dual import BITS, HALF, Calibrator, Rotation, dual_hash, plain_signature, raw_of_counts, raw_similarity
from nearfield.operators.blocks import TILE, cuts, groups_of, likely_first, piece_codes, self_cells, share
from nearfield.operators.signing import simhash
from nearfield.scratch import materialise


def dual_sign(embeddings: DataFrame, family: int = 0, rotation: Rotation | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, hash_a, hash_b)."""
    return embeddings.select(key, dual_hash(F.col(vector), family, rotation).alias("h")).select(key, "h.hash_a", "h.hash_b")


def dual_index(signed: DataFrame, n: int = 64, key: str = "vec_id") -> DataFrame:
    """(key, band, value, a, b): one row for each of n pieces of hash_a, 64 by default. Fewer pieces: fewer candidates, less recall."""
    whole = signed.filter(F.col("hash_a").isNotNull()).select(key, words64(F.col("hash_a"), 8).alias("a"), words64(F.col("hash_b"), 8).alias("b"), bands(F.col("hash_a"), n).alias("__p"))
    return whole.select(key, "a", "b", F.posexplode("__p").alias("band", "value")).select(key, "band", "value", "a", "b")


def dual_pairs(index: DataFrame, threshold: float = 0.85, calibrator: Calibrator | None = None, key: str = "vec_id") -> DataFrame:
    """(x, y, similarity) of pairs x < y that share a band and reach the threshold; index: rows of dual_index, all or some.

    A piece of eight bits is shared by most pairs somewhere, and by all where
    vectors are padded, so pairs are not looked for by band: the rows of a
    hash become one, groups of them are compared in cells, and the pieces of
    those that reach the threshold are compared after. Longer pieces are
    counted first, and joined by band where few rows hold the same one.
    """
    calibrate = calibrator or Calibrator()
    bit = lambda low: F.coalesce(F.bit_or(F.when(F.col("band").between(low, low + 63), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("band") - low))), F.lit(0).cast("long"))
    rows = index.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key"), "a", "b", F.length("value").alias("width"))
    rows = materialise(rows.agg(bit(0).alias("low"), bit(64).alias("high")), "dual-hashes")
    n, width, kinds = rows.agg(F.count("*"), F.max("width"), F.count_distinct("low", "high")).first()
    if kinds == 1 and width >= 4:  # all rows have the same bands
        met = index.groupBy("band", "value").agg(F.count("*").cast("double").alias("c")).agg(F.sum(F.col("c") * F.col("c"))).first()[0]
        if met * JOINED < n * n:
            return _pairs_by_band(index, threshold, calibrate, key)
    g = groups_of(n)
    kind = rows.schema["key"].dataType.simpleString()

    def compare(cell: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        owner = table["key"].combine_chunks().dictionary_encode()
        owner, names = owner.indices.to_numpy(), owner.dictionary
        order = np.argsort(owner, kind="stable")
        side = table["right"].to_numpy()[order]
        sides = [order[~side], order[side]] if cell[0].as_py() // g != cell[0].as_py() % g else [order, order]
        if not len(sides[0]) or not len(sides[1]):
            return
        a, b = (np.stack(table[c].to_numpy()).astype(">i8").view(np.uint8).reshape(len(owner), -1) for c in ("a", "b"))
        pieces = piece_codes(a, *(table[c].to_numpy() for c in ("width", "low", "high")))
        left, right = (Hashes.of(a[s], b[s], pieces[:, s], owner[s], missing) for s, missing in zip(sides, (-1, -2), strict=True))
        likely = likely_first(right.pieces)
        live = ~(_same(left.signs, right.signs) & ~left.sure.any(axis=0) & ~right.sure.any(axis=0))
        alike = int(BITS - live.sum())  # bits that are the same everywhere and nowhere sure
        left, right = left.to_floats(live), right.to_floats(live)
        for r0, r1 in cuts(left.owner, TILE[0]):
            for c0, c1 in cuts(right.owner, TILE[1]):
                if sides[0] is sides[1] and left.owner[r0] >= right.owner[c1 - 1]:
                    continue
                equal, sure, both = agreement(left, right, slice(r0, r1), slice(c0, c1), alike)
                s = calibrate.of(raw_of_counts(equal, sure, both))
                good = s >= threshold
                if sides[0] is sides[1]:
                    good &= left.owner[r0:r1, None] < right.owner[None, c0:c1]
                i, j = np.nonzero(good)
                kept = share(left.pieces, right.pieces, i + r0, j + c0, likely)
                i, j = i[kept], j[kept]
                found, p, q = s[i, j], left.owner[i + r0], right.owner[j + c0]
                if len(names) < len(owner):  # a key with several hashes: the best of them
                    best = pd.DataFrame({"p": p, "q": q, "s": found}).groupby(["p", "q"], as_index=False).max()
                    found, p, q = best["s"].to_numpy(), best["p"].to_numpy(), best["q"].to_numpy()
                if len(found):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(p)), names.take(pa.array(q)), pa.array(found)], ["p", "q", "similarity"])

    pairs = self_cells(rows, "key", g).groupBy("cell").applyInArrow(compare, f"p {kind}, q {kind}, similarity double")
    return pairs.select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "similarity")


#: Pairs that are compared in a cell in the time in which one is joined by band.
JOINED = 16


def _pairs_by_band(index: DataFrame, threshold: float, calibrator: Calibrator, key: str) -> DataFrame:
    similarity: Column = calibrator(raw_similarity(F.col("a1"), F.col("b1"), F.col("a2"), F.col("b2")))
    # equal hashes are one node; candidates are pairs of nodes, made distinct before hashes are fetched for them
    rows = index.withColumn("node", F.xxhash64("a", "b"))
    members, hashes = rows.select(key, "node").distinct(), rows.select("node", "a", "b").distinct()
    bands = rows.select("band", "value", "node").distinct()
    met = bands.select("band", "value", F.col("node").alias("l")).join(bands.select("band", "value", F.col("node").alias("r")), ["band", "value"])
    met = met.filter(F.col("l") <= F.col("r")).select("l", "r").distinct()
    met = met.join(hashes.select(F.col("node").alias("l"), F.col("a").alias("a1"), F.col("b").alias("b1")), "l").join(hashes.select(F.col("node").alias("r"), F.col("a").alias("a2"), F.col("b").alias("b2")), "r")
    met = met.select("l", "r", similarity.alias("similarity")).filter(F.col("similarity") >= threshold)
    pairs = met.join(members.select(F.col(key).alias("p"), F.col("node").alias("l")), "l").join(members.select(F.col(key).alias("q"), F.col("node").alias("r")), "r").filter(F.col("p") != F.col("q"))
    return pairs.groupBy(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")).agg(F.max("similarity").alias("similarity"))


@dataclass
class Hashes:
    """Dual hashes of one side of a cell: bits (rows, bits) and pieces (bands, rows), owners ascending."""

    signs: np.ndarray
    sure: np.ndarray
    pieces: np.ndarray
    owner: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, pieces: np.ndarray, owner: np.ndarray, missing: int) -> Hashes:
        return cls(np.unpackbits(a, axis=1).astype(bool), np.unpackbits(b, axis=1).astype(bool), np.where(pieces < 0, missing, pieces), owner)

    def to_floats(self, live: np.ndarray) -> Hashes:
        """Signs as -1 and 1 and confidence as 0 and 1, of the live bits alone: products of rows are whole numbers, exact in 32 bits."""
        return Hashes(self.signs[:, live] * np.float32(2) - np.float32(1), self.sure[:, live].astype(np.float32), self.pieces, self.owner)


def _same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Columns of one value in the rows of both."""
    return (x == x[0]).all(axis=0) & (y == x[0]).all(axis=0)


def agreement(left: Hashes, right: Hashes, rows: slice, columns: slice, alike: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row with each column: bits that agree, bits sure on both sides, and bits that are both; alike: bits left out, which agree."""
    x, y, u, v = left.signs[rows], right.signs[columns], left.sure[rows], right.sure[columns]
    n = x.shape[1]
    equal = (x @ y.T + np.float32(n)) / 2 + alike
    sure = u @ v.T
    return equal, sure, ((x * u) @ (y * v).T + sure) / 2


def verify_plain(embeddings: DataFrame, family: int = 0, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, plain, agrees): the first 256 bits of the dual hash, and whether they equal the plain signature of the family."""
    signed = embeddings.select(key, plain_signature(dual_hash(F.col(vector), family)["hash_a"]).alias("plain"), simhash(F.col(vector), family).alias("__s"))
    return signed.select(key, "plain", (F.col("plain") == F.col("__s")).alias("agrees"))


def train_rotation(embeddings: DataFrame, rounds: int = 50, sample_rows: int = 20_000, seed: int = 7, key: str = "vec_id", vector: str = "embedding") -> Rotation:
    """Mean and main axes of all vectors, turned so that signs lose least (iterative quantisation).

    Sums and products are added up on the executors: one (d + 1, d) block for
    each task comes to the driver, by way of a sum per entry. The turn is
    fitted on a hashed sample of about ``sample_rows`` vectors, 2 * that at most.
    """
    vectors = embeddings.filter(F.col(vector).isNotNull()).select(F.xxhash64(F.lit(seed), key).alias("__u"), F.col(vector).cast("array<double>").alias("v"))

    def moments(batches):
        block = None
        for b in batches:
            if len(b):
                x = np.stack(b["v"])
                part = np.vstack([x.sum(axis=0), x.T @ x])
                block, n = (part, len(x)) if block is None else (block + part, n + len(x))
        if block is not None:
            yield pd.DataFrame({"i": np.arange(block.size + 1), "s": np.r_[block.ravel(), n]})

    # bounded by the dimensions: d * (d + 1) + 1 rows
    got = vectors.select("v").mapInPandas(moments, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").toPandas()["s"].to_numpy()
    if not len(got):
        raise ValueError("no vectors to train on")
    n, d = got[-1], int((np.sqrt(4 * len(got) - 3) - 1) / 2)
    block = got[:-1].reshape(d + 1, d)
    mean = block[0] / n
    values, axes = np.linalg.eigh(block[1:] / n - np.outer(mean, mean))
    k = min(HALF, d)
    axes = axes[:, np.argsort(-values)[:k]].T
    share = min(1.0, sample_rows / n)
    some = vectors.filter(F.pmod("__u", F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample_rows).orderBy("__u").toPandas()["v"]
    turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(k, k)))[0]
    if len(some):
        x = (np.stack(some) - mean) @ axes.T
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(x @ turn > 0, 1.0, -1.0).T @ x)
            turn = (u @ v).T
    full = np.zeros((HALF, d))
    full[:k] = turn.T @ axes
    return Rotation(mean, full)
