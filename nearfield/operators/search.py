"""Candidates by band, verified by Hamming distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.columns import cosine_from_hamming, embedding_sha256, hamming_words, largest_distance, normalise
from nearfield.operators.blocks import ROWS, TILE, cross_cells, cuts, groups_of, likely_first, piece_codes, share


def near_pairs(index: DataFrame, threshold: float = 0.85, key: str = "vec_id") -> DataFrame:
    """(a, b, hamming, cosine) of pairs a < b that share a band and reach the threshold.

    Equal signatures are one node: nodes are joined by their words, candidates
    are made distinct before they are compared, and only then pairs are
    written out for the keys of two nodes. Rows without a signature match
    nothing.
    """
    rows = index.filter(F.col("words").isNotNull()).withColumn("node", F.xxhash64("words"))
    members = rows.select(key, "node").distinct()
    nodes = rows.select("family", "band", "value", "node", "words").distinct()
    left = nodes.select("family", "band", "value", F.col("node").alias("na"))
    right = nodes.select("family", "band", "value", F.col("node").alias("nb"))
    met = left.join(right, ["family", "band", "value"]).filter(F.col("na") <= F.col("nb")).select("na", "nb").distinct()
    words = nodes.select("node", "words").distinct()
    near = hamming_words(F.col("wa"), F.col("wb"))
    met = met.join(words.select(F.col("node").alias("na"), F.col("words").alias("wa")), "na").join(words.select(F.col("node").alias("nb"), F.col("words").alias("wb")), "nb")
    met = met.select("na", "nb", near.alias("hamming")).filter(F.col("hamming") <= largest_distance(threshold))
    pairs = met.join(members.select(F.col(key).alias("x"), F.col("node").alias("na")), "na").join(members.select(F.col(key).alias("y"), F.col("node").alias("nb")), "nb")
    pairs = pairs.filter(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "hamming")
    best = pairs.groupBy("a", "b").agg(F.min("hamming").alias("hamming"))
    return best.withColumn("cosine", cosine_from_hamming(F.col("hamming")))


def find_similar(queries: DataFrame, corpus: DataFrame, threshold: float = 0.85, max_results: int = 10, query: str = "query_id", key: str = "vec_id", least_bands: int = 1) -> DataFrame:
    """The max_results best matches of each query, ties by key; both sides are band tables.

    least_bands: shared bands that a candidate needs.
    """
    c = corpus.select(F.col(key), "family", "band", "value", F.col("words").alias("wc"))
    hits = queries.join(c, ["family", "band", "value"])
    found = hits.groupBy(query, key).agg(F.countDistinct("family", "band").alias("n_bands"), F.min(hamming_words(F.col("words"), F.col("wc"))).alias("hamming"), F.min("family").alias("tier"))
    found = found.filter((F.col("n_bands") >= least_bands) & (F.col("hamming") <= largest_distance(threshold)))
    found = found.withColumn("cosine", cosine_from_hamming(F.col("hamming")))
    rank = F.row_number().over(Window.partitionBy(query).orderBy("hamming", key))
    return found.withColumn("rank", rank).filter(F.col("rank") <= max_results)


def exact_scan(queries: DataFrame, corpus: DataFrame, max_distance: int = 55, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """Every corpus row within max_distance of a stated set of queries: (query, key, hamming). Both have ``words``."""
    q = queries.select(F.col(query), F.col("words").alias("wq"))
    near = hamming_words(F.col("wq"), F.col("words"))
    return corpus.join(q, near <= max_distance).select(query, key, near.alias("hamming"))


def quality(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row tp, fp, fn, precision, recall, f1 of two sets of pairs (a, b)."""
    both = truth.select("a", "b").distinct().withColumn("t", F.lit(1)).join(predicted.select("a", "b").distinct().withColumn("p", F.lit(1)), ["a", "b"], "full")
    return _rates(both.agg(F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn")))


def _rates(n: DataFrame) -> DataFrame:
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    n = n.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return n.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def tiered_search(queries: DataFrame, corpus: DataFrame, threshold: float = 0.85, min_results: int = 10, families: int = 3, query: str = "query_id", key: str = "vec_id") -> DataFrame:
    """(query, key, tier, hamming, rank): matches from as few families as give min_results, in one pass.

    tier: the first family in which the pair shares a band and reaches the
    threshold. A query goes on to the next family while it has fewer than
    min_results matches; ties by key.
    """
    c = corpus.select(F.col(key), "family", "band", "value", F.col("words").alias("wc"))
    hits = queries.filter(F.col("family") < families).join(c, ["family", "band", "value"]).select(query, key, "family", hamming_words(F.col("words"), F.col("wc")).alias("hamming"))
    first = hits.filter(F.col("hamming") <= largest_distance(threshold)).groupBy(query, key).agg(F.min(F.struct("family", "hamming")).alias("m")).select(query, key, F.col("m.family").alias("tier"), F.col("m.hamming").alias("hamming"))
    enough = first.groupBy(query, "tier").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(query).orderBy("tier").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = enough.withColumn("before", before).filter(F.col("before") < min_results).select(query, "tier")
    rank = F.row_number().over(Window.partitionBy(query).orderBy("hamming", key))
    return first.join(used, [query, "tier"]).withColumn("rank", rank).filter(F.col("rank") <= min_results).select(query, key, "tier", "hamming", "rank")


def closest_pairs(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The k closest of near_pairs, best first; ties by a and b."""
    return pairs.orderBy("hamming", "a", "b").limit(k)


#: Vectors that a stated query set may have: they are sent to every executor.
MAX_QUERIES = 10_000


def exact_cosine(queries: DataFrame, corpus: DataFrame, threshold: float | None = None, k: int | None = None, query: str = "query_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query, key, cosine) of a stated query set against all rows: those that reach the threshold, and the k best of a query.

    The truth that lookups are measured by. Queries, MAX_QUERIES at most (an
    error beyond), go to every executor as a matrix and meet the corpus block
    by block; a block keeps its own k best before they are ranked, ties by
    key. Null vectors, and vectors of other lengths, match nothing; a zero
    vector has cosine 0 with all. A row may match itself.
    """
    got = queries.filter(F.col(vector).isNotNull()).select(query, F.col(vector).cast("array<double>").alias("v")).limit(MAX_QUERIES + 1).collect()
    if len(got) > MAX_QUERIES:
        raise ValueError(f"over {MAX_QUERIES} queries; ask in parts")
    by_size: dict[int, tuple[list, np.ndarray]] = {}
    for d in {len(r["v"]) for r in got}:
        own = [r for r in got if len(r["v"]) == d]
        by_size[d] = [r[query] for r in own], _unit(np.array([r["v"] for r in own], dtype=np.float64))
    shared = corpus.sparkSession.sparkContext.broadcast(by_size)
    kinds = {f.name: f.dataType.simpleString() for f in [*queries.schema, *corpus.schema]}

    def compare(batches):
        for b in batches:
            out: dict[str, list] = {query: [], key: [], "cosine": []}
            sizes = b["v"].map(lambda v: -1 if v is None else len(v))
            for d, (names, q) in shared.value.items():
                rows = b[sizes == d]
                if not len(rows):
                    continue
                c = _unit(np.stack(rows["v"]).astype(np.float64)) @ q.T
                good = np.ones_like(c, bool) if threshold is None else c >= threshold
                if k is not None and len(rows) > k:
                    good &= c >= np.partition(c, len(rows) - k, axis=0)[len(rows) - k]
                i, j = np.nonzero(good)
                ids = rows[key].to_numpy()
                out[query] += [names[x] for x in j]
                out[key] += ids[i].tolist()
                out["cosine"] += c[i, j].tolist()
            yield pd.DataFrame(out)

    rows = corpus.select(key, F.col(vector).cast("array<double>").alias("v"))
    found = rows.mapInPandas(compare, f"`{query}` {kinds[query]}, `{key}` {kinds[key]}, cosine double")
    if k is None:
        return found
    best = F.row_number().over(Window.partitionBy(query).orderBy(F.col("cosine").desc(), key))
    return found.withColumn("rank", best).filter(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def lookup_quality(queries: DataFrame, corpus: DataFrame, threshold: float = 0.85, n: int = 64, query: str = "query_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """quality() of a lookup in n bands of each family against the exact cosine, for any number of queries.

    Both sides have ``signatures``, of 64 digits each, by family. A pair is
    found if in some family it shares a band and reaches the threshold, as by
    find_similar; it is true if its cosine reaches it, as by exact_cosine.
    Bands of a few bits are shared by most pairs, so pairs are not joined by
    band: groups of queries and of rows are compared in cells, and only the
    counts of a cell leave it.
    """
    if not 1 <= n <= DIGITS:
        raise ValueError(f"1 to {DIGITS} bands")
    asked, rows = (d.filter(F.col(k).isNotNull() & F.col(vector).isNotNull()).select(k, F.col(vector).cast("array<double>").alias("v"), "signatures") for d, k in ((queries, query), (corpus, key)))
    cells = cross_cells(asked, rows, query, key, -(-max(1, asked.count()) // ROWS), groups_of(rows.count()))
    far = largest_distance(threshold)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        a, b = Signed.sides(table, n)
        if not len(a.owner) or not len(b.owner):
            return
        likely = [likely_first(x) for x in b.pieces]
        tp = fp = fn = 0
        for c0, c1 in cuts(b.owner, TILE[1]):
            for r0, r1 in cuts(a.owner, TILE[0]):
                true, found = (np.zeros((r1 - r0, c1 - c0), bool) for _ in range(2))
                for d in a.units.keys() & b.units.keys():
                    (i, x), (j, y) = a.unit(d, r0, r1), b.unit(d, c0, c1)
                    true[np.ix_(i, j)] = (y @ x.T).T >= threshold
                for f in range(len(a.packed)):
                    apart = (4 * DIGITS - a.signs(f, r0, r1) @ b.signs(f, c0, c1).T) / 2
                    i, j = np.nonzero((apart <= far) & ~found)
                    kept = share(a.pieces[f], b.pieces[f], i + r0, j + c0, likely[f])
                    found[i[kept], j[kept]] = True
                true, found = (_by_owner(x, a.owner[r0:r1], b.owner[c0:c1]) for x in (true, found))
                tp, fp, fn = tp + int((true & found).sum()), fp + int((found & ~true).sum()), fn + int((true & ~found).sum())
        yield pa.RecordBatch.from_pydict({"tp": [tp], "fp": [fp], "fn": [fn]})

    counts = cells.groupBy("cell").applyInArrow(compare, "tp long, fp long, fn long")
    return _rates(counts.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("tp", "fp", "fn")]))


#: Hex digits of a signature of 256 bits.
DIGITS = 64


@dataclass
class Signed:
    """One side of a cell, owners (places of keys) ascending: by family the signatures as bytes and their pieces (bands, rows), and by length the places and unit vectors of the rows."""

    owner: np.ndarray
    packed: list[np.ndarray]
    pieces: list[np.ndarray]
    units: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def sides(cls, rows: pa.Table, n: int) -> tuple[Signed, Signed]:
        """The left and the right of a cell; pieces are numbered for both at once."""
        owner = rows["key"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.argsort(owner, kind="stable")
        rows, owner = rows.take(pa.array(order)), owner[order]
        signatures = [x or [] for x in rows["signatures"].to_pylist()]
        packed, pieces = [], []
        for f in range(max(map(len, signatures))):
            own = [x[f] if f < len(x) else None for x in signatures]
            if any(x is not None and len(x) != DIGITS for x in own):
                raise ValueError(f"a signature has {DIGITS} digits")
            packed.append(np.frombuffer(bytes.fromhex("".join(x or "0" * DIGITS for x in own)), np.uint8).reshape(len(own), -1))
            held = np.where([x is not None for x in own], np.uint64(2**n - 1), np.uint64(0))
            pieces.append(piece_codes(packed[f], np.full(len(own), DIGITS // n), held, held))
        vectors = rows["v"].combine_chunks()
        sizes = vectors.value_lengths().to_numpy()

        def of(own: np.ndarray, missing: int) -> Signed:
            units = {}
            for d in set(sizes[own].tolist()):
                at = np.flatnonzero(sizes[own] == d)
                units[d] = at, _unit(vectors.take(pa.array(own[at])).flatten().to_numpy(zero_copy_only=False).reshape(len(at), d))
            return cls(owner[own], [x[own] for x in packed], [np.where(x[:, own] < 0, missing, x[:, own]) for x in pieces], units)

        right = rows["right"].to_numpy()
        return of(np.flatnonzero(~right), -1), of(np.flatnonzero(right), -2)

    def signs(self, f: int, start: int, stop: int) -> np.ndarray:
        return np.unpackbits(self.packed[f][start:stop], axis=1) * np.float32(2) - np.float32(1)

    def unit(self, d: int, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        at, x = self.units[d]
        i, j = np.searchsorted(at, (start, stop))
        return at[i:j] - start, x[i:j]


def _by_owner(x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Whether any row of an owner has it with any column of another."""
    for axis, owner in enumerate((rows, columns)):
        starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        if len(starts) < len(owner):
            x = np.logical_or.reduceat(x, starts, axis=axis)
    return x


def documents_of(candidates: DataFrame, documents: DataFrame, key: str = "vec_id") -> DataFrame:
    """The documents that some candidate names, each once."""
    return documents.join(candidates.select(key).distinct(), key, "left_semi")


def documents_in_bands(index: DataFrame, documents: DataFrame, bands: DataFrame, family: int = 0, key: str = "vec_id") -> DataFrame:
    """documents with n_bands, how many of the wanted bands (band, value) of a family they lie in; those in none are left out."""
    hit = index.filter(F.col("family") == family).join(bands.select("band", "value").distinct(), ["band", "value"])
    return documents.join(hit.groupBy(key).agg(F.count("*").alias("n_bands")), key)


def distinct_embeddings(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(sha256, key, copies): one row for each embedding that is equal to six places after it is set to unit length, with the least key."""
    digest = embedding_sha256(normalise(F.col(vector)))
    return embeddings.filter(F.col(vector).isNotNull()).groupBy(digest.alias("sha256")).agg(F.min(key).alias(key), F.count("*").alias("copies"))
