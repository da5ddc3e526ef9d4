"""Benchmark decontamination by greedy string tiling.

Every run of ``MIN_MATCH`` words is a seed, named by a rolling Karp-Rabin hash,
and documents are joined with benchmark items on shared seeds. An item may
leave so few words uncovered that a covered document has a seed in every
stretch of one word more; of the stretches the one whose seeds are rarest in
the documents is joined. A candidate is tiled: the longest run of words that
both sides have unmarked is found by Karp-Rabin hashes of a length that is
halved in on, marked, and so on until none of MIN_MATCH words is left. The
share of an item's words under tiles is its coverage; since tiles may come in
any order, a reordered passage is covered too.

Nothing of the benchmark or the documents goes to the driver but Bloom filters
of a fixed greatest size, which only spare rows from a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.filters import key_filter, maybe, passes
from nearfield.scratch import materialise

WORD = re.compile(r"[^\W_]+")
#: Words of a seed; an item of fewer words is not looked for, since any text may hold it.
MIN_MATCH = 5
MIN_COVERAGE = 0.8
_BASE = 0x100000001B3


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every run of k numbers, modulo 2**64."""
    n = len(ids) - k + 1
    h = np.zeros(max(0, n), dtype=np.uint64)
    for j in range(k if n > 0 else 0):
        h = h * np.uint64(_BASE) + ids[j : j + n]
    return h


class Codes(dict):
    """64-bit numbers of words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def seeds(ids: np.ndarray, k: int) -> np.ndarray:
    h = rolling(ids, k)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


# ---- tiles


class Runs:
    """Hashes of runs of any length, of which every word is open."""

    def __init__(self, ids: np.ndarray, base: np.ndarray, inverse: np.ndarray):
        self.ids, self.inverse = ids, inverse
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ids * base[: len(ids)], dtype=np.uint64)])
        self.open = ids != 0

    def at(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(starts, hashes) of the open runs of that length."""
        n = np.concatenate([[0], np.cumsum(self.open)])
        starts = np.flatnonzero(n[length:] - n[:-length] == length) if length <= len(self.ids) else np.empty(0, np.int64)
        return starts, (self.sums[starts + length] - self.sums[starts]) * self.inverse[starts]


def greedy_tiles(doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (start in document, start in item, length) of word numbers, 0 in doc for a word that the item lacks.

    The longest run that is open on both sides goes first, then the earliest
    in the document, then in the item; no word of either side twice. Memory
    is that of the two texts, however often a run repeats.
    """
    n = max(len(doc), len(item)) + 1
    mix = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
    spread = lambda x: np.where(x == 0, 0, (x ^ (x >> np.uint64(32)) ^ mix[0]) * mix[1] | np.uint64(1)).astype(np.uint64)
    powers = lambda x: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, x, np.uint64)]), dtype=np.uint64)
    base, inverse = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))
    d, t = Runs(spread(doc), base, inverse), Runs(spread(item), base, inverse)
    tiles: list[tuple[int, int, int]] = []
    longest = min(len(doc), len(item))

    def shared(length: int) -> np.ndarray:
        starts, h = d.at(length)
        return starts[np.isin(h, t.at(length)[1])]

    def first(length: int) -> tuple[int, int] | None:
        starts, h = t.at(length)
        for i in shared(length).tolist():
            own = (d.sums[i + length] - d.sums[i]) * inverse[i]
            for j in starts[h == own].tolist():
                if np.array_equal(doc[i : i + length], item[j : j + length]):
                    return i, j
        return None

    while longest >= k:
        low, high = k - 1, longest  # a length that both sides have, all below it they have too
        while low < high:
            middle = (low + high + 1) // 2
            if len(shared(middle)):
                low = middle
            else:
                high = middle - 1
        longest = low
        if longest < k:
            break
        found = first(longest)
        if found is None:  # equal hashes of different runs
            longest -= 1
            continue
        i, j = found
        tiles.append((i, j, longest))
        d.open[i : i + longest] = False
        t.open[j : j + longest] = False
    return sorted(tiles)


def tile(text: str, item: str, k: int, min_coverage: float) -> tuple[float, list[tuple[int, int, int, int, int]]] | None:
    """(coverage, tiles with code-point spans in the lower-cased text) where it reaches min_coverage."""
    found = [(m.group(), m.span()) for m in WORD.finditer(text.lower())]
    numbers: dict[str, int] = {}
    own = np.array([numbers.setdefault(w, len(numbers) + 1) for w in words_of(item)], dtype=np.uint64)
    doc = np.fromiter((numbers.get(w, 0) for w, _ in found), dtype=np.uint64, count=len(found))
    if len(own) < k or len(doc) < k:
        return None

    def under(ids: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Words in some run of k that the other side has too."""
        hit = np.isin(rolling(ids, k), rolling(other, k))
        edges = np.zeros(len(ids) + 1, dtype=np.int64)
        edges[: len(hit)] += hit
        edges[k : k + len(hit)] -= hit
        return np.cumsum(edges)[:-1] > 0

    if under(own, doc).sum() < min_coverage * len(own) - 1e-9:
        return None
    kept = np.flatnonzero(under(doc, own))
    gap = np.flatnonzero(np.diff(kept) > 1) + 1
    place = np.insert(kept, gap, -1)  # a closed word between runs
    tiles = greedy_tiles(np.where(place < 0, 0, doc[place]).astype(np.uint64), own, k)
    coverage = sum(n for _, _, n in tiles) / len(own)
    if coverage < min_coverage - 1e-9:
        return None
    out = [(int(place[i]), j, n) for i, j, n in tiles]
    return coverage, [(i, j, n, found[i][1][0], found[i + n - 1][1][1]) for i, j, n in out]


TILE = T.StructType([T.StructField("doc_word", T.IntegerType()), T.StructField("item_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


_TEXT = ["t1", "t2"]


def _text_key(text: str) -> list[Column]:
    """128 bits that name a text; null without one."""
    t = F.col(text)
    return [F.when(t.isNotNull(), F.xxhash64(t)), F.when(t.isNotNull(), F.xxhash64(F.lit("2"), t))]


def _item_seeds(k: int):
    def run(batches):
        codes = Codes()
        for b in batches:
            for item, text in zip(b["item"], b["text"], strict=True):
                ids = codes.of(text)
                h = seeds(ids, k).view(np.int64)
                yield pd.DataFrame({"item": item, "place": np.arange(len(h)), "seed": h, "n": len(ids)})

    return run


def _doc_seeds(k: int, shared):
    """Texts -> their distinct seeds that some item may have."""

    def run(batches):
        codes, (table, bits) = Codes(), shared.value
        for b in batches:
            t1, t2, found = [], [], []
            for x, y, text in zip(b["t1"], b["t2"], b["text"], strict=True):
                h = seeds(codes.of(text), k)
                h = np.unique(h[passes(table, bits, h)])
                if len(h):
                    found.append(h), t1.append(np.full(len(h), x)), t2.append(np.full(len(h), y))
            if found:
                yield pd.DataFrame({"t1": np.concatenate(t1), "t2": np.concatenate(t2), "seed": np.concatenate(found).view(np.int64)})

    return run


def rarest_stretch(known: np.ndarray, n_words: int, k: int, min_coverage: float) -> np.ndarray:
    """Places of the seeds of which a text that covers an item has one: known is how many documents have each seed.

    So many words may stay uncovered that of any stretch of one more at least
    one is under a tile, and a tile is made of seeds. The stretch with the
    fewest documents is taken; seeds that no document has are left out.
    """
    spare = n_words - int(np.ceil(min_coverage * n_words - 1e-9))
    width = min(spare + k, len(known))  # seeds that touch a stretch of spare + 1 words, fewer at the ends
    sums = np.concatenate([[0], np.cumsum(known)])
    at = int(np.argmin(sums[width:] - sums[:-width]))
    return at + np.flatnonzero(known[at : at + width])


def leaks(docs: DataFrame, benchmark: DataFrame, k: int, min_coverage: float, text: str, item_id: str, item_text: str) -> DataFrame:
    """(t1, t2, item_id, coverage, tiles) of each text, by its key, and each item that it covers."""
    spark = docs.sparkSession
    items = materialise(benchmark.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull()).withColumn("item", F.xxhash64("text")), "items")
    texts = items.select("item", "text").dropDuplicates(["item"])
    wanted = materialise(texts.mapInPandas(_item_seeds(k), "item long, place int, seed long, n int"), "item-seeds")
    shared = spark.sparkContext.broadcast(key_filter(wanted.select("seed").distinct(), "seed"))
    d = docs.select(*[c.alias(n) for c, n in zip(_text_key(text), _TEXT, strict=True)], F.col(text).alias("text")).filter(F.col("text").isNotNull())
    met = materialise(d.mapInPandas(_doc_seeds(k, shared), "t1 long, t2 long, seed long"), "doc-seeds")
    counts = materialise(met.groupBy("seed").agg(F.count("*").alias("docs")), "seed-counts")

    def choose(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("place")
        return g.iloc[rarest_stretch(g["docs"].to_numpy(), int(g["n"].iloc[0]), k, min_coverage)][["item", "seed"]]

    known = wanted.join(counts, "seed", "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    rare = materialise(known.groupBy("item").applyInPandas(choose, "item long, seed long").distinct(), "rare-seeds")
    pairs = materialise(met.join(rare, "seed").select(*_TEXT, "item").distinct(), "pairs")
    few = d.filter(maybe(F.col("t1"), spark, pairs.select("t1").distinct(), "t1")).join(pairs.select(*_TEXT).distinct(), _TEXT, "left_semi").dropDuplicates(_TEXT)
    both = pairs.join(few, _TEXT).join(texts.withColumnRenamed("text", "item_text"), "item")
    found = T.StructType([T.StructField("t1", T.LongType()), T.StructField("t2", T.LongType()), T.StructField("item", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.ArrayType(TILE))])

    def run(batches):
        for b in batches:
            rows = []
            for t1, t2, item, text_, item_text_ in zip(b["t1"], b["t2"], b["item"], b["text"], b["item_text"], strict=True):
                got = tile(text_, item_text_, k, min_coverage)
                if got:
                    rows.append((t1, t2, item, got[0], [dict(zip(TILE.names, x, strict=True)) for x in got[1]]))
            yield pd.DataFrame(rows, columns=found.names)

    covered = both.select(*_TEXT, "item", "text", "item_text").mapInPandas(run, found)
    return materialise(covered.join(items.select("item", "item_id"), "item").drop("item"), "leaks")


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and item that it covers: docs' columns but the text, and item_id, coverage, tiles.

    Words are runs of letters and digits, lower-cased. An item is covered by
    the words of its tiles, each at least k words long; items of fewer words
    are not looked for. Null and empty texts and items match nothing, and an
    empty table gives an empty result. Repeated documents and items match each
    for itself. Tiles carry the code-point span in the lower-cased text.
    Columns of docs named like the new ones are replaced.
    """
    found = leaks(docs, benchmark, k, min_coverage, text, item_id, item_text)
    keep = [c for c in docs.columns if c not in (text, "item_id", "coverage", "tiles")]
    keys = dict(zip(("__t1", "__t2"), _text_key(text), strict=True))
    d = docs.withColumns(keys).select(*keep, *keys)
    d = d.filter(maybe(F.col("__t1"), docs.sparkSession, found.select("t1").distinct(), "t1"))
    out = d.join(found, (F.col("__t1") == F.col("t1")) & (F.col("__t2") == F.col("t2")))
    return out.select(*keep, "item_id", "coverage", "tiles")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, k: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs that cover no item, with their columns as they are; those that can't be a leak by the filter are not shuffled."""
    found = leaks(docs, benchmark, k, min_coverage, text, item_id, item_text)
    keys = materialise(found.select("t1", "t2").distinct(), "leaked")
    d = docs.withColumns(dict(zip(("__t1", "__t2"), _text_key(text), strict=True)))
    d = d.withColumn("__maybe", maybe(F.col("__t1"), docs.sparkSession, keys.select("t1").distinct(), "t1"))
    checked = d.filter("__maybe").join(keys, (F.col("__t1") == F.col("t1")) & (F.col("__t2") == F.col("t2")), "left_anti")
    return d.filter("not __maybe").unionByName(checked).select(*docs.columns)


def op9_string_tiling(spark, sf_dir: str) -> DataFrame:
    """(doc_id, item_id) pairs with the share of the item that the document holds; nulls, ties and repeated rows as in ``find_leaks``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "item_id", F.round("coverage", 6).alias("coverage"), F.size("tiles").alias("n_tiles"))
