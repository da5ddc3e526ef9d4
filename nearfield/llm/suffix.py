"""Repeated byte strings by a logarithmic family of suffix arrays.

Two equal strings of ``length`` bytes have the same minimiser (the ``SEED``
bytes of least hash in them) at the same place, so strings are dealt out by
minimiser and compared only there. A piece is a run of strings that share a
minimiser occurrence; pieces that occur twice as a whole are settled by a
count, and one of each is left. A minimiser with over ``GROUP_LIMIT`` different
pieces is split: the places that the minimiser can have in a string are cut in
four ranges, and a piece goes on in each range, under the bytes that all its
strings there have in common. So a passage that half of the corpus holds never
meets in one task. What is left meets in index families: each batch gets a
suffix array, is merge-scanned against the levels, and joins them; levels of a
size are merged. Texts lie in compressed blocks; what is found goes to the
block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.scratch import discard, materialise

LENGTH = 200
SEED = 64
#: Strings in a batch; the suffix array of one takes about 250 bytes for each.
BATCH = 16_384
#: Different pieces that meet in one family; a larger group is split by further bytes.
GROUP_LIMIT = 1024
#: Ranges of minimiser places that a group is split in.
SPLIT = 4
#: Bytes of text and documents after which a block is closed; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 50_000
#: Pieces that are handed on at once.
ROWS = 50_000


def _doubling(x: np.ndarray, width: int, join) -> np.ndarray:
    """join over every window of ``width`` entries, for a join that may count an entry twice."""
    out, have = x, 1
    while have * 2 <= width:
        out = join(out[: len(out) - have], out[have:])
        have *= 2
    return join(out[: len(x) - width + 1], out[width - have : width - have + len(x) - width + 1]) if have < width else out


def chunks(data: bytes, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser hash, first start, number of starts, place of the minimiser) of the runs of strings that share a minimiser occurrence."""
    empty = np.empty(0, dtype=np.int64)
    if len(data) < length:
        return empty, empty, empty, empty
    h, base = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1), 0x100000001B3
    have = 1
    while have < seed:  # seed is a power of two
        h = h[: len(h) - have] * np.uint64(pow(base, have, 1 << 64)) + h[have:]
        have *= 2
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    width = length - seed + 1
    least = _doubling(h, width, np.minimum)
    # the first place of the least hash: sliding minimum of (hash, place) by ranks of equal hashes
    new = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
    starts, anchors, places = [], [], []
    for a, z in zip(new, np.r_[new[1:], len(least)], strict=True):
        at = a
        while at < z:  # an equal hash later takes over when the first has left the window
            place = at + int(np.argmax(h[at : at + width] == least[at]))
            starts.append(at), anchors.append(least[at]), places.append(place)
            at = min(z, place + 1)
    starts = np.array(starts, dtype=np.int64)
    return np.array(anchors, dtype=np.uint64).view(np.int64), starts, np.diff(np.r_[starts, len(least)]), np.array(places, dtype=np.int64)


class Family:
    """Suffix arrays of geometric sizes; the strings that were seen twice are marked.

    A level is (strings in order, piece and offset of each, marks). Equal
    strings are passed once for a whole run, so a batch costs its own size
    times a logarithm, however often a string is there.
    """

    def __init__(self, length: int):
        self.length, self.levels = length, []

    def add(self, pieces: list[tuple[int, bytes]]) -> None:
        """pieces: (number, bytes); the strings are all those of ``length`` bytes."""
        strings, numbers, offsets = [], [], []
        for number, data in pieces:
            n = len(data) - self.length + 1
            strings.append(np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), self.length))
            numbers.append(np.full(n, number)), offsets.append(np.arange(n))
        # of one width all, so a padding zero byte and a real one can't be confused
        x = np.ascontiguousarray(np.concatenate(strings)).view(f"S{self.length}").ravel()
        order = np.argsort(x, kind="stable")
        x, who = x[order], np.stack([np.concatenate(numbers), np.concatenate(offsets)])[:, order]
        same = x[1:] == x[:-1]
        marks = np.r_[False, same] | np.r_[same, False]
        for known, _, seen in self.levels:
            lo, hi = np.searchsorted(known, x, "left"), np.searchsorted(known, x, "right")
            found = hi > lo
            marks |= found
            edges = np.bincount(lo[found], minlength=len(known) + 1) - np.bincount(hi[found], minlength=len(known) + 1)
            seen |= np.cumsum(edges)[:-1] > 0
        self.levels.append((x, who, marks))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            (x1, w1, m1), (x2, w2, m2) = self.levels[-2:]
            x = np.concatenate([x1, x2])
            order = np.argsort(x, kind="stable")  # two sorted runs: one merge
            self.levels[-2:] = [(x[order], np.concatenate([w1, w2], axis=1)[:, order], np.concatenate([m1, m2])[order])]

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(piece, first offset, number) of the runs of strings seen twice."""
        who = np.concatenate([w[:, m] for _, w, m in self.levels], axis=1) if self.levels else np.empty((2, 0), np.int64)
        number, offset = who[:, np.lexsort((who[1], who[0]))]
        new = np.flatnonzero(np.r_[True, (np.diff(number) != 0) | (np.diff(offset) != 1)]) if len(number) else np.empty(0, np.int64)
        return number[new], offset[new], np.diff(np.r_[new, len(number)])


def text_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, ids, lengths, body): ids and bytes of documents; null texts are empty."""
    id_type = docs.schema[doc_id].dataType.simpleString()

    def pack(batches):
        block, ids, texts, size = TaskContext.get().partitionId() << 33, [], [], 0

        def row(kind):
            columns = {"block": pa.array([block], pa.int64()), "ids": pa.array([ids], pa.list_(kind)), "lengths": pa.array([[*map(len, texts)]], pa.list_(pa.int32())), "body": pa.array([zstandard.compress(b"".join(texts))], pa.binary())}
            return pa.RecordBatch.from_pydict(columns)

        for b in batches:
            kind = b.column(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i), texts.append(t)
                size += len(t)
                if size >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield row(kind)
                    block, ids, texts, size = block + 1, [], [], 0
        if ids:
            yield row(kind)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    return materialise(rows.mapInArrow(pack, f"block long, ids array<{id_type}>, lengths array<int>, body binary"), "texts")


def _texts(lengths, body: bytes) -> list[bytes]:
    data, ends = zstandard.decompress(body), np.cumsum(lengths, dtype=np.int64)
    return [data[z - n : z] for z, n in zip(ends.tolist(), lengths, strict=True)]


PIECE = "block long, i int, start int, n int, place int"


def _hash(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) - (1 << 63)


def _cut(length: int):
    """Blocks -> a row for each piece of their texts: grp (the minimiser), piece (hash of its bytes), and where it is."""

    def run(batches):
        frame = lambda rows: pd.DataFrame(rows, columns=["grp", "piece", "lo", "hi", "block", "i", "start", "n", "place"])
        for b in batches:
            for block, lengths, body in zip(b["block"], b["lengths"], b["body"], strict=True):
                rows = []
                for i, data in enumerate(_texts(lengths, body)):
                    for a, s, n, p in zip(*(x.tolist() for x in chunks(data, length)), strict=True):
                        rows.append((a, _hash(data[s : s + n + length - 1]), 0, length - SEED, block, i, s, n, p))
                    if len(rows) >= ROWS:
                        yield frame(rows)
                        rows = []
                yield frame(rows)

    return run


def ranges(lo: int, hi: int) -> list[tuple[int, int]]:
    """lo to hi, both included, in SPLIT ranges of nearly equal size, or as many as there are places."""
    k, n = min(SPLIT, hi - lo + 1), hi - lo + 1
    return [(lo + n * j // k, lo + n * (j + 1) // k - 1) for j in range(k)]


def _split(length: int):
    """Pieces whose group is too large, with their bytes -> their parts by range of the minimiser's place, without.

    The strings of a part whose minimiser has a place from lo to hi have in common the lo bytes before the
    minimiser, the minimiser, and the bytes after it up to the end of a string that has it at hi: these name the
    part's group. Two equal strings fall in one range, so in one group.
    """

    def run(batches):
        for b in batches:
            out = []
            for grp, lo, hi, block, i, start, n, place, data in b.itertuples(index=False):
                at = place - start
                for low, high in ranges(lo, hi):
                    first, last = max(0, at - high), min(n - 1, at - low)
                    if first > last:
                        continue
                    seed = (grp ^ low * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)
                    group = xxhash.xxh3_64_intdigest(data[at - low : at - high + length], seed=seed) - (1 << 63)
                    whole = xxhash.xxh3_64_intdigest(data[first : last + length], seed=at - first) - (1 << 63)
                    out.append((group, whole, low, high, block, i, start + first, last - first + 1, place))
            yield pd.DataFrame(out, columns=["grp", "piece", "lo", "hi", "block", "i", "start", "n", "place"])

    return run


_ROW_DDL = f"grp long, piece long, lo short, hi short, {PIECE}"


def _settle(pieces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pieces -> (those that occur twice as a whole, one of each piece of the groups that have different ones, with ``many``, their number).

    Counts are added up before the shuffle, and lie in the shared folder before they are joined, so a join on a hot
    key is one that adaptive execution splits.
    """
    where = F.struct("lo", "hi", "block", "i", "start", "n", "place")
    counts = materialise(pieces.groupBy("grp", "piece").agg(F.count("*").alias("times"), F.min(where).alias("at")), "piece-counts")
    whole = pieces.join(counts.filter("times > 1").select("grp", "piece"), ["grp", "piece"], "left_semi").select("block", "i", "start", "n")
    mixed = materialise(counts.groupBy("grp").agg(F.count("*").alias("many")).filter("many > 1"), "mixed")
    return whole, counts.join(mixed, "grp").select("grp", "many", "at.*")


def repeated_starts(blocks: DataFrame, length: int = LENGTH, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Blocks of texts -> (block, i: place of the text in it, start, n): runs of starts of strings that occur twice."""
    found = materialise(blocks.select("block", "lengths", "body").mapInPandas(_cut(length), _ROW_DDL), "chunks")
    twice = materialise(found.groupBy("grp").count().filter("count > 1").select("grp"), "minimisers")
    pieces = materialise(found.join(twice, "grp", "left_semi"), "met")
    discard(found, twice)
    whole, rest = _settle(pieces)

    def fetch(block: pa.Table, parts: pa.Table) -> pa.Table:
        texts = _texts(block.column("lengths")[0].as_py(), block.column("body")[0].as_py()) if len(parts) else []
        data = [texts[i][s : s + n + length - 1] for i, s, n in zip(*(parts.column(c).to_pylist() for c in ("i", "start", "n")), strict=True)]
        return parts.append_column("bytes", pa.array(data, pa.binary()))

    with_bytes = f"grp long, many long, lo short, hi short, {PIECE}, bytes binary"
    taken = materialise(blocks.groupBy("block").cogroup(rest.groupBy("block")).applyInArrow(fetch, with_bytes), "taken")
    hot = taken.filter(F.col("many") > group_limit)
    origin = hot.select("block", "i", "place", F.col("start").alias("from"), F.col("bytes").alias("all"))
    settled, few = [whole], [taken.filter(F.col("many") <= group_limit)]
    while not hot.isEmpty():  # four rounds at most: 137 places in ranges of 35, 9, 3 and 1; pieces of one string are never different in a group
        columns = ["grp", "lo", "hi", "block", "i", "start", "n", "place", "bytes"]
        parts = materialise(hot.select(*columns).mapInPandas(_split(length), _ROW_DDL), "parts")
        whole, rest = _settle(parts)
        rest = rest.join(origin, ["block", "i", "place"])  # a minimiser's place is in one piece
        rest = rest.withColumn("bytes", F.col("all").substr(F.col("start") - F.col("from") + 1, F.col("n") + length - 1))
        rest = materialise(rest.select(*taken.columns), "split")
        settled.append(whole), few.append(rest.filter(F.col("many") <= group_limit))
        hot = rest.filter(F.col("many") > group_limit)
    wanted = few[0]
    for x in few[1:]:
        wanted = wanted.unionByName(x)
    dealt = wanted.select("grp", "block", "i", "start", "bytes").repartition("grp").sortWithinPartitions("grp")

    def compare(batches):
        """Whole groups share a batch; a group that is larger has a family of several levels."""
        family, known, waiting, strings, group = Family(length), [], [], 0, None

        def flush():
            nonlocal waiting, strings
            if waiting:
                family.add(waiting)
            waiting, strings = [], 0

        def close():
            nonlocal family, known
            number, offset, n = family.hits()
            rows = [(*known[k][:2], known[k][2] + o, m) for k, o, m in zip(number.tolist(), offset.tolist(), n.tolist(), strict=True)]
            family, known = Family(length), []
            return pd.DataFrame(rows, columns=["block", "i", "start", "n"])

        for b in batches:
            for g, block, i, start, data in b.itertuples(index=False):
                if g != group and strings >= BATCH or g != group and family.levels:
                    flush()
                    yield close()
                group = g
                waiting.append((len(known), data))
                known.append((block, i, start))
                strings += len(data) - length + 1
                if strings >= 2 * BATCH:
                    flush()
        flush()
        yield close()

    starts = dealt.mapInPandas(compare, "block long, i int, start int, n int")
    for x in settled:
        starts = starts.unionByName(x)
    return starts


def remove_repeats(docs: DataFrame, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans and kept (binary) of each document.

    Every byte under a string of ``length`` bytes that starts anywhere else
    too is removed, judged on the input. Null texts are empty; texts shorter
    than length keep all. Equal rows are documents of their own, so those of
    length bytes or more lose everything; ids may repeat or be null. An empty
    table gives an empty result. Other columns are left out.
    """
    blocks = text_blocks(docs, doc_id, text)
    starts = repeated_starts(blocks, length)

    def apply(block: pa.Table, runs: pa.Table) -> pa.Table:
        texts = _texts(block.column("lengths")[0].as_py(), block.column("body")[0].as_py())
        spans: list[list[list[int]]] = [[] for _ in texts]
        for i, first, n in sorted(zip(*(runs.column(c).to_pylist() for c in ("i", "start", "n")), strict=True)):
            merged, end = spans[i], first + n + length - 1
            if merged and first <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([first, end])
        kept = []
        for data, merged in zip(texts, spans, strict=True):
            edges = [0, *(x for m in merged for x in m), len(data)]
            kept.append(b"".join(data[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        named = [[{"start": a, "end": z} for a, z in m] for m in spans]
        return pa.table({"doc_id": block.column("ids").combine_chunks().flatten(), "n_bytes": pa.array(map(len, texts), pa.int64()), "spans": pa.array(named, kind), "kept": pa.array(kept, pa.binary())})

    id_type = docs.schema[doc_id].dataType.simpleString()
    out = blocks.groupBy("block").cogroup(starts.groupBy("block")).applyInArrow(apply, f"doc_id {id_type}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "spans", "kept")


def op5_index_family(spark, sf_dir: str) -> DataFrame:
    """All documents; nulls, ties and repeated rows as in ``remove_repeats``."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
