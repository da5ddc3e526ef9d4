"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints that agree on a bucket key are laid out as bit planes, 64
documents to a machine word, and compared a plane at a time: one XOR brings
64 differences, a carry-save adder counts them in vertical counters, and a
block of 64 is abandoned once every document in it is over the radius.

Buckets for a small radius come from the pigeonhole rule: the bits are cut in
radius + k groups, two fingerprints within the radius agree on k of them, and
every k groups make a table, so no link is lost; k grows with the logarithm of
the number of fingerprints. The radius at which shingle sets are 0.8 similar
leaves that rule no power. There a bucket is named by two least hashes of the
shingle set, each shared with a chance of the similarity, and what the bits
bring together is compared exactly.

Equal fingerprints (equal shingle sets) are one node throughout, a bucket
yields a spanning forest of its links and not the pairs, a bucket of over
``bucket_limit`` nodes is split again, and what can't be split is dealt in
parts, of which each two meet in a task.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.components import connected_components
from nearfield.llm.filters import maybe
from nearfield.scratch import discard, materialise

BUCKET_LIMIT = 16_384
#: Times that a hot bucket is split before it is dealt in parts.
LEVELS = 3
#: (row, block) pairs that are compared at a time.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Spec:
    """Shingles of so many words; fingerprints of so many 64-bit lanes; links at radius or fewer differing bits.

    tables 0: pigeonhole, exact. Else so many tables of two least hashes each.
    jaccard over 0: fingerprints are of the distinct shingles and only find
    candidates; a link needs that similarity of the shingle sets themselves.
    """

    shingle: int = 4
    lanes: int = 1
    radius: int = 4
    tables: int = 0
    seed: int = 42
    jaccard: float = 0.0


#: Five-word shingles at a Jaccard similarity of 0.8 or more. There two sets share a table with a chance of
#: 1 - (1 - 0.8 ** 2) ** 8 = 0.9997, and the fingerprints differ in 39 of 256 bits with a deviation of 6.
NEAR_COPIES = Spec(shingle=5, lanes=4, radius=64, tables=8, jaccard=0.8)
#: Least hashes that a hot bucket is split by: at each level a row goes on under so many further ones.
SPLITS = 4
#: Shingle sets that are compared at a time; a larger group of candidates is compared bucket by bucket.
COMPARED = 4096

_MIX = (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def _lanes(h: np.ndarray, lanes: int) -> list[np.ndarray]:
    """The hash itself, then remixed copies (the finaliser of SplitMix64)."""
    out = [h]
    for k in range(1, lanes):
        z = h ^ np.uint64(_MIX[k])
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return out


def shingles(text: bytes | None, spec: Spec) -> np.ndarray:
    """Hashes of a text's shingles in order; a text of fewer words is one shingle, one without words has none."""
    w = text.lower().split() if text else []  # of bytes: A-Z alone, and the six ASCII spaces
    if not w:
        return np.empty(0, dtype=np.uint64)
    joined, k = b" ".join(w), spec.shingle
    if len(w) <= k:
        return np.array([xxhash.xxh64_intdigest(joined, spec.seed)], dtype=np.uint64)
    ends = list(accumulate(map(len, w)))
    starts = [0, *(e + i + 1 for i, e in enumerate(ends))]
    stops = [e + i for i, e in enumerate(ends)]
    return np.array([xxhash.xxh64_intdigest(joined[a:b], spec.seed) for a, b in zip(starts, stops[k - 1 :], strict=False)], dtype=np.uint64)


def fingerprint(text: bytes | None, spec: Spec) -> list[int]:
    """Lanes of one text's fingerprint; a bit is set if over half of the shingle hashes have it."""
    h = shingles(text, spec)
    return _majority(np.unique(h) if spec.jaccard else h, spec)


def _majority(h: np.ndarray, spec: Spec) -> list[int]:
    n, out = len(h), []
    if not n:
        return [0] * spec.lanes
    for lane in _lanes(h, spec.lanes):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, n, 1 << 16):
            part = lane[at : at + (1 << 16)]
            ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]))
    return out


def fingerprints(text: Column, spec: Spec) -> Column:
    """array<bigint> with the lanes of each text's fingerprint."""

    @F.pandas_udf("array<bigint>")
    def make(texts: pd.Series) -> pd.Series:
        return pd.Series([np.array(fingerprint(t, spec), dtype=np.uint64).view(np.int64) for t in texts])

    return make(text.cast("binary"))


def least_hashes(h: np.ndarray, spec: Spec) -> np.ndarray:
    """The least hash of a set under each of the spec's orders: two for a table, then SPLITS for a level."""
    if not len(h):
        return np.zeros(len(_orders(spec)), dtype=np.uint64)
    return np.array([((h ^ (h >> np.uint64(32))) * m).min() for m in _orders(spec)], dtype=np.uint64)


def _orders(spec: Spec) -> np.ndarray:
    rng = random.Random(spec.seed)
    return np.array([rng.getrandbits(64) | 1 for _ in range(2 * spec.tables + SPLITS * LEVELS)], dtype=np.uint64)


def sketches(text: Column, spec: Spec) -> Column:
    """struct of fp, the lanes, digest, a hash of the set of shingles (0 without words), and least, its least hashes."""

    @F.pandas_udf("fp array<bigint>, digest bigint, least array<bigint>")
    def make(texts: pd.Series) -> pd.DataFrame:
        sets = [np.unique(shingles(t, spec)) for t in texts]
        fps = [np.array(_majority(h, spec), dtype=np.uint64).view(np.int64) for h in sets]
        digests = np.array([xxhash.xxh64_intdigest(h.tobytes()) if len(h) else 0 for h in sets], dtype=np.uint64).view(np.int64)
        return pd.DataFrame({"fp": fps, "digest": digests, "least": [least_hashes(h, spec).view(np.int64) for h in sets]})

    return make(text.cast("binary"))


# ---- buckets


def split_bits(mask: int, n: int) -> list[int]:
    """The set bits of mask in n runs of nearly equal number."""
    bits = [b for b in range(64) if mask >> b & 1]
    cuts = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in bits[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)]


def masks(radius: int, nodes: int) -> list[int]:
    """A mask for each table: of radius + k bit groups every k. k is 1, and one more as long as a bucket would hold 1,024 of so many nodes."""
    for k in range(1, 5):
        groups = split_bits((1 << 64) - 1, radius + k)
        tables = [sum(g) for g in combinations(groups, k)]
        if nodes >> min(m.bit_count() for m in tables) < 1024:
            break
    return tables


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _picked(table: list[int]) -> Column:
    return F.array(*[F.lit(_signed(x)) for x in table])


def _bit_rows(nodes: DataFrame, used: list[int]) -> DataFrame:
    """Each node (name, fp) once for each mask: with key, and the number of the mask as ``path``."""
    each = F.transform(_picked(used), lambda m, t: F.struct(F.xxhash64(t, F.col("fp")[0].bitwiseAND(m)).alias("key"), t.alias("path")))
    return nodes.select("name", "fp", F.explode(each).alias("k")).select("name", "fp", "k.key", "k.path")


def _bit_split(hot: DataFrame, radius: int, used: list[int]) -> tuple[DataFrame, list[int]]:
    """Rows of hot buckets once more for each group of the bits that their path leaves free."""
    subs = [mask | s for mask in used for s in split_bits(~mask & ((1 << 64) - 1), radius + 1)]
    n = radius + 1
    each = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: F.struct(F.xxhash64("key", j, F.col("fp")[0].bitwiseAND(F.get(_picked(subs), F.col("path") * n + j))).alias("key"), (F.col("path") * n + j).alias("path")))
    return hot.select("name", "fp", F.explode(each).alias("k")).select("name", "fp", "k.key", "k.path"), subs


def _hash_rows(nodes: DataFrame, spec: Spec) -> DataFrame:
    """Each node (name, fp, least) once for each table, with its key."""
    each = F.transform(F.sequence(F.lit(0), F.lit(spec.tables - 1)), lambda t: F.xxhash64(t, F.get("least", 2 * t), F.get("least", 2 * t + 1)))
    return nodes.select("name", "fp", F.explode(each).alias("key"))


def _hash_split(hot: DataFrame, nodes: DataFrame, spec: Spec, level: int) -> DataFrame:
    """Rows of hot buckets once more for each of SPLITS further least hashes."""
    each = F.transform(F.sequence(F.lit(0), F.lit(SPLITS - 1)), lambda j: F.xxhash64("key", j, F.get("least", 2 * spec.tables + level * SPLITS + j)))
    return hot.join(nodes.select("name", "least"), "name").select("name", "fp", F.explode(each).alias("key"))


def buckets(nodes: DataFrame, spec: Spec, bucket_limit: int) -> DataFrame:
    """(key, name, fp): nodes (name, fp, and least where the spec has tables) by bucket; those alone in theirs may be left out."""
    used = [] if spec.tables else masks(spec.radius, nodes.count())
    rows = _hash_rows(nodes, spec) if spec.tables else _bit_rows(nodes, used)
    done = None
    for level in range(LEVELS + 1):
        sizes = materialise(rows.groupBy("key").count().filter("count > 1"), "bucket-sizes")
        hot = sizes.filter(F.col("count") > bucket_limit)
        cold = rows.join(sizes.filter(F.col("count") <= bucket_limit).select("key"), "key", "left_semi").select("key", "name", "fp")
        done = cold if done is None else done.unionByName(cold)
        if hot.isEmpty():
            return done
        rest = rows.join(hot, "key")
        if level < LEVELS:
            rest = rest.drop("count")
            if spec.tables:
                rows = _hash_split(rest, nodes, spec, level)
            else:
                rows, used = _bit_split(rest, spec.radius, used)
    # what no key parts any more: each two parts of a bucket meet
    deal = F.ceil(F.col("count") / bucket_limit).cast("int")
    rest = rest.select("key", "name", "fp", deal.alias("deal"), F.pmod(F.xxhash64("name"), deal).cast("int").alias("i"))
    rest = rest.withColumn("j", F.explode(F.filter(F.sequence(F.lit(0), F.col("deal") - 1), lambda j: j != F.col("i"))))
    return done.unionByName(rest.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("key"), "name", "fp"))


# ---- bit-sliced comparison


def planes_of(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Bit planes (bits, blocks) of blocks of up to 64 fingerprints (rows, lanes) from the given row on."""
    n, lanes = len(starts), fps.shape[1]
    out = np.empty((64 * lanes, n), dtype=np.uint64)
    for at in range(0, n, 1024):
        take = np.minimum(starts[at : at + 1024, None] + np.arange(64), len(fps) - 1)
        bits = np.unpackbits(np.ascontiguousarray(fps[take]).view(np.uint8).reshape(*take.shape, 8 * lanes), axis=2, bitorder="little")
        out[:, at : at + 1024] = np.packbits(np.ascontiguousarray(bits.transpose(2, 0, 1)), axis=2, bitorder="little").view(np.uint64)[:, :, 0]
    return out


def _csa(a, b, c):
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


def _over(counters: list, radius: int) -> np.ndarray:
    """Lanes whose vertical counter, lowest bit first, exceeds the radius."""
    more = np.zeros_like(counters[0])
    same = ~more
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            same = same & counters[k]
        else:
            more = more | (same & counters[k])
            same = same & ~counters[k]
    return more


def within(planes: np.ndarray, rows: np.ndarray, fps: np.ndarray, blocks: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (row, block) pairs those with a document of the block at ``radius`` or fewer bits: rows, blocks, masks of such documents.

    lanes: the documents of each block that a row is compared with.
    """
    n_bits = planes.shape[0]
    levels = max(4, (n_bits).bit_length())
    counters = [np.zeros(len(rows), dtype=np.uint64) for _ in range(levels)]
    one = np.uint64(1)
    for at in range(0, n_bits, 8):
        own = fps[rows, at // 64]
        x = [planes[p][blocks] ^ (np.uint64(0) - ((own >> np.uint64(p % 64)) & one)) for p in range(at, at + 8)]
        s, t1 = _csa(counters[0], x[0], x[1])
        s, t2 = _csa(s, x[2], x[3])
        twos, f1 = _csa(counters[1], t1, t2)
        s, t1 = _csa(s, x[4], x[5])
        s, t2 = _csa(s, x[6], x[7])
        twos, f2 = _csa(twos, t1, t2)
        fours, carry = _csa(counters[2], f1, f2)
        counters[:3] = [s, twos, fours]
        for k in range(3, levels):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        if at % 16 == 8 or at + 8 >= n_bits:
            lanes = lanes & ~_over(counters, radius)
            alive = np.flatnonzero(lanes)
            if len(alive) < len(rows):  # the rest of the blocks is abandoned
                rows, blocks, lanes = rows[alive], blocks[alive], lanes[alive]
                counters = [c[alive] for c in counters]
        if not len(rows):
            break
    return rows, blocks, lanes


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """parent with the pairs (a, b) united; on return every row points at the smallest of its class."""
    while True:
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return parent
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def forest(fps: np.ndarray, bucket: np.ndarray, radius: int) -> np.ndarray:
    """parent of each row: the first row of its class among the links inside its bucket. Rows are sorted by bucket."""
    n = len(fps)
    parent = np.arange(n)
    if n < 2:
        return parent
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    size = np.diff(np.r_[first, n])
    first, size = first[size > 1], size[size > 1]
    if not len(first):
        return parent
    n_blocks = (size + 63) // 64
    base = np.cumsum(n_blocks) - n_blocks  # number of each bucket's first block
    within_bucket = np.arange(n_blocks.sum()) - np.repeat(base, n_blocks)
    starts = np.repeat(first, n_blocks) + 64 * within_bucket
    filled = np.minimum(64, np.repeat(first + size, n_blocks) - starts)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    block_lanes = full >> (64 - filled).astype(np.uint64)
    planes = planes_of(fps, starts, filled)

    # every row against its own block from the next document on, and against the later blocks of its bucket
    row_bucket = np.repeat(np.arange(len(first)), size)
    row_in = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    rows = first[row_bucket] + row_in
    todo = n_blocks[row_bucket] - row_in // 64
    ends = np.cumsum(todo)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        count = todo[at:to]
        r = np.repeat(np.arange(at, to), count)
        step = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        b = base[row_bucket[r]] + row_in[r] // 64 + step
        lane = (row_in[r] % 64).astype(np.uint64)
        later = np.where(step == 0, (full << lane) & ~(np.uint64(1) << lane), full) & block_lanes[b]
        some = later != 0
        got_rows, got_blocks, masks = within(planes, rows[r[some]], fps, b[some], later[some], radius)
        if len(got_rows):
            hit, lane = np.nonzero(np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            parent = _unite(parent, got_rows[hit], starts[got_blocks[hit]] + lane)
        at = to
    return parent


def _links(radius: int, lanes: int):
    """Arrow batches (key, name, fp) sorted by key -> links (key, a, b) between names; a bucket may run over batches."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def emit(keys: np.ndarray, names: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        parent = forest(fps, keys, radius)
        child = np.flatnonzero(parent != np.arange(len(parent)))
        if len(child):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (keys[child], names[child], names[parent[child]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # batches are put together once a bucket ends, so a long bucket is copied once
        for batch in batches:
            if not batch.num_rows:
                continue
            fps = batch.column(2).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, lanes)
            keys, names = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if held and (cut or keys[0] != held[-1][0][-1]):
                yield from emit(*(np.concatenate(c) for c in zip(*held, (keys[:cut], names[:cut], fps[:cut]), strict=True)))
                held = []
            elif cut:
                yield from emit(keys[:cut], names[:cut], fps[:cut])
            held.append((keys[cut:], names[cut:], fps[cut:]))
        if held:
            yield from emit(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _hits(nodes: DataFrame, spec: Spec, bucket_limit: int) -> DataFrame:
    """(key, a, b): in each bucket a spanning forest of the links within the radius."""
    keyed = buckets(nodes, spec, bucket_limit).repartition("key").sortWithinPartitions("key")
    return keyed.select("key", "name", "fp").mapInArrow(_links(spec.radius, spec.lanes), "key long, a long, b long")


def _rooted(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes (name and more) with root, the same for nodes that links connect."""
    roots = connected_components(links)
    return nodes.join(roots.withColumnRenamed("node", "name"), "name", "left").withColumn("root", F.coalesce("root", "name"))


def _with_class(marked: DataFrame, rooted: DataFrame, key: str) -> DataFrame:
    """marked with component_id and root, by rooted (key, least, root).

    The least id of a class is added up before the shuffle and written before
    it is joined, so the members of a large class may be split over tasks.
    """
    rooted = materialise(rooted, "rooted")
    least = materialise(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    classes = materialise(rooted.select(key, "root").join(least, "root"), "classes")
    return marked.join(classes, key)


def near_duplicates(docs: DataFrame, spec: Spec = Spec(), bucket_limit: int = BUCKET_LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, thash (XXH64 of the text, 0 if null), fp (lanes), component_id, root.

    component_id is the smallest id reachable over links; where no document
    of a class has an id it is null, and where ids repeat two classes may
    share it. root is of one class alone. Null and blank texts have the zero
    fingerprint and link like any other. Equal rows stay. An empty table
    gives an empty result. Further columns of docs are not carried.
    """
    thash = F.coalesce(F.when(F.col(text).isNotNull(), F.xxhash64(text)), F.lit(0))
    if spec.jaccard:
        made = docs.select(F.col(doc_id).alias("doc_id"), thash.alias("thash"), sketches(F.col(text), spec).alias("f"))
        marked = materialise(made.select("doc_id", "thash", "f.fp", "f.digest", "f.least"), "sketches")
        return cluster_sets(marked, docs.select(thash.alias("thash"), F.col(text).alias("text")), spec, bucket_limit)
    marked = materialise(docs.select(F.col(doc_id).alias("doc_id"), thash.alias("thash"), fingerprints(F.col(text), spec).alias("fp")), "fingerprints")
    return cluster(marked, spec, bucket_limit)


def cluster(marked: DataFrame, spec: Spec, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """marked (doc_id, fp of one lane and more) with component_id, and root: the name of the class, also where it has no id."""
    marked = marked.withColumn("name", F.col("fp")[0])
    nodes = materialise(marked.groupBy("name").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("least")), "nodes")
    links = _hits(nodes, spec, bucket_limit).select("a", "b")
    return _with_class(marked, _rooted(nodes.select("name", "least"), links), "name").drop("name")


def cluster_sets(marked: DataFrame, texts: DataFrame, spec: Spec, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """marked (doc_id, thash, fp, digest, least) with component_id and root, by links of ``spec.jaccard`` or more.

    A node is a distinct set of shingles. Fingerprints within the radius that
    share a bucket make groups of candidates, and inside a group every pair of
    sets that is not yet in one class is compared exactly. A group is all that
    such links connect or, where that is over COMPARED sets, the classes of
    each bucket. One text (thash, text) of each candidate is read.
    """
    marked = marked.withColumnRenamed("least", "hashes")
    nodes = materialise(marked.groupBy(F.col("digest").alias("name")).agg(F.min("fp").alias("fp"), F.min("hashes").alias("least"), F.min("thash").alias("thash"), F.min("doc_id").alias("first")), "nodes")
    hits = materialise(_hits(nodes, spec, bucket_limit), "hits")
    wide = connected_components(hits.select("a", "b")).select(F.col("node").alias("name"), F.col("root").alias("g"))
    wide = materialise(wide, "wide")
    many = materialise(wide.groupBy("g").count().filter(F.col("count") > COMPARED).select("g"), "many")
    small = wide.join(many, "g", "left_anti")
    of_large = materialise(wide.join(many, "g", "left_semi").select("name"), "of-large")
    # in a bucket's forest every member points at its class's first, so (key, b) names the class
    classes = hits.join(of_large.withColumnRenamed("name", "a"), "a", "left_semi").select(F.xxhash64("key", "b").alias("g"), F.explode(F.array("a", "b")).alias("name")).distinct()
    rows = materialise(small.select("g", "name").unionByName(classes.select("g", "name")).join(nodes.select("name", "thash"), "name"), "compared")
    discard(hits, wide, many, of_large)
    asked = materialise(rows.select("thash").distinct(), "asked")
    one = texts.filter(maybe(F.col("thash"), texts.sparkSession, asked, "thash")).join(asked, "thash", "left_semi").dropDuplicates(["thash"])
    sets = rows.join(one, "thash").select("g", "name", F.col("text").cast("binary").alias("text"))
    links = sets.repartition("g").sortWithinPartitions("g").mapInArrow(_set_links(spec), "a bigint, b bigint")
    rooted = _rooted(nodes.select("name", F.col("first").alias("least")), links).withColumnRenamed("name", "digest")
    return _with_class(marked.drop("hashes"), rooted, "digest").drop("digest")


def alike(sets: list[np.ndarray], jaccard: float) -> np.ndarray:
    """parent of each set (distinct hashes): the first of its class among links of that Jaccard similarity or more.

    Every set that is in no class yet is held against all; then all sets
    outside the largest class are. A link has an end there or lies inside the
    largest class, so none is lost.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True) if len(owner) else (None, np.empty(0, dtype=np.int64))
    starts, parent = np.cumsum(sizes) - sizes, np.arange(len(sets))
    has = np.zeros(len(owner) + 1, dtype=bool)
    probed = np.zeros(len(sets), dtype=bool)

    def probe(i: int, parent: np.ndarray) -> np.ndarray:
        own = codes[starts[i] : starts[i] + sizes[i]]
        has[own] = True
        both = np.bincount(owner[has[codes]], minlength=len(sets))
        has[own] = False
        probed[i] = True
        near = np.flatnonzero((both > 0) & (both >= jaccard * (sizes + sizes[i] - both) - 1e-9))
        return _unite(parent, np.full(len(near), i), near)

    joined = np.zeros(len(sets), dtype=bool)
    for i in range(len(sets)):
        if not joined[i]:
            parent = probe(i, parent)
            joined |= parent == parent[i]
    largest = np.bincount(parent).argmax()
    for i in np.flatnonzero((parent != largest) & ~probed):
        parent = probe(i, parent)
    return parent


def _set_links(spec: Spec):
    """Arrow batches (g, digest, text) sorted by g -> links between digests; a group may run over batches."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def emit(digests: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        if len(digests) > 1:
            parent = alike([np.unique(shingles(t, spec)) for t in texts], spec.jaccard)
            child = np.flatnonzero(parent != np.arange(len(parent)))
            if len(child):
                d = np.array(digests, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(d[child]), pa.array(d[parent[child]])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digests, texts = None, [], []
        for batch in batches:
            for g, digest, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    yield from emit(digests, texts)
                    group, digests, texts = g, [], []
                digests.append(digest)
                texts.append(text)
        yield from emit(digests, texts)

    return run


def keep_one(docs: DataFrame, spec: Spec = NEAR_COPIES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each class: that of the smallest id (rows without id last), one row of equal rows.

    Texts without words are one class, of which one stays. Rows without id
    are grouped like any other. An empty table stays empty.
    """
    return _keep_one(docs, near_duplicates(docs, spec, doc_id=doc_id, text=text), doc_id, text)


def _keep_one(docs: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "thash")
    best = found.groupBy("root").agg(F.min(rank).alias("b")).select(F.col("b.doc_id").alias("__id"), F.col("b.thash").alias("__th"))
    thash = F.coalesce(F.when(F.col(text).isNotNull(), F.xxhash64(text)), F.lit(0))
    d = docs.withColumn("__thash", thash)
    d = d.join(best, F.col(doc_id).eqNullSafe(F.col("__id")) & (F.col("__thash") == F.col("__th")), "left_semi")
    return d.dropDuplicates([doc_id, "__thash"]).select(*docs.columns)


def op10_bit_sliced(spark, sf_dir: str) -> DataFrame:
    """All documents; nulls, ties and repeated rows as in ``near_duplicates``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs.select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")
