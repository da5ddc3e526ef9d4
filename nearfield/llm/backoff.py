"""Stupid-backoff scores of documents from n-gram count tables of the whole corpus.

Documents are packed in blocks of some million words. A block explodes into
its distinct single words and pairs, as 64-bit hashes with counts, which go to
the buckets of their hash range: one packed row for a block and bucket. A
bucket sums its count table and joins it with what each block asked for, and
the counts return to the block. So a pair crosses the network once for a block
that holds it, however often it is there, and no bucket gets a frequent pair
more than once from a block.

Longer n-grams follow an order at a time. A block asks for one only if the two
shorter ones in it have the least count that an n-gram counts from: others are
too rare themselves, so that leaves no count out. When the last counts are
back, the block sums the scores of its documents. Blocks are written in
buckets of their number, so they stay where they are.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.scratch import materialise, materialise_bucketed

BACKOFF = 0.4
#: Words of the longest n-grams.
ORDER = 3
#: An n-gram of two words or more counts from so many occurrences in the corpus on; a rarer one backs off to the n-gram without its first word.
MIN_COUNT = 2
#: Words after which a block is closed; a longer document is a block of its own. About 100 bytes of memory for each.
BLOCK_WORDS = 1_000_000
#: Documents after which a block is closed, however short they are.
BLOCK_DOCS = 100_000
#: Words of the corpus to a bucket: it holds at most two hashes for each.
BUCKET_WORDS = 1_500_000


def _press(a: np.ndarray) -> bytes:
    """Bytes of an array, those of equal weight together, compressed."""
    return zstandard.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), 1)


def _unpress(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(size, -1).T.tobytes(), dtype)


def _blocks(docs: DataFrame, id_type: str, text: str, block_words: int, offset: int = 0) -> DataFrame:
    """(block, ids, n_words, body): ids of the documents (doc_id, text) and their words, a line for each document."""

    def pack(batches):
        block, ids, lines, n = offset + (TaskContext.get().partitionId() << 33), [], [], 0

        def row(kind):
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([ids], pa.list_(kind)), pa.array([n], pa.int64()), pa.array([zstandard.compress(b"\n".join(lines))], pa.binary())], ["block", "ids", "n_words", "body"])

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = t.split() if t is not None else []  # bytes split at the six ASCII separators
                ids.append(i), lines.append(b" ".join(w))
                n += len(w)
                if n >= block_words or len(ids) >= BLOCK_DOCS:
                    yield row(b.column(0).type)
                    block, ids, lines, n = block + 1, [], [], 0
            kind = b.column(0).type
        if ids:
            yield row(kind)

    rows = docs.select("doc_id", F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(pack, f"block long, ids array<{id_type}>, n_words long, body binary")


def _mixed(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of an n-gram from those of its words but the last, and of the last."""
    h = before * np.uint64(0x9E3779B97F4A7C15) + word
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Grams:
    """N-grams of a block. ``hashes`` (sorted, distinct) and ``counts`` are what it holds of the present stage.

    The first stage is words and pairs, each later one the n-grams of a word
    more. ``take`` receives the corpus counts of a stage and makes the next.
    """

    def __init__(self, body: bytes):
        lines = [x.split() for x in zstandard.decompress(body).split(b"\n")]
        self.lengths = np.array([len(x) for x in lines])
        codes, vocabulary = pd.factorize(np.array([*chain.from_iterable(lines), None], dtype=object)[:-1])
        del lines
        word = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in vocabulary), np.uint64, len(vocabulary))
        del vocabulary
        self.nth = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.word, self.order, self.at = word[codes], 2, np.flatnonzero(self.nth > 0)
        self.gram = np.zeros(len(codes), np.uint64)  # hash of the n-gram that ends at each word
        self.gram[self.at] = _mixed(self.word[self.at - 1], self.word[self.at])
        pairs, rank, times = np.unique(self.gram[self.at], return_inverse=True, return_counts=True)
        both = np.concatenate([word, pairs])
        order = np.argsort(both, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.hashes = both[order]
        self.counts = np.concatenate([np.bincount(codes, minlength=len(word)), times])[order].astype(np.int64)
        self.single, self.rank = place[codes], place[len(word) + rank]

    def take(self, counts: np.ndarray, total: int, backoff: float, min_count: int) -> None:
        """Score every word with the corpus counts of ``hashes``, and go on to n-grams of a word more."""
        if self.order == 2:
            self.seen = np.maximum(counts[self.single], 1)  # corpus count of the n-gram before, at its last word
            self.score = np.log(self.seen / max(total, 1))
        seen = np.zeros(len(self.nth), np.int64)
        seen[self.at] = counts[self.rank]
        at = np.flatnonzero(self.nth >= self.order - 1)
        follows = seen[at] >= min_count
        self.score[at] += np.log(backoff)
        at = at[follows]
        self.score[at] = np.log(seen[at] / np.maximum(self.seen[at - 1], 1))
        self.seen, self.order = seen, self.order + 1
        at = np.flatnonzero(self.nth >= self.order - 1)
        self.at = at[(seen[at] >= min_count) & (seen[at - 1] >= min_count)]
        longer = _mixed(self.gram[self.at - 1], self.word[self.at])
        self.gram = np.zeros(len(self.nth), np.uint64)
        self.gram[self.at] = longer
        self.hashes, rank, self.counts = np.unique(longer, return_inverse=True, return_counts=True)
        self.rank = rank.astype(np.int32)

    def sums(self) -> np.ndarray:
        """Sum of the logarithms of each document's words."""
        return np.bincount(np.repeat(np.arange(len(self.lengths)), self.lengths), self.score, len(self.lengths))


ASKED = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("replied", pa.bool_()), ("hashes", pa.binary()), ("counts", pa.binary())])
ASKED_SQL = "block long, bucket long, replied boolean, hashes binary, counts binary"


def _asked(block: int, g: Grams, n_buckets: int, counted: bool, replied: bool) -> pa.Table:
    """A row for each bucket that a block has hashes of."""
    bucket = ((g.hashes >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    edges = np.flatnonzero(np.diff(bucket, prepend=np.uint64(n_buckets), append=np.uint64(n_buckets))) if len(bucket) else []
    counts = g.counts if counted else np.zeros_like(g.counts)
    rows = [(block, int(bucket[a]), replied, _press(np.diff(g.hashes[a:z], prepend=np.uint64(0))), _press(counts[a:z])) for a, z in zip(edges[:-1], edges[1:], strict=True)]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, ASKED.types, strict=True)], schema=ASKED)


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """One bucket: its count table, joined with the hashes that blocks asked for."""
    hashes = [np.cumsum(_unpress(x, np.uint64), dtype=np.uint64) for x in rows["hashes"]]
    edges = np.cumsum([0, *map(len, hashes)])
    _, at = np.unique(np.concatenate(hashes), return_inverse=True)
    table = np.bincount(at, np.concatenate([_unpress(x, np.int64) for x in rows["counts"]])).astype(np.int64)
    out = [(block, bucket, _press(table[at[a:z]])) for block, bucket, replied, a, z in zip(rows["block"], rows["bucket"], rows["replied"], edges[:-1], edges[1:], strict=True) if replied]
    return pd.DataFrame(out, columns=["block", "bucket", "counts"])


def backoff_scores(docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT, doc_id: str = "doc_id", text: str = "text", block_words: int = BLOCK_WORDS, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """doc_id, n_scored, score: the mean natural logarithm over a document's words.

    A word scores count(n-gram) / count(n-gram without the word) for the
    n-gram of ``order`` words (2 at least) that ends with it, if that has
    min_count (1 at least) occurrences in the corpus (docs itself by default),
    else backoff times its score by a word less; alone it scores count / number
    of words. The first words of a document have shorter n-grams only. A word
    that the corpus lacks counts as seen once. Words are as written.
    Null and blank texts have n_scored 0 and a null score. Each row gets a row,
    equal ones too, null ids as they are. Other columns are left out.
    """
    if order < 2 or min_count < 1:
        raise ValueError("order must be 2 and min_count 1 at least")
    id_type = docs.schema[doc_id].dataType.simpleString()
    asking = _blocks(docs.select(F.col(doc_id).alias("doc_id"), text), id_type, text, block_words).withColumns({"asking": F.lit(True), "counting": F.lit(corpus is None)})
    if corpus is not None:
        only = _blocks(corpus.select(F.lit(None).cast(id_type).alias("doc_id"), text), id_type, text, block_words, 1 << 62)
        asking = asking.unionByName(only.withColumns({"asking": F.lit(False), "counting": F.lit(True)}))
    blocks = materialise_bucketed(asking, "blocks", "block")
    words, total = blocks.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("counting"), F.col("n_words"))), F.lit(0))).first()
    n_buckets = 1 + words // bucket_words

    def after(block: pa.Table, replies: pa.Table) -> Grams:
        """The block's n-grams once all replies so far are taken."""
        g = Grams(block.column("body")[0].as_py())
        parts = sorted(zip(*(replies.column(c).to_pylist() for c in ("stage", "bucket", "counts")), strict=True))
        for stage in range(max((x[0] for x in parts), default=0) + 1):
            counts = [_unpress(x, np.int64) for s, _, x in parts if s == stage]
            g.take(np.concatenate([np.empty(0, np.int64), *counts]), total, backoff, min_count)
        return g

    def first(batches):
        for b in batches:
            for block, body, asks, counts in zip(*(b.column(c).to_pylist() for c in ("block", "body", "asking", "counting")), strict=True):
                yield from _asked(block, Grams(body), n_buckets, counts, asks or order > 2).to_batches()

    def next_(block: pa.Table, replies: pa.Table) -> pa.Table:
        if not block.num_rows or not replies.num_rows:
            return ASKED.empty_table()
        asks, counts, last = block.column("asking")[0].as_py(), block.column("counting")[0].as_py(), replies.column("last")[0].as_py()
        return _asked(block.column("block")[0].as_py(), after(block, replies), n_buckets, counts, asks or not last)

    def score(block: pa.Table, replies: pa.Table) -> pa.Table:
        if not block.num_rows or not block.column("asking")[0].as_py():
            return pa.table({"doc_id": pa.array([], block.column("ids").type.value_type), "n_scored": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        g = after(block, replies)
        n = g.lengths
        while g.order <= order:  # nothing was left to ask for
            g.take(np.zeros(len(g.hashes), np.int64), total, backoff, min_count)
        return pa.table({"doc_id": block.column("ids").combine_chunks().flatten(), "n_scored": pa.array(n, pa.int64()), "score": pa.array(g.sums() / np.maximum(n, 1), pa.float64(), mask=n == 0)})

    def answered(asked: DataFrame, stage: int) -> DataFrame:
        replies = asked.groupBy("bucket").applyInPandas(_answer, "block long, bucket long, counts binary")
        return replies.withColumn("stage", F.lit(stage))

    parts = blocks.select("block", "body", "asking", "counting")
    answers = answered(parts.mapInArrow(first, ASKED_SQL), 0)
    for stage in range(1, order - 1):
        answers = materialise(answers, "answers") if stage == 1 else answers
        told = answers.withColumn("last", F.lit(stage == order - 2))
        asked = parts.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(next_, ASKED_SQL)
        more = answered(asked, stage)
        answers = answers.unionByName(more if stage == order - 2 else materialise(more, "answers"))
    return blocks.select("block", "ids", "body", "asking").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {id_type}, n_scored long, score double")


def op7_stupid_backoff(spark, sf_dir: str) -> DataFrame:
    """All documents, scored by n-grams of up to three words of all documents; nulls, ties and repeated rows as in ``backoff_scores``."""
    out = backoff_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_scored", F.round("score", 6).alias("score"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, CASE WHEN i > 2 THEN w[i - 2] END AS u, CASE WHEN i > 1 THEN w[i - 1] END AS v, w[i] AS w
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c3 AS (SELECT u, v, w, count(*) AS c FROM t WHERE u IS NOT NULL GROUP BY ALL),
c2 AS (SELECT v, w, count(*) AS c FROM t WHERE v IS NOT NULL GROUP BY ALL),
c1 AS (SELECT w, count(*) AS c FROM t GROUP BY w),
s AS (
  SELECT t.doc_id, CASE WHEN c3.c >= 2 THEN ln(c3.c / cuv.c)
                        WHEN c2.c >= 2 THEN ln(c2.c / cv.c) + CASE WHEN t.u IS NULL THEN 0 ELSE ln(0.4) END
                        ELSE ln(cw.c / (SELECT count(*) FROM t)) + CASE WHEN t.v IS NULL THEN 0 WHEN t.u IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END END AS s
  FROM t JOIN c1 cw ON t.w = cw.w LEFT JOIN c1 cv ON t.v = cv.w LEFT JOIN c2 ON t.v = c2.v AND t.w = c2.w
  LEFT JOIN c2 cuv ON t.u = cuv.v AND t.v = cuv.w LEFT JOIN c3 ON t.u = c3.u AND t.v = c3.v AND t.w = c3.w)
SELECT d.doc_id, count(s.s) AS n_scored, round(avg(s.s), 6) AS score FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""
