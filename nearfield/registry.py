"""Queries over the test tables, one for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.functions import columns as C
from nearfield.operators import dual, search, signing, upsert, verdict
from nearfield.sources import feed
from nearfield.streaming import sync

#: No two test vectors are near copies, so the lookups run at a threshold that some pairs reach.
LOOSE = 0.3
LOOSE_DUAL = 0.6
#: White space at the ends of a text.
WHITE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _index(spark, sf_dir, families=1):
    return signing.band_table(signing.sign(_read(spark, sf_dir, "embeddings"), families))


def flagship(spark, sf_dir):
    """Signatures, bands, candidates, verified pairs."""
    return near_pairs(spark, sf_dir)


def near_pairs(spark, sf_dir):
    out = search.near_pairs(_index(spark, sf_dir), LOOSE)
    return out.select("a", "b", "hamming", F.round("cosine", 6).alias("cosine"))


def signatures(spark, sf_dir):
    return signing.sign(_read(spark, sf_dir, "embeddings"), 3)


def band_rows(spark, sf_dir):
    return _index(spark, sf_dir).select("vec_id", "family", "band", "value")


def top_matches(spark, sf_dir):
    index = _index(spark, sf_dir)
    asked = index.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return search.find_similar(asked, index, LOOSE).select("query_id", "vec_id", "n_bands", "hamming", F.col("rank").cast("long").alias("rank"))


def hamming_scan(spark, sf_dir):
    signed = signing.sign(_read(spark, sf_dir, "embeddings")).withColumn("words", C.words64(F.col("signature")))
    return search.exact_scan(signed.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), signed, 100)


def previews(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", C.preview(F.col("text")).alias("preview"), F.length("text").alias("n"))


def token_windows(spark, sf_dir):
    tokens = F.split("text", " ")
    w = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(C.windows(tokens)).alias("chunk", "w"))
    return w.select("doc_id", "chunk", F.size("w").alias("n_tokens"), F.md5(F.array_join("w", " ").cast("binary")).alias("digest"))


def verdicts(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select("vec_id", C.suspicious_probability(F.transform(F.slice("embedding", 1, 2), lambda x: x.cast("double"))).alias("p"))
    return e.select("vec_id", F.round("p", 6).alias("score"), C.label(F.col("p")).alias("label"), C.response(F.col("p")).alias("response"))


def exact_dedup(spark, sf_dir):
    digest = F.md5(F.btrim("text", F.lit(WHITE)).cast("binary"))
    return _read(spark, sf_dir, "documents").groupBy(digest.alias("t")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def latest_event(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    merged = upsert.upsert(e.filter("event_id % 2 = 0").transform(lambda d: upsert.latest(d, "user_id", "ts", "event_id")), e.filter("event_id % 2 = 1"), "user_id", "ts", "event_id")
    return merged.select("user_id", "event_id", "event_type")


def sync_counts(spark, sf_dir):
    """Users seen up to the middle of the events' time span are cached; every later event is in the batch."""
    e = _read(spark, sf_dir, "events").select("user_id", "ts")
    first, last = e.agg(F.min("ts"), F.max("ts")).first()
    late = F.col("ts") > F.lit(first + (last - first) / 2 if last else None)
    return upsert.sync_counts(e.filter(~late).select("user_id").distinct(), e.filter(late), "user_id")


def dual_signatures(spark, sf_dir):
    return dual.dual_sign(_read(spark, sf_dir, "embeddings"))


def dual_pairs(spark, sf_dir):
    out = dual.dual_pairs(dual.dual_index(dual_signatures(spark, sf_dir)), LOOSE_DUAL)
    return out.select("x", "y", (F.floor(F.col("similarity") * 1e6 + 0.5) / 1e6).alias("similarity"))


def tiered_matches(spark, sf_dir):
    index = _index(spark, sf_dir, 3)
    asked = index.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    out = search.tiered_search(asked, index, LOOSE, 3)
    return out.withColumn("rank", F.col("rank").cast("long"))


def search_accuracy(spark, sf_dir):
    """Band lookup against the exact scan, for the same queries and distance."""
    index = _index(spark, sf_dir)
    asked = index.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    whole = signing.sign(_read(spark, sf_dir, "embeddings")).withColumn("words", C.words64(F.col("signature")))
    truth = search.exact_scan(whole.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), whole, C.largest_distance(LOOSE))
    found = search.find_similar(asked, index, LOOSE, max_results=2**31 - 1)
    got = search.quality(*[d.select(F.col("query_id").alias("a"), F.col("vec_id").alias("b")) for d in (truth, found)])
    return got.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def feed_signatures(spark, sf_dir):
    """Signatures as pages of a feed, written as JSON and read again."""
    s = signing.sign(_read(spark, sf_dir, "embeddings"))
    both = F.array(F.struct(F.lit("v0").alias("version"), F.lit("00").alias("signature")), F.struct(F.lit("v1").alias("version"), F.col("signature")))
    item = F.struct(F.col("vec_id").cast("string").alias("uuid"), F.lit("t").alias("title"), F.when(F.col("vec_id") % 3 > 0, "high").alias("severity"), F.when(F.col("vec_id") % 4 > 0, both).alias("detection_signatures"))
    pages = s.groupBy(F.floor(F.col("vec_id") / 50).alias("page")).agg(F.collect_list(item).alias("threat_feeds")).select(F.to_json(F.struct("page", "threat_feeds")).alias("body"))
    out = feed.signatures_of(feed.entries(pages))
    return out.select("uuid", "severity", "security_boundary", "signature", F.element_at("bands", 16).alias("last_band"))


def _scores(spark, sf_dir, first):
    e = _read(spark, sf_dir, "embeddings")
    p = C.suspicious_probability(F.transform(F.slice("embedding", first, 2), lambda x: x.cast("double")))
    return e.select("vec_id", F.floor(F.col("vec_id") / 5).alias("id"), (F.col("vec_id") % 5).alias("chunk"), p.alias("score")).withColumn("suspicious", C.label(F.col("score")) == "suspicious")


def chunk_verdicts(spark, sf_dir):
    out = verdict.reduce_chunks(_scores(spark, sf_dir, 1), "id")
    return out.select("id", "n_chunks", "suspicious", F.round("max_score", 6).alias("max_score"), F.round("first_score", 6).alias("first_score"))


def shadow_divergence(spark, sf_dir):
    out = verdict.divergence(_scores(spark, sf_dir, 1), _scores(spark, sf_dir, 3).filter("vec_id % 7 > 0 and id % 4 > 0"), "id")
    return out.withColumn("max_delta", F.round("max_delta", 6))


def layered_decision(spark, sf_dir):
    pairs = search.near_pairs(_index(spark, sf_dir), LOOSE)
    return verdict.layered(_scores(spark, sf_dir, 1), pairs.select(F.col("a").alias("vec_id")), pairs.select(F.col("b").alias("vec_id")), "vec_id")


def stream_latest(spark, sf_dir):
    schema = _read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return sync.sync_stream(stream, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type")


QUERIES = {
    f.__name__: f
    for f in (
        near_pairs, signatures, band_rows, top_matches, hamming_scan, previews, token_windows, verdicts, exact_dedup, latest_event, sync_counts, dual_signatures, dual_pairs,
        tiered_matches, search_accuracy, feed_signatures, chunk_verdicts, shadow_divergence, layered_decision, stream_latest,
    )
}


def _signed_sql(families: int, dims: int = 64, source: str = "embeddings", key: str = "vec_id", vector: str = "embedding") -> str:
    """CTE ``signed`` (key, family, signature): SplitMix64 in 128-bit arithmetic."""
    return f"""
seeds AS (
  SELECT f.i AS family, b.i AS bit, d.i AS dim,
         (((xor(xor(f.i::UBIGINT << 48, b.i::UBIGINT << 24), d.i::UBIGINT))::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z0
  FROM range({families}) f(i), range(256) b(i), range({dims}) d(i)),
z1 AS (SELECT family, bit, dim, ((xor(z0, z0 >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM seeds),
z2 AS (SELECT family, bit, dim, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM z1),
planes AS (SELECT family, bit, list(CASE WHEN xor(z, z >> 31) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY dim) AS p FROM z2 GROUP BY family, bit),
dots AS (SELECT {key}, family, bit, list_dot_product({vector}::DOUBLE[], p) > 0 AS one FROM {source}, planes),
digits AS (SELECT {key}, family, bit // 4 AS n, sum(CASE WHEN one THEN 8 >> (bit % 4) ELSE 0 END)::INT AS v FROM dots GROUP BY ALL),
signed AS (SELECT {key}, family::INT AS family, string_agg(substr('0123456789abcdef', v + 1, 1), '' ORDER BY n) AS signature FROM digits GROUP BY {key}, family)"""


_BANDS = ",\nbanded AS (SELECT vec_id, family, signature, i::INT AS band, substr(signature, (1 + 4 * i)::INT, 4) AS value FROM signed, range(16) r(i))"
_HAMMING = " + ".join(f"bit_count(xor(('0x' || substr(x.signature, {1 + 16 * i}, 16))::UBIGINT, ('0x' || substr(y.signature, {1 + 16 * i}, 16))::UBIGINT))::INT" for i in range(4))

SQL = {
    "signatures": f"WITH {_signed_sql(3)} SELECT vec_id, family, signature FROM signed",
    "band_rows": f"WITH {_signed_sql(1)}{_BANDS} SELECT vec_id, family, band, value FROM banded",
    "near_pairs": f"""WITH {_signed_sql(1)}{_BANDS},
pairs AS (SELECT DISTINCT x.vec_id AS a, y.vec_id AS b, ({_HAMMING})::INT AS hamming FROM banded x JOIN banded y USING (band, value) WHERE x.vec_id < y.vec_id)
SELECT a, b, hamming, round(cos(pi() * hamming / 256.0::DOUBLE), 6) AS cosine FROM pairs WHERE hamming <= 103""",
    "top_matches": f"""WITH {_signed_sql(1)}{_BANDS},
hits AS (SELECT x.vec_id AS query_id, y.vec_id AS vec_id, count(*) AS n_bands, min({_HAMMING})::INT AS hamming FROM banded x JOIN banded y USING (band, value) WHERE x.vec_id % 50 = 0 GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hamming, vec_id) AS rank FROM hits WHERE hamming <= 103) WHERE rank <= 10""",
    "hamming_scan": f"""WITH {_signed_sql(1)}
SELECT * FROM (SELECT x.vec_id AS query_id, y.vec_id AS vec_id, ({_HAMMING})::INT AS hamming FROM signed x, signed y WHERE x.vec_id % 50 = 0) WHERE hamming <= 100""",
    "previews": "SELECT doc_id, CASE WHEN length(text) <= 50 THEN text ELSE substr(text, 1, 47) || '...' END AS preview, length(text)::INT AS n FROM documents",
    "token_windows": """WITH t AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents),
c AS (SELECT doc_id, w, unnest(range(greatest(1, ceil((len(w) - 510) / 460.0)::INT + 1))) AS chunk FROM t)
SELECT doc_id, chunk::INT AS chunk, len(w[chunk * 460 + 1 : chunk * 460 + 510])::INT AS n_tokens, md5(array_to_string(w[chunk * 460 + 1 : chunk * 460 + 510], ' ')) AS digest FROM c""",
    "verdicts": """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b FROM embeddings),
s AS (SELECT vec_id, exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS p FROM p)
SELECT vec_id, round(p, 6) AS score, CASE WHEN p >= 0.5 THEN 'suspicious' ELSE 'safe' END AS label, CASE WHEN p >= 0.8 THEN 'block' WHEN p >= 0.5 THEN 'review' ELSE 'allow' END AS response FROM s""",
    "exact_dedup": f"SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY trim(text, '{WHITE}')",
    "latest_event": """WITH o AS (SELECT user_id, event_id, event_type, event_id % 2 AS odd, row_number() OVER (PARTITION BY user_id, event_id % 2 ORDER BY ts DESC, event_id DESC) AS n FROM events)
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY odd DESC) AS k FROM o WHERE n = 1) WHERE k = 1""",
    "sync_counts": """WITH b AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS middle FROM events),
c AS (SELECT DISTINCT user_id FROM events, b WHERE ts <= middle), k AS (SELECT user_id, count(*) AS n FROM events, b WHERE ts > middle GROUP BY 1),
j AS (SELECT n, CASE WHEN c.user_id IS NULL THEN 1 ELSE 0 END AS a FROM k LEFT JOIN c USING (user_id))
SELECT sum(a)::BIGINT AS added, sum(n - a)::BIGINT AS updated, ((SELECT count(*) FROM c) + sum(a))::BIGINT AS total FROM j""",
}

#: CTE ``dual`` (vec_id, hash_a, hash_b): the plain family beside the vector itself, padded with zeros.
_DUAL = """
p AS (SELECT vec_id, bit, list_dot_product(embedding::DOUBLE[], p) AS v FROM embeddings, planes UNION ALL
      SELECT vec_id, 256 + i, CASE WHEN i < 64 THEN embedding[i + 1]::DOUBLE ELSE 0.0 END FROM embeddings, range(256) r(i)),
least AS (SELECT vec_id, list_sort(list(abs(v)))[230] AS t FROM p GROUP BY vec_id),
nibbles AS (SELECT vec_id, bit // 4 AS n, sum(CASE WHEN v > 0 THEN 8 >> (bit % 4) ELSE 0 END)::INT AS a, sum(CASE WHEN abs(v) > t THEN 8 >> (bit % 4) ELSE 0 END)::INT AS b FROM p JOIN least USING (vec_id) GROUP BY ALL),
dual AS (SELECT vec_id, string_agg(substr('0123456789abcdef', a + 1, 1), '' ORDER BY n) AS hash_a, string_agg(substr('0123456789abcdef', b + 1, 1), '' ORDER BY n) AS hash_b FROM nibbles GROUP BY vec_id)"""
_WORD = lambda side, column, i: f"('0x' || substr({side}.{column}, {1 + 16 * i}, 16))::UBIGINT"
_APART = " + ".join(f"bit_count(xor({_WORD('x', 'hash_a', i)}, {_WORD('y', 'hash_a', i)}))::INT" for i in range(8))
_SURE = " + ".join(f"bit_count({_WORD('x', 'hash_b', i)} & {_WORD('y', 'hash_b', i)})::INT" for i in range(8))
_SURE_APART = " + ".join(f"bit_count({_WORD('x', 'hash_b', i)} & {_WORD('y', 'hash_b', i)} & xor({_WORD('x', 'hash_a', i)}, {_WORD('y', 'hash_a', i)}))::INT" for i in range(8))

_SCORES = """e AS (SELECT vec_id, vec_id // 5 AS id, vec_id % 5 AS chunk, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings),
s AS (SELECT vec_id, id, chunk, exp(b - greatest(a, b)) / (exp(a - greatest(a, b)) + exp(b - greatest(a, b))) AS p, exp(d - greatest(c, d)) / (exp(c - greatest(c, d)) + exp(d - greatest(c, d))) AS q FROM e)"""

SQL |= {
    "dual_signatures": f"WITH {_signed_sql(1)},{_DUAL} SELECT vec_id, hash_a, hash_b FROM dual",
    "dual_pairs": f"""WITH {_signed_sql(1)},{_DUAL},
piece AS (SELECT vec_id, i, substr(hash_a, (1 + 2 * i)::INT, 2) AS value FROM dual, range(64) r(i)),
near AS (SELECT DISTINCT l.vec_id AS x, r.vec_id AS y FROM piece l JOIN piece r USING (i, value) WHERE l.vec_id < r.vec_id),
n AS (SELECT near.x, near.y, {_APART} AS apart, {_SURE} AS sure, {_SURE_APART} AS sure_apart FROM near JOIN dual x ON x.vec_id = near.x JOIN dual y ON y.vec_id = near.y),
m AS (SELECT x, y, CASE WHEN sure > 0 THEN 0.65::DOUBLE * (sure - sure_apart) / sure + 0.35::DOUBLE * ((512 - apart) / 512.0::DOUBLE) ELSE (512 - apart) / 512.0::DOUBLE END AS s FROM n)
SELECT x, y, floor(s * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE AS similarity FROM m WHERE s >= 0.6""",
    "tiered_matches": f"""WITH {_signed_sql(3)}{_BANDS},
hits AS (SELECT x.vec_id AS query_id, y.vec_id AS vec_id, x.family, min({_HAMMING})::INT AS hamming FROM banded x JOIN banded y USING (family, band, value) WHERE x.vec_id % 50 = 0 GROUP BY ALL),
one AS (SELECT query_id, vec_id, min(family) AS tier, arg_min(hamming, family) AS hamming FROM hits WHERE hamming <= 103 GROUP BY ALL),
kept AS (SELECT o.* FROM one o WHERE (SELECT count(*) FROM one z WHERE z.query_id = o.query_id AND z.tier < o.tier) < 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hamming, vec_id) AS rank FROM kept) WHERE rank <= 3""",
    "search_accuracy": f"""WITH {_signed_sql(1)}{_BANDS},
t AS (SELECT x.vec_id AS a, y.vec_id AS b FROM signed x, signed y WHERE x.vec_id % 50 = 0 AND {_HAMMING} <= 103),
f AS (SELECT DISTINCT x.vec_id AS a, y.vec_id AS b FROM banded x JOIN banded y USING (band, value) WHERE x.vec_id % 50 = 0 AND {_HAMMING} <= 103),
n AS (SELECT (SELECT count(*) FROM t JOIN f USING (a, b)) AS tp, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM t) AS nt)
SELECT tp, nf - tp AS fp, nt - tp AS fn, round(coalesce(tp / nullif(nf, 0), 0.0), 6) AS precision, round(coalesce(tp / nullif(nt, 0), 0.0), 6) AS recall, round(coalesce(2 * tp / nullif(nf + nt, 0), 0.0), 6) AS f1 FROM n""",
    "feed_signatures": f"""WITH {_signed_sql(1)}
SELECT vec_id::VARCHAR AS uuid, CASE WHEN vec_id % 3 > 0 THEN 'high' ELSE 'low' END AS severity, '' AS security_boundary, signature, substr(signature, 61, 4) AS last_band FROM signed WHERE vec_id % 4 > 0""",
    "chunk_verdicts": f"""WITH {_SCORES}
SELECT id, count(*) AS n_chunks, bool_or(p >= 0.5) AS suspicious, round(max(p), 6) AS max_score, round(arg_min(p, chunk), 6) AS first_score FROM s GROUP BY id""",
    "shadow_divergence": f"""WITH {_SCORES},
h AS (SELECT *, vec_id % 7 > 0 AND id % 4 > 0 AS there FROM s)
SELECT id, count(*) AS n_primary, count(*) FILTER (there) AS n_shadow, round(max(abs(p - q)) FILTER (there), 6) AS max_delta,
       bool_or((p >= 0.5) <> (q >= 0.5)) FILTER (there) AS label_mismatch, bool_or(p >= 0.5) <> bool_or(q >= 0.5) FILTER (there) AS verdict_mismatch FROM h GROUP BY id""",
    "layered_decision": f"""WITH {_signed_sql(1)}{_BANDS}, {_SCORES},
pairs AS (SELECT DISTINCT x.vec_id AS a, y.vec_id AS b FROM banded x JOIN banded y USING (band, value) WHERE x.vec_id < y.vec_id AND {_HAMMING} <= 103),
l AS (SELECT vec_id, CASE WHEN p >= 0.5 THEN 'classifier' WHEN vec_id IN (SELECT a FROM pairs) THEN 'feed' WHEN vec_id IN (SELECT b FROM pairs) THEN 'dedup' END AS layer FROM s)
SELECT vec_id, layer IS NOT NULL AS blocked, layer FROM l""",
    "stream_latest": "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1",
}
