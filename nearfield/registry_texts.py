"""Queries over texts, exact search, caches and kept state, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.functions import columns as C
from nearfield.functions.dual import Calibrator, raw_similarity
from nearfield.functions.providers import CodePoints, mean_pool
from nearfield.operators import cache, dual, numbering, search, signing, texts
from nearfield.registry import _APART, _BANDS, _DUAL, _HAMMING, _SURE, _SURE_APART, LOOSE, WHITE, _index, _read, _signed_sql
from nearfield.scratch import scratch_path
from nearfield.sources import feed
from nearfield.streaming import sync

PROVIDER = CodePoints(1024)
BOS, EOS = 1, 2
KNOTS = Calibrator((0.0, 0.5, 0.75, 1.0), (0.0, 0.4, 0.8, 1.0))


def _documents(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", "text")


def _six(x):
    return F.floor(x * 1e6 + 0.5) / 1e6


def text_signatures(spark, sf_dir):
    out = texts.sign_text(_documents(spark, sf_dir), PROVIDER)
    return out.select("doc_id", "version", "signature", "prompt_preview", "prompt_length", "provider", "model", "dimensions", "embedding_sha256", F.size("lsh").alias("families"), F.element_at(F.element_at("lsh", 3)["bands"], 16).alias("last_band"))


def compared_texts(spark, sf_dir):
    """Each document beside the one with the next id."""
    d = _documents(spark, sf_dir)
    pairs = d.select("doc_id", F.col("text").alias("text_a")).join(d.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("text_b")), "doc_id")
    out = texts.compare_text(pairs, PROVIDER)
    return out.select("doc_id", "preview_a", "length_b", "signature_a", "signature_b", "hamming", _six(F.col("cosine")).alias("cosine"), "version")


def _tokens(text):
    return F.transform(F.split(text, " "), lambda w: F.length(w) * 37 + F.when(w == "", 0).otherwise(F.ascii(w)) + 10)


def _logits(ids):
    """A stand-in for a model: its logits follow from the sum of the chunk's tokens."""
    total = F.aggregate(ids, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.array((total % 7).cast("double"), (total % 5).cast("double"))


def classified(spark, sf_dir):
    d = _documents(spark, sf_dir)
    out = texts.classify(d, _tokens(F.col("text")), _logits, BOS, EOS)
    return out.select("doc_id", "is_suspicious", "total_tokens", F.size("chunks").alias("n_chunks"), F.element_at("chunks", -1)["token_count"].alias("last_count"), _six(F.element_at("chunks", 1)["score"]).alias("first_score"))


def sus_factors(spark, sf_dir):
    out = texts.sus_factor(_documents(spark, sf_dir), _tokens(F.col("text")), _logits, BOS, EOS)
    return out.select("doc_id", "label", _six(F.col("score")).alias("score"), "response")


def analyzed(spark, sf_dir):
    out = texts.analyze(_documents(spark, sf_dir), PROVIDER, _tokens(F.col("text")), _logits, BOS, EOS)
    return out.select("doc_id", "signature", "is_suspicious")


def pooled_vectors(spark, sf_dir):
    """Each vector as eight tokens of eight dimensions, of which every third is masked out."""
    e = _read(spark, sf_dir, "embeddings")
    tokens = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("embedding", i * 8 + 1, 8))
    mask = F.array(*[F.lit(int(i % 3 > 0)) for i in range(8)])
    p = e.select("vec_id", mean_pool(tokens, mask, 8).alias("p"))
    return p.select("vec_id", *[_six(F.col("p")[i]).alias(f"p{i}") for i in range(8)])


def stored_signatures(spark, sf_dir):
    """Signatures in several spellings: which are stored ones, and what is read of them."""
    s = signing.sign(_read(spark, sf_dir, "embeddings"))
    k = F.col("vec_id") % 5
    text = F.when(k == 0, C.signature_string(F.lit("v1"), F.col("signature"))).when(k == 1, C.signature_string(F.lit("v0"), F.substring("signature", 1, 16))).when(k == 2, F.upper(C.signature_string(F.lit("v1"), F.col("signature")))).when(k == 3, C.signature_string(F.lit("v12"), F.col("signature"))).otherwise(F.col("signature"))
    t = s.select("vec_id", text.alias("t")).withColumn("p", C.parse_signature(F.col("t")))
    v = F.col("p.version")
    return t.select("vec_id", C.is_stored(F.col("t")).alias("stored"), v.alias("version"), F.length("p.signature").alias("digits"), C.dimensions_of(v).alias("dimensions"), C.algorithm_of(v).alias("algorithm"))


def plain_agreement(spark, sf_dir):
    return dual.verify_plain(_read(spark, sf_dir, "embeddings"))


def hasher_families(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.explode(texts.get_hasher("cm-lsh")(F.col("embedding"))).alias("s"))
    return e.select("vec_id", "s.family", "s.bits", "s.signature", F.size("s.bands").alias("n_bands"), F.element_at("s.bands", 64).alias("last_band"))


def calibrated_pairs(spark, sf_dir):
    """The similarity of each vector to that of id 0, calibrated."""
    s = dual.dual_sign(_read(spark, sf_dir, "embeddings")).select("vec_id", C.words64(F.col("hash_a"), 8).alias("a"), C.words64(F.col("hash_b"), 8).alias("b"))
    one = s.filter("vec_id = 0").select(F.col("a").alias("a0"), F.col("b").alias("b0"))
    out = s.crossJoin(F.broadcast(one)).select("vec_id", Calibrator.from_json(KNOTS.to_json())(raw_similarity(F.col("a"), F.col("b"), F.col("a0"), F.col("b0"))).alias("s"))
    return out.select("vec_id", _six(F.col("s")).alias("similarity"))


def _asked(e):
    return e.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")


def cosine_pairs(spark, sf_dir):
    """The exact truth for the stated queries."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.exact_cosine(_asked(e), e, threshold=LOOSE).withColumn("cosine", _six(F.col("cosine")))


def nearest(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search.exact_cosine(_asked(e), e, k=5).select("query_id", "vec_id", _six(F.col("cosine")).alias("cosine"), F.col("rank").cast("long").alias("rank"))


def lookup_accuracy(spark, sf_dir):
    """Lookups in three families of 64 bands of four bits against the exact cosine, for the stated queries."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    signed = e.withColumn("signatures", F.array(*[signing.simhash(F.col("embedding"), f) for f in range(3)]))
    got = search.lookup_quality(_asked(signed), signed, LOOSE)
    return got.select("tp", "fp", "fn", *[_six(F.col(c)).alias(c) for c in ("precision", "recall", "f1")])


def closest_pairs(spark, sf_dir):
    return search.closest_pairs(search.near_pairs(_index(spark, sf_dir), LOOSE)).select("a", "b", "hamming")


def embedding_copies(spark, sf_dir):
    """Embeddings beside themselves at twice the length: each digest is there twice."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    again = e.select((F.col("vec_id") + 1_000_000).alias("vec_id"), F.transform("embedding", lambda x: x * 2).alias("embedding"))
    return search.distinct_embeddings(e.unionByName(again)).select("vec_id", "copies")


def percentile_stats(spark, sf_dir):
    out = numbering.exclusive_percentiles(_read(spark, sf_dir, "events"), "value", group="event_type")
    return out.select("event_type", "n", *[_six(F.col(c)).alias(c) for c in ("max", "mean", "p50", "p95", "p99")])


def partial_bands(spark, sf_dir):
    """Candidates that share two bands or more."""
    index = _index(spark, sf_dir)
    out = search.find_similar(_asked(index), index, 0.0, max_results=2**31 - 1, least_bands=2)
    return out.select("query_id", "vec_id", "n_bands", "hamming")


def band_documents(spark, sf_dir):
    """Documents that lie in a band of the document of id 0, by the signatures of their texts, and the candidates' rows."""
    d = _read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    signed = texts.sign_text(d, PROVIDER, families=1).select("doc_id", F.explode("lsh").alias("s")).select("doc_id", "s.family", "s.signature")
    index = signing.band_table(signed, key="doc_id")
    wanted = index.filter("doc_id = 0")
    found = search.documents_in_bands(index, d.select("doc_id", "lang"), wanted, key="doc_id")
    return search.documents_of(found, found, key="doc_id").select("doc_id", "lang", "n_bands")


def match_lines(spark, sf_dir):
    pairs = search.near_pairs(_index(spark, sf_dir), LOOSE)
    return pairs.select("a", "b", C.match_line(F.concat(F.lit("t"), F.col("b").cast("string")), F.lit("high"), F.lit("x"), F.col("cosine"), F.col("hamming")).alias("line"))


def _signed(spark, sf_dir):
    return signing.sign(_read(spark, sf_dir, "embeddings"))


def cached_lookup(spark, sf_dir):
    """The corpus written, loaded, and asked."""
    folder = scratch_path(spark, "cache")
    cache.save(_signed(spark, sf_dir), folder)
    index = cache.load(spark, folder).index
    return search.find_similar(_asked(index), index, LOOSE).select("query_id", "vec_id", "hamming")


def appended_index(spark, sf_dir):
    """The upper half of the ids added to a cache of the lower one."""
    signed, folder = _signed(spark, sf_dir), scratch_path(spark, "cache")
    middle = signed.agg(F.expr("(min(vec_id) + max(vec_id)) div 2")).first()[0]
    cache.save(signed.filter(F.col("vec_id") <= middle), folder)
    whole = cache.append(cache.load(spark, folder), signed.filter(F.col("vec_id") > middle))
    return whole.index.select("vec_id", "family", "band", "value")


def replaced_index(spark, sf_dir):
    """Every signature reversed for ids divisible by 3, and those divisible by 7 gone."""
    signed, folder = _signed(spark, sf_dir), scratch_path(spark, "cache")
    cache.save(signed, folder)
    new = signed.filter("vec_id % 3 = 0 and vec_id % 7 <> 0").withColumn("signature", F.reverse("signature"))
    whole = cache.replace(cache.load(spark, folder), new, signed.filter("vec_id % 7 = 0"))
    return whole.index.select("vec_id", "family", "band", "value")


def blocked_state(spark, sf_dir):
    """A stream of signatures; the multiples of 40 are blocked by the classifier, what is like a blocked one by the state."""
    signed = materialised(_signed(spark, sf_dir).select("vec_id", "signature", (F.col("vec_id") % 40 == 0).alias("suspicious")))
    stream = spark.readStream.schema("vec_id long, signature string, suspicious boolean").parquet(signed)
    return sync.block_stream(stream, LOOSE).select("vec_id", "why")


def materialised(df):
    path = scratch_path(df.sparkSession, "stream")
    df.write.parquet(path)
    return path


def _pages(spark, sf_dir):
    s = _signed(spark, sf_dir)
    one = F.array(F.struct(F.lit("v1").alias("version"), F.col("signature")))
    day = F.concat(F.lit("2024-01-"), F.lpad((F.col("vec_id") % 28 + 1).cast("string"), 2, "0"))
    more = F.when(F.col("vec_id") % 2 == 0, F.array(F.lit("m1"), F.lit("m2")))
    item = F.struct(F.col("vec_id").cast("string").alias("uuid"), F.lit("t").alias("title"), day.alias("updated_at"), one.alias("detection_signatures"), more.alias("models"), F.concat(F.lit("s"), F.col("vec_id").cast("string")).alias("source"))
    return s.groupBy(F.floor(F.col("vec_id") / 50).alias("page")).agg(F.collect_list(item).alias("threat_feeds")).select(F.to_json(F.struct("page", "threat_feeds")).alias("body"))


def feed_extras(spark, sf_dir):
    return feed.extra_fields(_pages(spark, sf_dir), ["models", "source", "disclosedAt"])


def feed_entry(spark, sf_dir):
    return feed.entry_of(feed.entries(_pages(spark, sf_dir)), "7").select("uuid", "title", "severity", "updated_at")


def feed_since(spark, sf_dir):
    """Signatures updated since the latest update among the first 20 ids, that one included."""
    e = feed.entries(_pages(spark, sf_dir))
    since = feed.cursor(e.filter(F.col("uuid").cast("long") < 20)).first()["since"]
    return feed.signatures_of(e, since=F.lit(since)).select("uuid", "updated_at", "signature")


def feed_sync(spark, sf_dir):
    """A folder brought up to the first half of a feed, then to all of it; the second run's counts."""
    e, folder = feed.entries(_pages(spark, sf_dir)), scratch_path(spark, "feed")
    cache.sync(e.filter(F.col("updated_at") <= "2024-01-14"), folder)
    return cache.sync(e, folder)


def prompt_texts(spark, sf_dir):
    """Documents as prompt files of up to 50 under two keys: distinct texts, by their first place."""
    d = _documents(spark, sf_dir)
    item = F.struct(F.lit(" ").alias("prompt"), F.col("text"))
    page = F.floor(F.col("doc_id") / 50)
    rows = d.groupBy(page.alias("file")).agg(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("all"))
    files = rows.select("file", F.to_json(F.struct(F.transform("all", lambda x: x["item"]).alias("results"))).alias("body"))
    return feed.prompts(files).select("place", F.md5(F.col("text").cast("binary")).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        text_signatures, compared_texts, classified, sus_factors, analyzed, pooled_vectors, stored_signatures, plain_agreement, hasher_families, calibrated_pairs, cosine_pairs, nearest, lookup_accuracy,
        closest_pairs, embedding_copies, percentile_stats, partial_bands, band_documents, match_lines, cached_lookup, appended_index, replaced_index, blocked_state, feed_extras, feed_entry, feed_since, feed_sync, prompt_texts,
    )
}

_S6 = lambda x: f"floor(({x}) * 1e6::DOUBLE + 0.5::DOUBLE) / 1e6::DOUBLE"
#: CTE ``counted`` (doc_id, text, v): what CodePoints(1024) makes of a text.
_COUNTED = """chars AS (SELECT doc_id, unicode(c) % 1024 AS k, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL),
grid AS (SELECT doc_id, text, k FROM documents, range(1024) r(k) WHERE text IS NOT NULL),
counted AS (SELECT doc_id, any_value(text) AS text, list(coalesce(n, 0) + 0.1::DOUBLE / (k + 2) ORDER BY k) AS v FROM grid LEFT JOIN chars USING (doc_id, k) GROUP BY doc_id)"""
_TEXT_SIGNED = lambda n: f"{_COUNTED},{_signed_sql(n, 1024, 'counted', 'doc_id', 'v')}"
#: A list of numbers set to unit length, as text to six places.
_SIX_PLACES = """list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)) * 1e6)::BIGINT)"""
_WRITTEN = """'[' || array_to_string(list_transform(q, lambda n: (n // 1000000)::VARCHAR || '.' || CASE WHEN n % 1000000 = 0 THEN '0' ELSE rtrim(lpad((n % 1000000)::VARCHAR, 6, '0'), '0') END), ', ') || ']'"""
_PREVIEW = "CASE WHEN length(text) <= 50 THEN text ELSE substr(text, 1, 47) || '...' END"
#: CTE ``scored`` (doc_id, c, n, total_tokens, p): the chunks of a text, scored by the stand-in for a model.
_SCORED = """ids AS (SELECT doc_id, list_transform(CASE WHEN text IS NULL THEN []::VARCHAR[] ELSE string_split(text, ' ') END, lambda w: length(w) * 37 + CASE WHEN w = '' THEN 0 ELSE unicode(w) END + 10) AS w FROM documents),
cut AS (SELECT doc_id, len(w) AS total_tokens, c, w[c * 460 + 1 : c * 460 + 510] AS w FROM (SELECT doc_id, w, unnest(range(greatest(1, ceil((len(w) - 510) / 460.0)::INT + 1))) AS c FROM ids)),
summed AS (SELECT doc_id, c, len(w) + 2 AS n, total_tokens, coalesce(list_sum(w), 0)::BIGINT + 3 AS z FROM cut),
scored AS (SELECT *, exp((z % 5)::DOUBLE - greatest(z % 5, z % 7)) / (exp((z % 7)::DOUBLE - greatest(z % 5, z % 7)) + exp((z % 5)::DOUBLE - greatest(z % 5, z % 7))) AS p FROM summed)"""
_UNIT = "u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)"
_COSINES = f"{_UNIT}, c AS (SELECT x.vec_id AS query_id, y.vec_id, list_dot_product(x.v, y.v) AS cosine FROM u x, u y WHERE x.vec_id % 50 = 0)"
_DAY = "'2024-01-' || lpad((vec_id % 28 + 1)::VARCHAR, 2, '0')"
_KNOTS = "CASE WHEN s <= 0 THEN 0.0 WHEN s < 0.5 THEN s * 0.8::DOUBLE WHEN s < 0.75 THEN 0.4::DOUBLE + (s - 0.5::DOUBLE) * 1.6::DOUBLE WHEN s < 1 THEN 0.8::DOUBLE + (s - 0.75::DOUBLE) * 0.8::DOUBLE ELSE 1.0 END"
_PAIRS = "pairs AS (SELECT DISTINCT x.vec_id AS a, y.vec_id AS b, (" + _HAMMING + ")::INT AS hamming FROM banded x JOIN banded y USING (band, value) WHERE x.vec_id < y.vec_id AND " + _HAMMING + " <= 103)"
_FINE = ",\nbanded AS (SELECT vec_id, family, signature, i::INT AS band, substr(signature, (1 + i)::INT, 1) AS value FROM signed, range(64) r(i))"

SQL: dict[str, str] = {
    "text_signatures": f"""WITH {_TEXT_SIGNED(3)},
written AS (SELECT doc_id, text, sha256({_WRITTEN}) AS sha FROM (SELECT doc_id, text, {_SIX_PLACES} AS q FROM counted))
SELECT doc_id, 'v1' AS version, '0din-v1:' || x.signature AS signature, {_PREVIEW} AS prompt_preview, length(text)::INT AS prompt_length, 'code-points' AS provider, 'counts' AS model, 1024 AS dimensions, sha AS embedding_sha256, 3 AS families, substr(z.signature, 61, 4) AS last_band
FROM written JOIN signed x USING (doc_id) JOIN signed z USING (doc_id) WHERE x.family = 0 AND z.family = 2""",
    "compared_texts": f"""WITH {_TEXT_SIGNED(1)},
d AS (SELECT doc_id, signature, text FROM signed JOIN counted USING (doc_id)),
h AS (SELECT x.doc_id, {_PREVIEW.replace("text", "x.text")} AS preview_a, strlen(y.text)::INT AS length_b, '0din-v1:' || x.signature AS signature_a, '0din-v1:' || y.signature AS signature_b, ({_HAMMING})::INT AS hamming FROM d x JOIN d y ON y.doc_id = x.doc_id + 1)
SELECT *, {_S6("cos(pi() * hamming / 256.0::DOUBLE)")} AS cosine, 'v1' AS version FROM h""",
    "classified": f"""WITH {_SCORED}
SELECT doc_id, bool_or(p >= 0.5) AS is_suspicious, any_value(total_tokens)::INT AS total_tokens, count(*)::INT AS n_chunks, arg_max(n, c)::INT AS last_count, {_S6("arg_min(p, c)")} AS first_score FROM scored GROUP BY doc_id""",
    "sus_factors": f"""WITH {_SCORED}, m AS (SELECT doc_id, max(p) AS p FROM scored GROUP BY doc_id)
SELECT doc_id, CASE WHEN p >= 0.5 THEN 'suspicious' ELSE 'safe' END AS label, {_S6("p")} AS score, CASE WHEN p >= 0.8 THEN 'block' WHEN p >= 0.5 THEN 'review' ELSE 'allow' END AS response FROM m""",
    "analyzed": f"""WITH {_TEXT_SIGNED(1)}, {_SCORED}
SELECT doc_id, any_value('0din-v1:' || signature) AS signature, bool_or(p >= 0.5) AS is_suspicious FROM scored LEFT JOIN signed USING (doc_id) GROUP BY doc_id""",
    "pooled_vectors": "SELECT vec_id, " + ", ".join(_S6("(" + " + ".join(f"embedding[{8 * i + k + 1}]::DOUBLE" for i in (1, 2, 4, 5, 7)) + ") / 5") + f" AS p{k}" for k in range(8)) + " FROM embeddings",
    "stored_signatures": f"""WITH {_signed_sql(1)}
SELECT vec_id, vec_id % 5 IN (0, 3) AS stored, CASE vec_id % 5 WHEN 0 THEN 'v1' WHEN 1 THEN 'v0' END AS version, CASE vec_id % 5 WHEN 0 THEN 64 WHEN 1 THEN 16 END AS digits, CASE vec_id % 5 WHEN 0 THEN 1024 WHEN 1 THEN 1536 END AS dimensions, CASE vec_id % 5 WHEN 0 THEN 'onnx' WHEN 1 THEN 'openai' END AS algorithm FROM signed""",
    "plain_agreement": f"WITH {_signed_sql(1)} SELECT vec_id, signature AS plain, true AS agrees FROM signed",
    "hasher_families": f"WITH {_signed_sql(1)},{_DUAL} SELECT vec_id, 0 AS family, 512 AS bits, hash_a AS signature, 64 AS n_bands, substr(hash_a, 127, 2) AS last_band FROM dual",
    "calibrated_pairs": f"""WITH {_signed_sql(1)},{_DUAL},
n AS (SELECT x.vec_id, {_APART} AS apart, {_SURE} AS sure, {_SURE_APART} AS sure_apart FROM dual x, dual y WHERE y.vec_id = 0),
m AS (SELECT vec_id, CASE WHEN sure > 0 THEN 0.65::DOUBLE * (sure - sure_apart) / sure + 0.35::DOUBLE * ((512 - apart) / 512.0::DOUBLE) ELSE (512 - apart) / 512.0::DOUBLE END AS s FROM n)
SELECT vec_id, {_S6(_KNOTS)} AS similarity FROM m""",
    "cosine_pairs": f"WITH {_COSINES} SELECT query_id, vec_id, {_S6('cosine')} AS cosine FROM c WHERE cosine >= 0.3",
    "nearest": f"WITH {_COSINES} SELECT query_id, vec_id, {_S6('cosine')} AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS rank FROM c) WHERE rank <= 5",
    "lookup_accuracy": f"""WITH {_signed_sql(3)}{_FINE}, {_COSINES},
t AS (SELECT query_id AS a, vec_id AS b FROM c WHERE cosine >= 0.3),
f AS (SELECT DISTINCT x.vec_id AS a, y.vec_id AS b FROM banded x JOIN banded y USING (family, band, value) WHERE x.vec_id % 50 = 0 AND {_HAMMING} <= 103),
n AS (SELECT (SELECT count(*) FROM t JOIN f USING (a, b)) AS tp, (SELECT count(*) FROM f) AS nf, (SELECT count(*) FROM t) AS nt),
r AS (SELECT tp, nf - tp AS fp, nt - tp AS fn, coalesce(tp / nullif(nf, 0), 0.0) AS p, coalesce(tp / nullif(nt, 0), 0.0) AS r, coalesce(2 * tp / nullif(nf + nt, 0), 0.0) AS f FROM n)
SELECT tp, fp, fn, {_S6("p")} AS precision, {_S6("r")} AS recall, {_S6("f")} AS f1 FROM r""",
    "closest_pairs": f"WITH {_signed_sql(1)}{_BANDS}, {_PAIRS} SELECT * FROM pairs ORDER BY hamming, a, b LIMIT 10",
    "embedding_copies": f"""WITH {_UNIT}, q AS (SELECT vec_id, list_transform(v, lambda x: round(x * 1e6)::BIGINT) AS q FROM u)
SELECT min(vec_id) AS vec_id, 2 * count(*) AS copies FROM q GROUP BY q""",
    "percentile_stats": """WITH l AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, max(value) AS mx, avg(value) AS mn FROM events WHERE value IS NOT NULL GROUP BY 1),
p AS (SELECT event_type, n, mx, mn, """ + ", ".join(f"greatest(1, least(n - 1, {i} * (n + 1) // 100)) AS j{i}" for i in (50, 95, 99)) + """, v FROM l)
SELECT event_type, n, """ + _S6("mx") + " AS max, " + _S6("mn") + " AS mean, " + ", ".join(_S6(f"(v[j{i}] * (100 - ({i} * (n + 1) - j{i} * 100)) + v[j{i} + 1] * ({i} * (n + 1) - j{i} * 100)) / 100") + f" AS p{i}" for i in (50, 95, 99)) + " FROM p",
    "partial_bands": f"""WITH {_signed_sql(1)}{_BANDS},
hits AS (SELECT x.vec_id AS query_id, y.vec_id AS vec_id, count(*) AS n_bands, min({_HAMMING})::INT AS hamming FROM banded x JOIN banded y USING (band, value) WHERE x.vec_id % 50 = 0 GROUP BY ALL)
SELECT * FROM hits WHERE n_bands >= 2 AND hamming <= 128""",
    "band_documents": f"""WITH {_TEXT_SIGNED(1)}, banded AS (SELECT doc_id, i, substr(signature, (1 + 4 * i)::INT, 4) AS value FROM signed, range(16) r(i)),
h AS (SELECT x.doc_id, count(*) AS n_bands FROM banded x JOIN banded y USING (i, value) WHERE y.doc_id = 0 GROUP BY 1)
SELECT doc_id, lang, n_bands FROM h JOIN documents USING (doc_id)""",
    "match_lines": f"WITH {_signed_sql(1)}{_BANDS}, {_PAIRS} SELECT a, b, printf('t%d (high, x) - cosine: %.4f, hamming: %d', b, cos(pi() * hamming / 256.0::DOUBLE), hamming) AS line FROM pairs",
    "cached_lookup": f"""WITH {_signed_sql(1)}{_BANDS},
hits AS (SELECT x.vec_id AS query_id, y.vec_id AS vec_id, min({_HAMMING})::INT AS hamming FROM banded x JOIN banded y USING (band, value) WHERE x.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, vec_id, hamming FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hamming, vec_id) AS rank FROM hits WHERE hamming <= 103) WHERE rank <= 10""",
    "appended_index": f"WITH {_signed_sql(1)}{_BANDS} SELECT vec_id, family, band, value FROM banded",
    "replaced_index": f"""WITH {_signed_sql(1)}, s AS (SELECT vec_id, family, CASE WHEN vec_id % 3 = 0 THEN reverse(signature) ELSE signature END AS signature FROM signed WHERE vec_id % 7 <> 0)
SELECT vec_id, family, i::INT AS band, substr(signature, (1 + 4 * i)::INT, 4) AS value FROM s, range(16) r(i)""",
    "blocked_state": f"""WITH RECURSIVE {_signed_sql(1)}{_BANDS}, {_PAIRS},
b AS (SELECT vec_id FROM signed WHERE vec_id % 40 = 0 UNION SELECT pairs.b FROM b JOIN pairs ON pairs.a = b.vec_id)
SELECT vec_id, CASE WHEN vec_id % 40 = 0 THEN 'classifier' ELSE 'state' END AS why FROM b""",
    "feed_extras": """SELECT vec_id::VARCHAR AS uuid, CASE WHEN vec_id % 2 = 0 THEN '["m1","m2"]' END AS models, 's' || vec_id AS source, NULL::VARCHAR AS "disclosedAt" FROM embeddings""",
    "feed_entry": f"SELECT vec_id::VARCHAR AS uuid, 't' AS title, 'low' AS severity, {_DAY} AS updated_at FROM embeddings WHERE vec_id = 7",
    "feed_since": f"""WITH {_signed_sql(1)}, e AS (SELECT vec_id, signature, {_DAY} AS updated_at FROM signed)
SELECT vec_id::VARCHAR AS uuid, updated_at, signature FROM e WHERE updated_at >= (SELECT max(updated_at) FROM e WHERE vec_id < 20)""",
    "feed_sync": f"""WITH e AS (SELECT vec_id, {_DAY} AS d FROM embeddings), o AS (SELECT * FROM e WHERE d <= '2024-01-14'), n AS (SELECT * FROM e WHERE d >= (SELECT max(d) FROM o))
SELECT (SELECT count(*) FROM n WHERE vec_id NOT IN (SELECT vec_id FROM o)) AS added, (SELECT count(*) FROM n WHERE vec_id IN (SELECT vec_id FROM o)) AS updated, (SELECT count(*) FROM o) + (SELECT count(*) FROM n WHERE vec_id NOT IN (SELECT vec_id FROM o)) AS total""",
    "prompt_texts": f"""WITH t AS (SELECT trim(text, '{WHITE}') AS t, min(doc_id) AS first FROM documents WHERE trim(text, '{WHITE}') <> '' GROUP BY 1)
SELECT row_number() OVER (ORDER BY first) - 1 AS place, md5(t) AS digest FROM t""",
}
