"""Temporal list join: captures against the list entries that were active when they were fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.scratch import materialise

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"

#: The dated list that the registered query evaluates: list, verdict, key (host, or host with a path
#: prefix that ends in a slash), day of the entry, listed or taken off.
ENTRIES = [
    ("spam", "block", "spam-farm.example.org", "2024-01-01", True),
    ("spam", "block", "spam-farm.example.org", "2024-07-01", False),
    ("spam", "block", "spam-farm.example.org", "2024-10-01", True),
    ("gambling", "block", "casino-win.example.org", "2024-03-01", True),
    ("gambling", "block", "free-bets.example.com", "2024-02-01", True),
    ("gambling", "block", "free-bets.example.com", "2024-04-15", False),
    ("network", "block", "example.net", "2024-06-01", True),
    ("network", "block", "example.net", "2024-06-21", False),
    ("partners", "allow", "blog.ththha.example.com", "2024-01-01", True),
    ("partners", "allow", "m.ththth.example.net", "2024-01-01", True),
    ("partners", "allow", "m.ththth.example.net", "2024-06-11", False),
    ("review", "block", "ththed.example.org/en/", "2024-05-01", True),
]


def intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (list, verdict, key, day, listed) as validity intervals [since, until); until null: still active.

    Of entries of one list and key on one day the last word is the listing.
    Entries with a null key or day are never active. Keys are lower-cased.
    """
    e = entries.filter(F.col("key").isNotNull() & F.col("day").isNotNull())
    e = e.groupBy("list", "verdict", F.lower("key").alias("key"), F.col("day").cast("date").alias("since")).agg(F.max(F.coalesce("listed", F.lit(False))).alias("listed"))
    e = e.withColumn("until", F.lead("since").over(Window.partitionBy("list", "verdict", "key").orderBy("since")))
    return e.filter("listed").drop("listed")


def host_of(url: Column) -> Column:
    return F.rtrim(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), F.lit("."))


def directory_of(url: Column) -> Column:
    """The path to its last slash; / where there is none."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)
    return F.concat(F.lit("/"), F.regexp_extract(path, r"^/(.*/)?[^/]*$", 1))


def keys_of(host: Column, directory: Column, n_labels: list[int], n_parts: list[int]) -> Column:
    """Keys that an entry may list a URL by: the host or a domain above it, of a listed number of labels, and the host with a path prefix, of a listed number of parts."""
    labels, parts = F.split(host, r"\."), F.split(directory, "/")
    above = [F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), ".")) for n in n_labels]
    below = [F.when(F.size(parts) > n, F.concat(host, F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))) for n in n_parts]
    return F.array_distinct(F.array_compact(F.array(*above, *below, F.lit(None).cast("string"))))


def shapes(spans: DataFrame) -> tuple[list[int], list[int]]:
    """Numbers of labels of the listed hosts, and of parts of the listed path prefixes: one row for each number there is.

    A URL is joined only by keys of a shape that some entry has, so a key
    such as a top-level domain, which a third of all URLs share, is no join
    key unless the list names one.
    """
    path = F.col("key").contains("/")
    n = F.when(path, F.size(F.split("key", "/")) - 1).otherwise(F.size(F.split("key", r"\.")))
    found = spans.select(path.alias("p"), n.alias("n")).distinct().collect()
    return sorted(r.n for r in found if not r.p), sorted(r.n for r in found if r.p)


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures with ``host``, ``blocked`` and ``lists``, the sorted names of the lists that it was on when fetched.

    A capture is blocked if an active entry with verdict ``block`` covers it
    and none with ``allow`` does. A verdict depends on host, directory and
    day alone, so it is found once for each of these, and a host that holds a
    third of the captures is joined as often as it has such pairs. A null or
    malformed URL, or a null fetch time, is on no list. Repeated captures are
    all kept, and of entries of one list and key on one day a listing counts.
    Empty tables give an empty result, or one without a hit. Columns of captures named host, blocked or lists are replaced.
    """
    c = captures.drop("host", "blocked", "lists")
    c = c.withColumns({"host": host_of(F.col(url)), "__dir": directory_of(F.col(url)), "__day": F.col(fetched).cast("date")})
    asked = c.filter((F.col("host") != "") & F.col("__day").isNotNull()).select("host", "__dir", "__day").distinct()
    spans = materialise(intervals(entries), "intervals")
    asked = asked.withColumn("key", F.explode(keys_of(F.col("host"), F.col("__dir"), *shapes(spans))))
    active = (F.col("__day") >= F.col("since")) & (F.col("until").isNull() | (F.col("__day") < F.col("until")))
    hits = asked.join(spans, "key").filter(active)
    verdicts = hits.groupBy("host", "__dir", "__day").agg(F.max(F.col("verdict") == "block").alias("__block"), F.max(F.col("verdict") == "allow").alias("__allow"), F.sort_array(F.collect_set("list")).alias("lists"))
    out = c.join(verdicts, ["host", "__dir", "__day"], "left")
    out = out.withColumns({"blocked": F.coalesce(F.col("__block") & ~F.col("__allow"), F.lit(False)), "lists": F.coalesce("lists", F.array().cast("array<string>"))})
    return out.select(*[x for x in captures.columns if x not in ("host", "blocked", "lists")], "host", "blocked", "lists")


def op4_temporal_lists(spark, sf_dir: str) -> DataFrame:
    """All pages. They carry no fetch time; page n counts as fetched on day n mod 366 of 2024."""
    entries = spark.createDataFrame(ENTRIES, "list string, verdict string, key string, day string, listed boolean")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    return filter_urls(captures, entries).select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "blocked", F.array_join("lists", ",").alias("lists"))


OP4_SQL = r"""
WITH entries(list, verdict, key, day, listed) AS (VALUES
  %s),
days AS (SELECT list, verdict, key, day::DATE AS since, bool_or(listed) AS listed FROM entries GROUP BY ALL),
spans AS (SELECT *, lead(since) OVER (PARTITION BY list, verdict, key ORDER BY since) AS until FROM days),
c AS (
  SELECT page_id, date '2024-01-01' + (page_id %% 366)::INT AS fetched,
         rtrim(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '.') AS host,
         regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
hits AS (
  SELECT page_id, s.list, s.verdict
  FROM c JOIN spans s ON s.listed AND c.fetched >= s.since AND (s.until IS NULL OR c.fetched < s.until)
   AND (c.host = s.key OR ends_with(c.host, '.' || s.key) OR (s.key LIKE '%%/' AND starts_with(c.host || c.path, s.key)))),
v AS (
  SELECT page_id, bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow') AS blocked, string_agg(DISTINCT list, ',' ORDER BY list) AS lists
  FROM hits GROUP BY page_id)
SELECT c.page_id, c.host, c.fetched::DATE::VARCHAR AS fetched, coalesce(v.blocked, false) AS blocked, coalesce(v.lists, '') AS lists
FROM c LEFT JOIN v USING (page_id)
""" % ",\n  ".join(repr(x).replace("True", "true").replace("False", "false") for x in ENTRIES)
