"""Pages of a threat feed: nested JSON to entries and to the signatures that a corpus holds."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from nearfield.functions.columns import bands
from nearfield.operators.numbering import numbered

ENTRY = (
    "struct<uuid:string,title:string,severity:string,security_boundary:string,summary:string,updated_at:string,"
    "detection_signatures:array<struct<version:string,signature:string>>>"
)
PAGE = f"page int, total_pages int, total_count int, threat_feeds array<{ENTRY}>"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: its text as ``body``."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("body"))


def entries(pages: DataFrame, body: str = "body") -> DataFrame:
    """One row for each entry of the pages. An absent severity is low, an absent boundary or signature list empty.

    A body that is no page, and an entry without uuid or title, is an error.
    """
    page = F.from_json(F.col(body), PAGE, {"mode": "FAILFAST"})
    e = pages.select(F.explode(page["threat_feeds"]).alias("e")).select("e.*")
    needed = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.lit(f"entry without {c}")).cast("string")).alias(c)
    return e.select(
        needed("uuid"), needed("title"), F.coalesce("severity", F.lit("low")).alias("severity"), F.coalesce("security_boundary", F.lit("")).alias("security_boundary"),
        "summary", "updated_at", F.coalesce("detection_signatures", F.array().cast("array<struct<version:string,signature:string>>")).alias("detection_signatures"),
    )


def signatures_of(feed: DataFrame, version: str = "v1", since: Column | None = None) -> DataFrame:
    """Entries with one row for each signature of the version and its 16 bands; entries without one are left out.

    since: entries updated at that time or later.
    """
    feed = feed if since is None else feed.filter(F.col("updated_at") >= since)
    one = feed.withColumn("s", F.explode("detection_signatures")).filter(F.col("s.version") == version)
    return one.withColumn("signature", F.col("s.signature")).drop("s", "detection_signatures").withColumn("bands", bands(F.col("signature")))


def cursor(cached: DataFrame) -> DataFrame:
    """One row ``since``: the latest update among cached rows."""
    return cached.agg(F.max("updated_at").alias("since"))


def entry_of(feed: DataFrame, uuid: str) -> DataFrame:
    """The entry of a uuid; an error where there is none."""
    found = feed.filter(F.col("uuid") == uuid)
    if found.isEmpty():
        raise KeyError(f"no entry {uuid}")
    return found


#: Further fields of an entry, by the name they are asked for and their key in the page.
EXTRA_FIELDS = {
    "taxonomies": "taxonomies",
    "models": "models",
    "testResults": "test_results",
    "metadata": "metadata",
    "referenceUrls": "reference_urls",
    "variantPrompts": "variant_prompts",
    "disclosedAt": "disclosed_at",
    "publishedAt": "published_at",
    "source": "source",
}


def extra_fields(pages: DataFrame, fields: list[str], body: str = "body") -> DataFrame:
    """uuid and the asked-for fields of each entry, as their JSON text; null where the entry has none. No field: no columns but uuid."""
    unknown = [f for f in fields if f not in EXTRA_FIELDS]
    if unknown:
        raise ValueError(f"no such fields: {unknown}")
    each = F.from_json(F.get_json_object(body, "$.threat_feeds"), "array<string>")
    e = pages.select(F.explode(each).alias("e"))
    return e.select(F.get_json_object("e", "$.uuid").alias("uuid"), *[F.get_json_object("e", f"$.{EXTRA_FIELDS[f]}").alias(f) for f in fields])


#: Keys that may wrap a list of prompts, and keys of a prompt's text, in the order in which they are tried.
WRAPPERS = ("data", "prompts", "vulnerabilities", "items", "results")
TEXT_KEYS = ("prompt", "text", "description", "content", "title", "body")


def prompts_of(body: str | None) -> list[str]:
    """Prompts of a JSON document in order, without white space around them and without blank ones; an error where it holds no list."""
    raw = json.loads(body or "null")
    if isinstance(raw, dict):
        raw = next((raw[k] for k in WRAPPERS if isinstance(raw.get(k), list)), None)
    if not isinstance(raw, list):
        raise ValueError(f"a list of prompts was expected, or an object that has one under {WRAPPERS}")
    texts = []
    for item in raw:
        if isinstance(item, dict):
            item = next((item[k] for k in TEXT_KEYS if isinstance(item.get(k), str) and item[k].strip()), None)
        if isinstance(item, str) and item.strip():
            texts.append(item.strip())
    return texts


def prompts(files: DataFrame, limit: int | None = None, name: str = "file", body: str = "body") -> DataFrame:
    """``text`` and ``place`` of the distinct prompts of files (name, body), in the order in which they come first: by file, then within it.

    limit: only the first so many.
    """
    listed = F.pandas_udf(lambda bodies: pd.Series([prompts_of(b) for b in bodies]), "array<string>")
    each = files.select(F.col(name).alias("__file"), F.posexplode(listed(F.col(body))).alias("__at", "text"))
    first = each.groupBy("text").agg(F.min(F.struct("__file", "__at")).alias("__first"))
    placed = numbered(first.select("text", "__first.*"), ["__file", "__at"]).select("text", "place")
    return placed if limit is None else placed.filter(F.col("place") < limit)


def read_prompts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """``text`` and ``place`` of the prompts of JSON files; a file that can't be read, or holds no list, is an error."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("body"))
    return prompts(files, limit)


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self):
        return [InputPartition(0)]  # a page says how many follow, so they are read one after another

    def fetch(self, page: int) -> str:
        o = self.options
        if "folder" in o:
            with open(f"{o['folder']}/{page}.json", encoding="utf-8") as f:
                return f.read()
        asked = {"page": page, "per_page": o.get("perpage", "100")} | ({"q[updated_at_gteq]": o["since"]} if "since" in o else {})
        request = urllib.request.Request(f"{o['url']}?{urllib.parse.urlencode(asked)}", headers={"Authorization": o["key"]} if "key" in o else {})
        with urllib.request.urlopen(request, timeout=60) as answer:
            return answer.read().decode()

    def read(self, partition):
        page, last = 1, 1
        while page <= last:
            if page > 1 and "url" in self.options:
                time.sleep(float(self.options.get("pause", "0.5")))
            body = self.fetch(page)
            last = int(json.loads(body).get("total_pages") or 0)
            yield (page, body)
            page += 1


class PagedFeed(DataSource):
    """``spark.read.format("paged_feed")``: (page, body) of all pages of a feed.

    Options: url of the service with key, since, perpage and pause, or folder,
    with recorded pages 1.json, 2.json, ... that every machine sees.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_feed"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(dict(self.options))


def read_feed(spark: SparkSession, **options: str) -> DataFrame:
    """Entries of all pages; options as of PagedFeed."""
    spark.dataSource.register(PagedFeed)
    return entries(spark.read.format("paged_feed").options(**options).load())


def read_vectors(spark: SparkSession, path: str, row: str) -> DataFrame:
    """Rows of a file of golden vectors: ``row`` is the DDL of an element of its list ``vectors``."""
    body = spark.read.text(path, wholetext=True).select(F.from_json("value", f"vectors array<struct<{row}>>", {"mode": "FAILFAST"}).alias("f"))
    return body.select(F.explode("f.vectors").alias("v")).select("v.*")
