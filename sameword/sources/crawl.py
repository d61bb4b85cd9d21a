"""Acquisition: feeds, home pages, fetching, and a crawl that goes on where it stopped (IO13-IO15, IO17, IO18, FI4, FI6,
FI13, SA3, AG8, AG17, PR29).

The network is a function the caller gives: from an address, (status, body). It runs on executors, once for each address.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.functions import text as T
from sameword.operators import ingest
from sameword.shared import stage
from sameword.sources.html import main_text
from sameword.sources.readers import missing
from sameword.sources.seen import SeenKeys

Fetch = Callable[[str], tuple[int, str]]
CANDIDATE = "url string, title string, published_at string, source string"
ARTICLE = "id long, url string, title string, text string, source string, published_at string, text_hash string, true_cluster_id long"


def body_of(fetch: Fetch, url: str) -> str | None:
    """IO15: null for any status but 200, and for any error."""
    try:
        status, body = fetch(url)
    except Exception:  # noqa: BLE001
        return None
    return body if status == 200 else None


def feed_entries(xml: str | None, feed: str) -> list[tuple[str, str, str, str]]:
    """IO13: (link, title, published or else updated, feed) of RSS items and Atom entries with a link; none where the text
    can't be parsed."""
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return []
    out = []
    for node in root.iter():
        if node.tag.rpartition("}")[2] not in ("item", "entry"):
            continue
        found: dict[str, str] = {}
        for child in node:
            name = child.tag.rpartition("}")[2].lower()
            value = (child.text or "").strip() or (child.get("href", "") if name == "link" else "")
            if value and not (name == "link" and child.get("rel", "alternate") != "alternate"):
                found.setdefault(name, value)
        if found.get("link"):
            date = next((found[k] for k in ("pubdate", "published", "date", "updated") if k in found), "")
            out.append((found["link"], found.get("title", ""), date, feed))
    return out


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and (href := dict(attrs).get("href")):
            self.found.append(href)


def article_links(html: str | None, home: str) -> list[str]:
    """IO14: addresses of a home page's own site that look like articles: a path of two parts or more, or one with a number
    or several words in it."""
    parser = Links()
    parser.feed(html or "")
    out: dict[str, None] = {}
    for href in parser.found:
        url = urlsplit(urljoin(home, href))
        last = url.path.rstrip("/").rpartition("/")[2]
        if url.scheme in ("http", "https") and url.netloc == urlsplit(home).netloc and (url.path.rstrip("/").count("/") > 1 or any(c.isdigit() for c in last) or last.count("-") > 1):
            out.setdefault(url._replace(fragment="").geturl())
    return list(out)


def read_feeds(feeds: DataFrame, fetch: Fetch) -> DataFrame:
    """Candidates of feeds (name, url); a feed that fails has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [e for name, url in zip(*(batch.column(k).to_pylist() for k in (0, 1)), strict=True) for e in feed_entries(body_of(fetch, url), name)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["url", "title", "published_at", "source"])

    return feeds.select("name", "url").mapInArrow(run, CANDIDATE)


def read_homepages(homes: DataFrame, fetch: Fetch) -> DataFrame:
    """Candidates of home pages (url), without title and date; source is the site, lang follows IO14's rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for home in batch.column(0).to_pylist() for x in article_links(body_of(fetch, home), home)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], ["url"])

    found = homes.select("url").mapInArrow(run, "url string")
    site = T.netloc(F.col("url"))
    return found.select("url", F.lit("").alias("title"), F.lit(None).cast("string").alias("published_at"), site.alias("source"), T.site_language(site).alias("lang"))


def fetched(candidates: DataFrame, fetch: Fetch) -> DataFrame:
    """candidates with html, null where there is none. Addresses are dealt out by hash, so that a site's are spread (SA3)."""
    columns = candidates.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            html = [body_of(fetch, url) for url in batch.column(columns.index("url")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(html, pa.string())], [*columns, "html"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in candidates.schema) + ", html string"
    return candidates.repartition(F.xxhash64("url")).mapInArrow(run, schema)


def collected(spark: SparkSession, path: str) -> DataFrame:
    """IO17: the articles a crawl has so far, none where it has not begun."""
    try:
        return spark.read.schema(ARTICLE).parquet(path)
    except AnalysisException as e:
        if not missing(e):
            raise
        return spark.createDataFrame([], ARTICLE)


def crawl(candidates: DataFrame, fetch: Fetch, path: str, target: int, batch: int = 10_000, least: int = 100) -> dict[str, int]:
    """Fetch candidates that the table at path lacks, in batches of about `batch`, until it has `target` articles. After
    every batch its new articles are appended (IO18), so that a crawl that stops loses one batch at most. Returns counts:
    articles, errors (no text, or one too short), duplicates.

    An address is fetched once, the one with the least (title, date) of its rows; a text that is there already, by its
    hash, is not taken; of equal texts in a batch the least address stays. The table is read when the crawl begins; after
    that, batches ask an index of hashes beside it (path with -seen)."""
    spark = candidates.sparkSession
    rows = candidates.select("url", "title", "published_at", "source").where("url is not null and url <> ''")
    fresh = ingest.unseen(rows, collected(spark, path), "url").groupBy("url").agg(F.min(F.struct("title", "published_at", "source")).alias("r")).select("url", "r.*")
    fresh = stage(fresh, "crawl-candidates")
    parts = max(1, -(-fresh.count() // batch))
    seen = SeenKeys(spark, f"{path.rstrip('/')}-seen")
    seen.catch_up(collected(spark, path).select("text_hash"))
    out = {"articles": collected(spark, path).count(), "errors": 0, "duplicates": 0}
    for k in range(parts):
        if out["articles"] >= target:
            break
        got = stage(fetched(fresh.where(F.pmod(F.xxhash64("url"), F.lit(parts)) == k), fetch).withColumn("text", main_text(F.col("html"))).drop("html"), "crawl-pages")
        good = ingest.long_enough(got, least=least).withColumn("text_hash", T.text_hash(F.col("text")))
        new = ingest.keep_first(seen.unseen(good, "text_hash"), F.col("text_hash"), "url")
        tried, fine = got.count(), good.count()
        new = stage(ingest.dense_ids(ingest.up_to(new, out["articles"], target, "url"), "url", out["articles"]), "crawl-new")
        added = new.count()
        new.select(F.col("new_id").cast("long").alias("id"), "url", "title", "text", "source", "published_at", "text_hash", F.lit(None).cast("long").alias("true_cluster_id")).write.mode("append").parquet(path)
        seen.add(new.select("text_hash"))
        out = {"articles": out["articles"] + added, "errors": out["errors"] + tried - fine, "duplicates": out["duplicates"] + fine - added}
    return out
