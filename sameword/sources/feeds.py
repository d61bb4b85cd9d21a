"""IO13, IO14 as Spark sources: spark.read.format("feeds") and format("homepages"), and the same as streams.

    register(spark)
    spark.read.format("feeds").option("feeds", json.dumps([["name", "https://..."], ...])).load()
    read_new(spark, "feeds", feeds=json.dumps(...), fetch="package.module:function")

Each feed or page is a partition, fetched and parsed on an executor. The network is a function named by the option `fetch`,
"module:function", from an address to (status, body); without it, addresses that urllib opens are fetched. A feed that
fails, or can't be parsed, has no rows.

A stream polls every feed once in each micro-batch: its offset is the number of polls. What a poll brings again is for the
stream's state to drop, which read_new() does by address; a query that starts again with its checkpoint repeats nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import import_module
from urllib.error import HTTPError
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from sameword.sources.crawl import CANDIDATE, Fetch, article_links, body_of, feed_entries

#: Seconds that an address may take.
TIMEOUT = 10


def fetch_url(url: str) -> tuple[int, str]:
    try:
        with urlopen(url, timeout=TIMEOUT) as reply:  # noqa: S310  what the caller lists is fetched
            return getattr(reply, "status", None) or 200, reply.read().decode("utf-8", "replace")
    except HTTPError as e:
        return e.code, ""


def fetcher(name: str | None) -> Fetch:
    if not name:
        return fetch_url
    module, _, function = name.partition(":")
    return getattr(import_module(module), function)


@dataclass
class Feed(InputPartition):
    name: str
    url: str


def entries(feed: Feed, fetch: Fetch) -> Iterator[tuple]:
    yield from feed_entries(body_of(fetch, feed.url), feed.name)


def links(page: Feed, fetch: Fetch) -> Iterator[tuple]:
    for url in article_links(body_of(fetch, page.url), page.url):
        yield url, "", None, page.name


class Reader(DataSourceReader):
    def __init__(self, feeds: list[Feed], rows, fetch: str | None):
        self.feeds, self.rows, self.fetch = feeds, rows, fetch

    def partitions(self) -> list[Feed]:
        return self.feeds

    def read(self, partition: Feed | None) -> Iterator[tuple]:
        """An empty list of feeds is one partition that is None."""
        return iter(()) if partition is None else self.rows(partition, fetcher(self.fetch))


class Polls(DataSourceStreamReader):
    """A poll of every feed for each micro-batch."""

    def __init__(self, feeds: list[Feed], rows, fetch: str | None):
        self.feeds, self.rows, self.fetch, self.polls = feeds, rows, fetch, 0

    def initialOffset(self) -> dict:
        return {"polls": 0}

    def latestOffset(self) -> dict:
        self.polls += 1
        return {"polls": self.polls}

    def partitions(self, start: dict, end: dict) -> list[Feed]:
        self.polls = max(self.polls, end["polls"])  # after a restart
        return self.feeds if end["polls"] > start["polls"] else []

    def read(self, partition: Feed | None) -> Iterator[tuple]:
        return iter(()) if partition is None else self.rows(partition, fetcher(self.fetch))

    def commit(self, end: dict) -> None:
        pass


class Feeds(DataSource):
    """Options: feeds, a JSON array of [name, address]; fetch."""

    rows = staticmethod(entries)
    option = "feeds"

    @classmethod
    def name(cls) -> str:
        return "feeds"

    def schema(self) -> str:
        return CANDIDATE

    def listed(self) -> list[Feed]:
        if self.option not in self.options:
            raise ValueError(f"the option {self.option} lists what to read, as a JSON array")
        return [Feed(*x) if isinstance(x, list) else Feed(x, x) for x in json.loads(self.options[self.option])]

    def reader(self, schema) -> Reader:
        return Reader(self.listed(), self.rows, self.options.get("fetch"))

    def streamReader(self, schema) -> Polls:
        return Polls(self.listed(), self.rows, self.options.get("fetch"))


class Homepages(Feeds):
    """Options: pages, a JSON array of addresses, or of [name, address]; fetch. Titles are empty and dates null."""

    rows = staticmethod(links)
    option = "pages"

    @classmethod
    def name(cls) -> str:
        return "homepages"


def register(spark: SparkSession) -> None:
    for source in (Feeds, Homepages):
        spark.dataSource.register(source)


def read_new(spark: SparkSession, source: str, **options: str) -> DataFrame:
    """A stream of candidates, each address once, the first time that a poll brings it."""
    register(spark)
    return spark.readStream.format(source).options(**options).load().dropDuplicates(["url"])
