"""Feeds and home pages as sources of tables and streams."""

import json
import time

import pytest

from sameword.sources import feeds


def rss(*links):
    return "<rss><channel>" + "".join(f"<item><title>T {x}</title><link>{x}</link><pubDate>d</pubDate></item>" for x in links) + "</channel></rss>"


@pytest.fixture
def web(spark, tmp_path, monkeypatch):
    feeds.register(spark)
    return tmp_path


def options(web, *names):
    return {"feeds": json.dumps([[n.upper(), f"file://{web}/{n}"] for n in names])}


def test_a_partition_for_each_feed(spark, web):
    (web / "a").write_text(rss("http://x/1", "http://x/2"))
    (web / "b").write_text(rss("http://y/1"))
    (web / "broken").write_text("<rss")
    rows = spark.read.format("feeds").options(**options(web, "a", "b", "broken", "gone")).load()
    assert sorted(map(tuple, rows.collect())) == [("http://x/1", "T http://x/1", "d", "A"), ("http://x/2", "T http://x/2", "d", "A"), ("http://y/1", "T http://y/1", "d", "B")]
    assert rows.rdd.getNumPartitions() == 4
    assert spark.read.format("feeds").option("feeds", "[]").load().count() == 0


def test_home_pages(spark, web):
    (web / "index.html").write_text('<a href="/news/a-long-title">x</a><a href="/about">y</a>')
    pages = json.dumps([["site", f"file://{web}/index.html"], "file:///no/such/page"])
    assert spark.read.format("homepages").option("pages", pages).load().count() == 0  # no address of http
    assert feeds.article_links('<a href="/news/a-long-title">x</a>', "https://s.org/") == ["https://s.org/news/a-long-title"]
    got = list(feeds.links(feeds.Feed("s", "https://s.org/"), lambda u: (200, '<a href="/news/a-long-title">x</a>')))
    assert got == [("https://s.org/news/a-long-title", "", None, "s")]


def test_a_missing_option_is_named(spark, web):
    with pytest.raises(Exception, match="the option feeds"):
        spark.read.format("feeds").load().collect()


def polled(spark, web, target, polls):
    """Run the stream until it has polled so many times, then stop it."""
    query = feeds.read_new(spark, "feeds", **options(web, "a", "b")).writeStream.format("parquet").option("path", str(target / "out")).option("checkpointLocation", str(target / "c")).trigger(processingTime="0 seconds").start()
    began = time.time()
    while len([p for p in query.recentProgress if p.numInputRows > 0]) < polls and time.time() - began < 120:
        time.sleep(0.2)
    query.stop()
    return sorted(r.url for r in spark.read.parquet(str(target / "out")).collect())


def test_a_stream_brings_each_address_once_and_goes_on_after_a_restart(spark, web, tmp_path_factory):
    target = tmp_path_factory.mktemp("stream")
    (web / "a").write_text(rss("http://x/1", "http://x/2"))
    (web / "b").write_text(rss("http://y/1", "http://x/2"))
    assert polled(spark, web, target, 2) == ["http://x/1", "http://x/2", "http://y/1"]
    (web / "a").write_text(rss("http://x/2", "http://x/3"))
    assert polled(spark, web, target, 2) == ["http://x/1", "http://x/2", "http://x/3", "http://y/1"]
