import json

from pyspark.sql import functions as F

from sameword import cli
from sameword.config import DedupConfig
from sameword.functions import text as T
from sameword.operators import clusters, graph, ingest, sketch, windowed
from sameword.plans.pipeline import TRIGRAMS, DedupPipeline, Scorer, load, prepare, scores
from sameword.shared import clear, own_dir
from sameword.sources import crawl, readers
from sameword.sources.html import main_text
from sameword.sources.seen import SeenKeys

ROW = {"id": 1, "title": "t", "text": "x", "source": "s", "published_at": "2024-01-01T00:00:00", "true_cluster_id": None, "url": "u"}


def test_arrays_lines_and_missing_files(spark, tmp_path):
    rows = [ROW | {"id": i, "text": f"line\n{i}"} for i in (3, 1, 2)]
    (tmp_path / "array.json").write_text("\n " + json.dumps(rows, indent=2))
    (tmp_path / "lines.json").write_text("\n\n" + "\n\n".join(map(json.dumps, rows)) + "\n")
    for name in ("array.json", "lines.json"):
        got = readers.read_articles(spark, str(tmp_path / name)).orderBy("_pos").collect()
        assert [(r.id, r.text) for r in got] == [(str(r["id"]), r["text"]) for r in rows]
    assert readers.read_articles(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{not json")
    assert readers.read_or_warn(spark, [str(tmp_path / n) for n in ("array.json", "bad.json", "none.json")]).count() == 3
    # the limit takes the files' first rows, before validation, and halves although the second file is missing
    (tmp_path / "mixed.json").write_text(json.dumps([ROW | {"title": None}, *rows]))
    cfg = DedupConfig(limit=5)
    assert [r.id for r in load(spark, str(tmp_path / "mixed.json"), str(tmp_path / "none.json"), cfg).collect()] == ["3"]
    assert sorted(r.id for r in load(spark, str(tmp_path / "mixed.json"), None, cfg).collect()) == ["1", "2", "3"]


def test_boilerplate_file(spark, tmp_path):
    (tmp_path / "lines.json").write_text(json.dumps(["a line of sixteen", "short", "sixteen letters!"]))
    (tmp_path / "odd.json").write_text('{"a": 1')
    assert readers.read_boilerplate(spark, str(tmp_path / "lines.json")).count() == 3
    assert readers.read_boilerplate(spark, str(tmp_path / "none.json")).count() == 0 == readers.read_boilerplate(spark, str(tmp_path / "odd.json")).count()
    a = spark.createDataFrame([("1", "t", "keep\n  a line of sixteen \nshort\nend"), ("2", "a line of sixteen", "a line of sixteen"), ("3", "", "")], "id string, title string, text string")
    got = {r.id: r.clean_text for r in prepare(a, DedupConfig(boilerplate_path=str(tmp_path / "lines.json"))).collect()}
    assert got == {"1": "t keep short end", "2": "", "3": ""}


def test_sinks(spark, tmp_path):
    articles = spark.createDataFrame([("a", "2024-01-02", "ü"), ("b", "2024-01-01", "y"), ("c", "2024-01-01", "z")], "id string, at string, text string").withColumn("published_at", F.col("at").cast("timestamp"))
    assigned = spark.createDataFrame([("a", "k"), ("b", "k"), ("c", "c")], "id string, cluster_id string")
    readers.write_clusters(clusters.cluster_rows(assigned, articles), str(tmp_path / "clusters"))
    lines = [json.loads(x) for p in (tmp_path / "clusters").glob("*.json") for x in p.read_text().splitlines()]
    assert sorted(lines, key=str) == sorted([{"cluster_id": "k", "canonical_news_id": "b", "news_ids": ["a", "b"]}, {"cluster_id": "c", "canonical_news_id": "c", "news_ids": ["c"]}], key=str)
    readers.write_canonical(assigned, articles, str(tmp_path / "canonical"))
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "canonical")).collect()) == ["b", "c"]
    articles.write.parquet(str(tmp_path / "t"))
    for _ in range(2):
        readers.rewrite(spark, str(tmp_path / "t"), lambda rows: rows.withColumn("text", F.concat("text", F.lit("!"))))
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["y!!", "z!!", "ü!!"]


PAGE = "<html><head><title>x</title></head><body><nav>menu</nav><article><h1>{0}</h1><p>{1} &amp; more</p><!-- c --><script>s()</script></article></body></html>"


LONG = "A sentence with some words, and a comma, so that it counts as one. "
#: Pages and their texts, a paragraph a line.
PAGES = [
    (PAGE.format("Head", "Body"), "Head\nBody & more"),
    ("<p>no article <b>here</b></p><table><tr><td>cell</td></tr></table>", "no article here"),
    ("", ""),
    (None, None),
    ("<article>a<style>x{}</style>\n\n b</article>", "a b"),
    (f"<article><p>{LONG}</p><article><p>{LONG * 4}</p></article><p>tail text</p></article>", f"{LONG.strip()}\n{(LONG * 4).strip()}\ntail text"),
    ("<p>&mdash; caf&eacute; &#8212; &#x20AC; &nbsp;&lt;b&gt; &amp;amp; &copy 5", "\u2014 caf\u00e9 \u2014 \u20ac <b> &amp; \u00a9 5"),
    (f"<body><div><p>{LONG}<p>{LONG}<div class=x>{LONG}</body>", "\n".join([LONG.strip()] * 3)),
    (f"<div><ul><li><a href=/1>{LONG}</a></li><li><a href=/2>{LONG}</a></li></ul></div><div><p>{LONG}</p></div>", LONG.strip()),
    (f"<nav><p>{LONG * 9}</p></nav><header>h</header><main><h1>T</h1><p>{LONG}</p></main><footer>{LONG}</footer>", f"T\n{LONG.strip()}"),
    (f"<section><p>{LONG}</p></section><section><p>{LONG}</p></section><section><p>{LONG}</p></section>", "\n".join([LONG.strip()] * 3)),
    (f"<div>{LONG}<br>{LONG}<br/>end</div>", f"{LONG.strip()}\n{LONG.strip()}\nend"),
    ("<script>var t='<p>x</p>'</script><!-- <p>c</p> --><p>seen</p>", "seen"),
    (f"</div></p><div><p>{LONG}</span></b></p></div></article>", LONG.strip()),
    (f"<article><h1>T</h1><form><p>{LONG}</p></form><blockquote><p>{LONG}</p></blockquote><ol><li>one<li>two</ol></article>", f"T\n{LONG.strip()}\none\ntwo"),
    (f"<div><div><div><p>{LONG}</p><p>{LONG}</p></div></div><div><a href=/>{LONG}</a></div></div>", "\n".join([LONG.strip()] * 2)),
    ("<p>one\n two\t three</p>four<p>five", "one two three\nfour\nfive"),
    (f"<article><p>{LONG}<a href=/x>link</a> after</p><ul><li><a href=/>more of this kind</a></li></ul></article>", f"{LONG}link after"),
    ("<div>" * 3000 + LONG, LONG.strip()),
    ("<p>a < b and c > d</p><", "a < b and c > d\n<"),
]


def test_main_text(spark):
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(PAGES)], "i int, html string")
    got = {r.i: r.t for r in rows.select("i", main_text(F.col("html")).alias("t")).collect()}
    assert [got[i] for i in range(len(PAGES))] == [t for _, t in PAGES]


def test_feeds_and_home_pages(spark):
    rss = "<rss><channel><item><title>T</title><link>http://a/1</link><pubDate>d</pubDate></item><item><title>no link</title></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>U</title><link rel="alternate" href="http://b/2"/><updated>e</updated></entry></feed>'
    web = {"f1": (200, rss), "f2": (200, atom), "f3": (200, "<not xml"), "f4": (404, rss)}
    feeds = spark.createDataFrame([(n.upper(), n) for n in [*web, "f5"]], "name string, url string")
    got = sorted(map(tuple, crawl.read_feeds(feeds, lambda u: web[u]).collect()))
    assert got == [("http://a/1", "T", "d", "F1"), ("http://b/2", "U", "e", "F2")]
    home = '<a href="/news/a-long-title">x</a><a href="/about">y</a><a href="/2024#top">z</a><a href="http://other.ru/news/x-y-z">o</a><a>n</a>'
    pages = crawl.read_homepages(spark.createDataFrame([("https://site.ru/",)], "url string"), lambda u: (200, home))
    assert sorted((r.url, r.source, r.lang, r.title) for r in pages.collect()) == [("https://site.ru/2024", "site.ru", "ru", ""), ("https://site.ru/news/a-long-title", "site.ru", "ru", "")]


def test_crawl_goes_on_to_its_target(spark, tmp_path):
    body = lambda i: PAGE.format(f"Title {i}", f"words of page {i} " * 20)
    web = {f"http://h{i % 3}/{i}": (200, body(i if i != 7 else 6)) for i in range(20)} | {"http://h0/3": (500, ""), "http://h1/4": (200, "<p>short</p>")}

    def fetch(url):
        return web[url]

    rows = spark.createDataFrame([(u, "t", None, "s") for u in [*web, *list(web)[:5], "http://gone/"]], crawl.CANDIDATE)
    path = str(tmp_path / "articles")
    first = crawl.crawl(rows, fetch, path, target=8, batch=6)
    assert first["articles"] == 8 and crawl.collected(spark, path).count() == 8
    done = crawl.crawl(rows, fetch, path, target=100, batch=6)
    got = crawl.collected(spark, path).collect()
    assert done["articles"] == len(got) == 17 and sorted(r.id for r in got) == list(range(1, 18))
    assert len({r.url for r in got}) == 17 == len({r.text_hash for r in got}) and all(r.true_cluster_id is None for r in got)
    again = crawl.crawl(rows, fetch, path, target=100)
    assert again == {"articles": 17, "errors": 3, "duplicates": 1}


def test_an_index_of_seen_keys(spark, tmp_path):
    seen = SeenKeys(spark, str(tmp_path / "seen"))
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k string")
    assert [r.k for r in seen.unseen(keys("a", None), "k").collect()] == ["a", None]
    for b in range(3):
        seen.add(keys(*[f"{b}-{i}" for i in range(3000)], None, f"{b}-0"))
    rows = keys(*[f"{b}-{i}" for b in range(4) for i in range(0, 6000, 1000)], None, "new", "new").withColumn("key", F.lit(1))
    got = seen.unseen(rows, "k")
    want = sorted([f"{b}-{i}" for b in range(4) for i in range(0, 6000, 1000) if b == 3 or i >= 3000] + ["", "new", "new"])
    assert got.columns == ["k", "key"] and sorted(r.k or "" for r in got.collect()) == want
    assert seen.possible(spark.createDataFrame([(f"x{i}",) for i in range(3000)], "key string")).count() < 60  # so little is read of what is stored
    seen.add(keys("9"), 2)  # a batch again takes its own place
    assert seen.known(keys("2-1", "9", "1-1")).count() == 2 and len(seen.batches()) == 3
    seen.catch_up(keys("2-1", "9"))
    assert seen.known(keys("2-1", "9")).count() == 2 and len(seen.batches()) == 4
    seen.catch_up(keys("2-1", "9"))
    assert len(seen.batches()) == 4


def test_target_and_permutation(spark):
    rows = spark.range(20)
    assert [r.id for r in ingest.up_to(rows, 15, 18, "id").collect()] == [0, 1, 2] and ingest.up_to(rows, 9, 3, "id").count() == 0
    a, b = ([r.id for r in ingest.shuffled(rows.repartition(n), "id").collect()] for n in (1, 5))
    assert a == b and sorted(a) == list(range(20)) and a != list(range(20))


def wordy(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [("1", " ".join(words)), ("2", " ".join([*words[:-1], "other"])), ("3", " ".join(f"v{i}" for i in range(60))), ("4", " ".join(words))]
    return spark.createDataFrame(rows, "id string, text string").withColumns({"title": F.lit("t"), "source": F.lit("s"), "published_at": F.lit("2024-01-01").cast("timestamp")})


def test_scores_and_vectors_are_kept(spark, tmp_path):
    """What a second run finds in the caches isn't worked out again; a cache that was cut short is filled up."""
    pairs = spark.createDataFrame([("1", "2", "a b c", "a b d"), ("3", "4", "a b c", "x y z"), ("5", "6", "a b c", "a b d")], "id_a string, id_b string, ta string, tb string")
    pairs = pairs.select("id_a", "id_b", *[TRIGRAMS.features(F.col(f"t{x}")).alias(f"f{x}") for x in "ab"], *[F.sha2(f"t{x}", 256).alias(f"key_{x}") for x in "ab"])
    nine = Scorer(lambda t: t, lambda a, b: F.lit(9.0))
    path, n = str(tmp_path / "scores"), lambda: spark.read.parquet(path).count()
    want = {(r.id_a, r.logit) for r in scores(pairs, TRIGRAMS, None, "m").collect()}
    scores(pairs.limit(1), TRIGRAMS, path, "m").collect()
    assert n() == 1
    assert {(r.id_a, r.logit) for r in scores(pairs, TRIGRAMS, path, "m").collect()} == want and n() == 2
    assert {r.logit for r in scores(pairs, nine, path, "m").collect()} == {x for _, x in want}
    assert {r.logit for r in scores(pairs, nine, path, "other").collect()} == {9.0}
    cfg = DedupConfig(num_perm=16, threshold=0.9, vector_cache=str(tmp_path / "v"), score_cache=str(tmp_path / "s"), minhash_threshold=0.0)
    run = lambda p: sorted(tuple(r.news_ids) for r in p.run(wordy(spark))["clusters"].collect())
    assert run(DedupPipeline(cfg)) == [("1", "2", "4"), ("3",)]
    kept = spark.read.parquet(cfg.vector_cache)
    assert kept.count() == 3 and kept.schema["v"].dataType.simpleString() == "array<float>"
    asked = []
    assert run(DedupPipeline(cfg, embed=lambda rows: asked.append(rows.count()) or windowed.hashed_vectors(rows, "id", T.tokens(F.col("clean_text"))))) == [("1", "2", "4"), ("3",)]
    assert asked == [0]


def test_another_clusterer(spark):
    def parts(nodes, edges, resolution):
        return nodes.select("id", F.lit("all").alias("community"))

    assert [tuple(r.news_ids) for r in DedupPipeline(DedupConfig(num_perm=16), clusterer=parts).run(wordy(spark))["clusters"].collect()] == [("1", "2", "3", "4")]


def test_command_line(spark, tmp_path):
    rows = [{**r.asDict(), "published_at": r.published_at.isoformat(), "true_cluster_id": 1 if r.id in "124" else None} for r in wordy(spark).collect()]
    (tmp_path / "in.json").write_text(json.dumps(rows))
    args = ["--input", str(tmp_path / "in.json"), "--threshold", "0.9", "--minhash_threshold", "0.5", "--output", str(tmp_path / "kept"), "--clusters_output", str(tmp_path / "clusters")]
    done = cli.run(spark, cli.parser().parse_args([*args, "--reranker_path", "Disabled"]))
    assert {r.score for r in done["approved"].collect()} == {1.0}
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "kept")).collect()) == ["1", "3"]
    assert [(r["size"], r.canonical_news_id) for r in cli.top_clusters(done["clusters"], wordy(spark)).collect()] == [(3, "1"), (1, "3")]
    (tmp_path / "none.json").write_text("[]")
    out = tmp_path / "nothing"
    assert cli.run(spark, cli.parser().parse_args(["--input", str(tmp_path / "none.json"), "--output", str(out), "--clusters_output", str(out)])) is None and not out.exists()


def test_signatures_against_their_definition(spark):
    import hashlib

    texts = ["a b c a", "", "größe", " ".join(f"w{i}" for i in range(40_000)), "b a c"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").coalesce(1)
    got = {r.id: r.sig for r in sketch.signatures(rows, "id", T.tokens(F.col("text")), 8).collect()}
    for i, t in enumerate(texts):
        h = [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in set(t.split())]
        assert got[i] == [min(((a * x + b) % sketch.PRIME for x in h), default=sketch.PRIME) for a, b in sketch.coefficients(8)]
    assert got[0] == got[4]


def test_cosine_pairs_against_every_pair(spark):
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(f"{i}", int(r.integers(0, 12 * 86400)), r.normal(size=4).tolist()) for i in range(150)] + [(f"same{i}", 5000, [1.0, 0.0, 0.0, 0.0]) for i in range(40)] + [("null", 1, None), ("short", 1, [1.0])]
    t = spark.createDataFrame(rows, "id string, s long, v array<double>").withColumn("t", F.timestamp_seconds("s"))
    want = {(a, b) for a, s, v in rows for b, u, w in rows if v and w and len(v) == len(w) and (s, a) < (u, b) and u - s < 3 * 86400 and np.dot(v, w) >= 0.8}
    for block in (7, 512):
        got = [(x.id_a, x.id_b) for x in windowed.cosine_pairs(t, "id", "t", "v", 2, 0.8, block).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_copies_never_meet_each_other(spark):
    """Equal sets are a representative and its copies: 199 rows, not 19 900 pairs."""
    rows = spark.createDataFrame([(f"{i:03d}", "a b c d e f g h") for i in range(200)] + [("x", "a b c d e f g"), ("y", ""), ("z", "")], "id string, text string").withColumn("w", T.tokens(F.col("text")))
    got = {(r.id_a, r.id_b): r.jaccard for r in sketch.jaccard_pairs(rows, "id", "w", 0.7).collect()}
    assert got == {("000", f"{i:03d}"): 1.0 for i in range(1, 200)} | {("000", "x"): 0.875}
    sig = sketch.signatures(rows, "id", F.col("w"), 128)
    found = {(r.id_a, r.id_b) for r in sketch.band_candidates(sig, "id").collect()}
    assert {(a, b) for a, b in found if a != "000"} <= {("y", "z")} and len(found) >= 200


def test_louvain_invariants(spark):
    """Communities cover the vertices, lie within components, and don't depend on partitions."""
    import random

    r = random.Random(6)
    edges = [(f"{g}-{a}", f"{g}-{b}", r.random()) for g in range(6) for a in range(9) for b in range(a) if r.random() < 0.45]
    v = spark.createDataFrame([(f"{g}-{a}",) for g in range(6) for a in range(9)], "id string")
    e = spark.createDataFrame(edges, "id_a string, id_b string, score double")
    runs = [{x.id: x.community for x in graph.louvain(v.repartition(n), e.repartition(n)).collect()} for n in (1, 4)]
    assert runs[0] == runs[1] and set(runs[0]) == {x.id for x in v.collect()}
    whole = {x.id: x.component for x in graph.connected_components(e, "id_a", "id_b").collect()}
    assert all(whole.get(i, i) == whole.get(c, c) for i, c in runs[0].items())
    m = sum(w for *_, w in edges)
    degree = {}
    for a, b, w in edges:
        degree[a], degree[b] = degree.get(a, 0) + w, degree.get(b, 0) + w

    def modularity(home):
        inside, total = sum(w for a, b, w in edges if home[a] == home[b]), {}
        for i, d in degree.items():
            total[home[i]] = total.get(home[i], 0) + d
        return inside / m - sum(d * d for d in total.values()) / (4 * m * m)

    assert modularity(runs[0]) >= max(modularity({i: i for i in degree}), modularity(whole))


def test_staged_tables_can_be_cleared(spark):
    import os

    e = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long")
    assert graph.connected_components(e).where("component = 0").count() == 31
    at = own_dir(spark).removeprefix("file:")
    assert len([x for x in os.listdir(at) if x.startswith("cc-")]) >= 1
    clear(spark)
    assert not os.path.exists(at)
