"""Rules with fixed wording, from their definitions, on rows that hold the real strings."""

from pyspark.sql import functions as F

from sameword.functions import text as T
from sameword.operators import clusters, ingest, judge, synth

CAPTCHA = "Warning: This page maybe requiring CAPTCHA, please make sure you are authorized to access this page."
EDITORIAL = "Trusted Editorial content, reviewed by leading industry experts and seasoned editors."


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_noise_key(spark):
    got = column(spark, [f" {CAPTCHA}a b", f"a{EDITORIAL} b", "a bAd Disclosure", "Reference ID 0f-9z a b", "a b Advertisement", "Sponsored Content a b", "reference ID x a b", "Reference ID A a b", None], T.noise_key)
    assert got == ["a b", "a b", "a b", "a b", "a b Advertisement", "Sponsored Content a b", "reference ID x a b", "Reference ID A a b", None]


def test_broken_scrapes(spark):
    markers = ["Yahoo on osa", "Just a moment...", "Access to this page has been denied", "Target URL returned error", "Prices of cryptocurrencies", "Markdown Content: Before we continue"]
    others = ["Risk Disclosure", "Press & Hold to confirm you are a human", "just a moment...", ""]
    rows = spark.createDataFrame([(f"x {m} y",) for m in markers + others], "text string")
    assert {r.text.strip("xy ") for r in ingest.not_broken(rows).collect()} == {o.strip() for o in others}
    assert {r.text.strip("xy ") for r in ingest.not_broken(rows, markers=ingest.BROKEN_SHORT).collect()} == set(markers[3:]) | {o.strip() for o in others}


def test_merge_labels(spark):
    """Keys of 50 characters don't merge, but every row gets its label or identifier; 0 counts as none."""
    long, short = "l" * 51, "s" * 50
    rows = spark.createDataFrame([(1, long, None), (2, f"{long}Ad Disclosure", 7), (3, short, None), (4, short, 0), (5, short, 9), (6, "m" * 60, 8), (7, "m" * 60, None), (8, None, None)], "id long, text string, true_cluster_id long")
    got = {r.id: r.true_cluster_id for r in ingest.merge_labels(rows, T.noise_key(F.col("text")), "id").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 9, 6: 8, 7: 8, 8: 8}


def test_merge_later(spark):
    """Null labels are passed on, absent ones give the identifier, and rows with a null text stay."""
    rows = spark.createDataFrame([(1, "a", None, False), (2, "a", 5, False), (3, "b", None, True), (4, "b", 6, False), (5, None, 3, False), (6, None, 4, False), (7, "c", 2, False)], "id long, text string, true_cluster_id long, absent boolean")
    got = {r.id: r.true_cluster_id for r in ingest.merge_later(rows, T.noise_key(F.col("text")), "id", F.col("absent")).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3, 5: 3, 6: 3, 7: 2}


def test_dates(spark):
    given = {
        "Tue, 14 Nov 2023 10:00:00 +0000": "2023-11-14T10:00:00+00:00", "14 Nov 2023 10:00:00 -0530": "2023-11-14T10:00:00-05:30", "2024-01-02": "2024-01-02T00:00:00+00:00",
        "2024-01-02T03:04:05Z": "2024-01-02T03:04:05+00:00", "2024-01-02 03:04:05.25": "2024-01-02T03:04:05.250000+00:00", "2024-01-02T03:04:05+03:00": "2024-01-02T03:04:05+03:00",
        "Tuesday, November 14, 2023": "2023-11-14T00:00:00+00:00", "Nov 14, 2023 10:30": "2023-11-14T10:30:00+00:00", "2023/11/14": "2023-11-14T00:00:00+00:00", "11/14/2023": "2023-11-14T00:00:00+00:00",
        "Tue, 14 Nov 2023 10:00:00 GMT": "2023-11-14T10:00:00+00:00", "soon": "soon", "": "", "2024-13-45": "2024-13-45", None: None,
    }
    assert column(spark, list(given), T.fixed_date) == list(given.values())
    at = column(spark, ["14 Nov 2023 10:00:00 -0530", "soon"], lambda c: F.unix_seconds(T.flexible_date(c)))
    assert at == [1699975800, None]


def test_article_time(spark):
    got = column(spark, ["1700000000", "2024-01-01", "2024-01-01T00:00:00+01:00", "Mon, 01 Jan 2024 00:00:00 GMT", "2024", "2024-01", None], lambda c: F.unix_seconds(ingest.article_time(c)))
    assert got == [1700000000, 1704067200, 1704063600, None, 2024, None, None]


def test_mutation(spark):
    texts = ["one  two\tthree\nfour", "a b c", "  one two three four  ", "A b. C d! E f? G", "", None]
    got = column(spark, texts, lambda c: T.mutate(c, F.lit("k")))
    assert len(got[0].split(" ")) == 3 and set(got[0].split()) < {"one", "two", "three", "four"} and got[0] == " ".join(got[0].split())
    assert got[1] == "a b c" and got[2] == got[0]
    assert sorted(got[3].split(" ")) == sorted(texts[3].split(" ")) and got[4:] == ["", None]


def test_synthetic_copies(spark):
    rows = spark.createDataFrame([("1", "x", "T one two three four", "C one. Two.", "text", "2024-01-01T00:00:00Z"), ("a", None, "T", "", "text", "soon"), (None, "9", "T", None, "text", None)], "id string, _id string, title string, content string, text string, published_at string")
    got = {r.true_cluster_id: r for r in synth.synthetic_copies(rows, order="title").collect()}
    assert {k: r.id for k, r in got.items()} == {"1": "1000001", "a": "a_dup", "9": "1000009"} and all(r.source == "Synthetic" and r.text == "text" for r in got.values())
    assert got["1"].content == "Two. C one." or got["1"].content == "C one. Two." and len(got["1"].title.split()) == 4
    assert "2024-01-01T01:00:00+00:00" <= got["1"].published_at <= "2024-01-01T12:00:00+00:00" and got["a"].published_at == "soon"
    assert synth.synthetic_copies(rows.drop("content"), 1, "id").first().text == "text"
    toy = synth.toy_articles(spark).collect()
    assert [(r.id, r.true_cluster_id) for r in toy] == [("1", 1), ("2", 2), ("3", 3), ("4", 1), ("5", 1), ("6", 2), ("7", 2), ("8", 3), ("9", 3)]


def test_prompt(spark):
    pairs = spark.createDataFrame([(0, 5, "A" * 1501, "b"), (1, 6, "c", None)], "place long, pair_id long, text_a string, text_b string").na.fill("")
    got = judge.prompts(pairs).first()
    want = (
        "You will evaluate pairs of news articles. For each pair, answer exactly '1' if they are about the EXACT SAME EVENT (duplicates/rewrites), or '0' if they are about DIFFERENT events (or one is a broad summary and the other is a specific event). Do not output anything else except a JSON array of integers: [1, 0, ...]\n\n"
        + "--- PAIR 0 ---\nArticle A:\n" + "A" * 1500 + "...\n\nArticle B:\nb...\n\n--- PAIR 1 ---\nArticle A:\nc...\n\nArticle B:\n...\n\n"
        + "Output ONLY a valid JSON array of integers with exactly 2 elements. Example: [1, 0, 1]."
    )
    assert got.prompt == want


def test_judge_tries_again_and_goes_on(spark):
    waits, calls = [], iter([(429, None), OSError("down"), (200, "[1]")])

    def service(prompt):
        got = next(calls)
        if isinstance(got, Exception):
            raise got
        return got

    assert judge.ask(service, "?", sleep=waits.append) == "[1]" and waits == [5.0, 5.0]
    assert judge.ask(lambda p: (500, "x"), "?", tries=2, sleep=waits.append) is None
    pairs = spark.createDataFrame([(k, k, f"a{k}", "same" if k % 2 else "other") for k in range(12)], "place long, pair_id long, text_a string, text_b string")
    say = lambda p: (200, str([int("B:\nsame" in x) for x in p.split("--- PAIR")[1:]])) if "a11" not in p else (500, None)
    first = judge.judged(pairs, say, tries=1, wait=0.0)
    assert [r.llm_label for r in first.orderBy("place").collect()] == [k % 2 for k in range(10)] + [0, 0]
    part = first.withColumn("llm_label", F.when(F.col("place") != 3, F.col("llm_label")))
    again = judge.judged(part, lambda p: (200, "1 " * p.count("--- PAIR")) if "a11" not in p else (500, None), tries=1, wait=0.0)
    assert [r.llm_label for r in again.orderBy("place").collect()] == [1] * 10 + [0, 0]  # the batch that lacked one, whole


def test_expert_pairs_are_natural_and_numbered(spark):
    """Synthetic identifiers are in no pair, positives come first, and texts are the articles' own."""
    ids = [str(i) for i in range(8)] + ["1000001", "5_dup", "x"]
    articles = spark.createDataFrame([(k, i, f"title {i}", f"text {i}") for k, i in enumerate(ids)], "n long, id string, title string, text string")
    assigned = spark.createDataFrame([(i, "c0" if i in ("0", "1", "2", "1000001", "5_dup") else "c1" if i in ("3", "x") else i) for i in ids], "id string, cluster_id string")
    got = clusters.expert_pairs(assigned, articles, "n").orderBy("pair_id").collect()
    positive = {(r.news_id_a, r.news_id_b) for r in got if r.algorithmic_label == 1}
    assert positive == {("0", "1"), ("0", "2"), ("1", "2"), ("3", "x")} and [r.pair_id for r in got] == list(range(len(got)))
    assert [r.algorithmic_label for r in got] == [1] * 4 + [0] * (len(got) - 4) and sorted(r.place for r in got) == list(range(len(got)))
    home = {r.id: r.cluster_id for r in assigned.collect()}
    assert all(home[r.news_id_a] != home[r.news_id_b] and "1000001" not in (r.news_id_a, r.news_id_b) for r in got[4:]) and len(got) > 4
    assert all(r.text_a == f"TITLE: title {r.news_id_a}\n\nCONTENT:\ntext {r.news_id_a}" for r in got)
    assert clusters.expert_pairs(assigned, articles, "n", most=2).count() == 4
