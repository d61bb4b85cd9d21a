"""Registered queries of the reference operators and their DuckDB SQL, over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sameword.config import BAD_PHRASES, DedupConfig
from sameword.functions import text as T
from sameword.operators import clusters, graph, ingest, judge, sketch, windowed
from sameword.plans.pipeline import DedupPipeline, rerank, sweep_blocks
from sameword.shared import fresh_path, stage, staged_at
from sameword.sources.html import main_text
from sameword.sources.readers import read_articles
from sameword.sources.seen import SeenKeys
from sameword.streaming.ingest import NearDuplicates, deduplicate_stream

QUERIES: dict = {}
SQL: dict = {}

#: SQL that stands before every query's own.
TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
SQUEEZE = r"trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g'))"
ART = r"""art AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS text, source,
  CASE WHEN left(split_part(coalesce(text, ''), '. ', 1), 100) <> '' THEN left(split_part(coalesce(text, ''), '. ', 1), 100) || '...' ELSE 'News Article' END AS title,
  TIMESTAMP '2024-01-01' + ((doc_id * 7919) % 43200) * INTERVAL 1 MINUTE AS published_at FROM documents)"""
# Fixed values, as texts of the oracle.
KEY = r"""regexp_replace(replace(replace(replace(regexp_replace(text, 'Reference ID [a-z0-9-]+', '', 'g'),
  'Warning: This page maybe requiring CAPTCHA, please make sure you are authorized to access this page.', ''),
  'Trusted Editorial content, reviewed by leading industry experts and seasoned editors.', ''),
  'Ad Disclosure', ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"""
LAB = ART + f""", keyed AS (SELECT *, {KEY} AS k FROM art),
lab AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY k) > 1 THEN CAST(min(doc_id) OVER (PARTITION BY k) AS VARCHAR) END AS label FROM keyed)"""
TOKS = ART + f", toks AS (SELECT id, published_at, {TOK.format('text')} AS t FROM art)"
WORDS = TOKS + ", words AS (SELECT DISTINCT id, unnest(t) AS w FROM toks)"


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents in the shape of articles: a title made up, a time spread over 30 days."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.col("doc_id") * 7919 % 43200) * 60_000_000)
    return d.select("doc_id", F.col("doc_id").cast("string").alias("id"), T.made_up_title(F.lit(None).cast("string"), text).alias("title"), text.alias("text"), "source", at.alias("published_at"))


#: What makes copies of a text differ until its key is taken; 'Ad Disclosur' and an upper-case reference stay in it.
NOISY = """CASE doc_id % 8 WHEN 0 THEN text || ' Ad Disclosure' WHEN 1 THEN 'Warning: This page maybe requiring CAPTCHA, please make sure you are authorized to access this page. ' || text
  WHEN 2 THEN text || 'Trusted Editorial content, reviewed by leading industry experts and seasoned editors.' WHEN 3 THEN 'Reference ID 0a-b9 ' || text
  WHEN 4 THEN CASE WHEN doc_id % 3 = 0 THEN 'short' ELSE text || ' Reference ID AB' END WHEN 5 THEN text || ' Ad Disclosur' ELSE text END"""
NOISED = f"noised AS (SELECT * REPLACE ({NOISY} AS text) FROM art)"


def noised(spark: SparkSession, sf: str) -> DataFrame:
    return articles(spark, sf).withColumn("text", F.expr(NOISY))


def labelled(a: DataFrame) -> DataFrame:
    """Exact copies share a label, their first id."""
    k = a.withColumn("k", T.noise_key(F.col("text")))
    many = k.groupBy("k").agg(F.count("*").alias("n"), F.min("doc_id").cast("string").alias("label")).where("n > 1")
    return k.join(many.drop("n"), "k", "left").drop("k")


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# -- sources, validation, labels

RAW = """raw AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN 'not a date' WHEN doc_id % 11 = 0 THEN NULL ELSE strftime(published_at, '%Y-%m-%dT%H:%M:%S') END AS p,
  CASE WHEN doc_id % 13 = 0 THEN 'abc' WHEN doc_id % 5 = 0 THEN '12' END AS tc FROM art)"""


@query(f"WITH {ART}, {RAW} SELECT id, md5(title) AS title_md5, source, epoch_us(TRY_CAST(p AS TIMESTAMP)) AS t_us, TRY_CAST(tc AS BIGINT) AS true_cluster_id FROM raw WHERE TRY_CAST(p AS TIMESTAMP) IS NOT NULL AND source IS NOT NULL AND (tc IS NULL OR TRY_CAST(tc AS BIGINT) IS NOT NULL)")
def load_validate(spark, sf):
    """IO1, IO5: raw rows, some of them broken, written as JSON and loaded."""
    a = articles(spark, sf)
    raw = a.withColumns({
        "published_at": F.when(F.col("doc_id") % 7 == 0, "not a date").when(F.col("doc_id") % 11 == 0, None).otherwise(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")),
        "true_cluster_id": F.when(F.col("doc_id") % 13 == 0, "abc").when(F.col("doc_id") % 5 == 0, "12"),
    })
    path = fresh_path(spark, "raw")
    raw.select("id", "title", "text", "source", "published_at", "true_cluster_id").write.json(path)
    return ingest.validate(read_articles(spark, path)).select("id", F.md5("title").alias("title_md5"), "source", F.unix_micros("published_at").alias("t_us"), "true_cluster_id")


@query(f"WITH {ART}, e AS (SELECT * FROM art WHERE doc_id % 2 = 0 ORDER BY doc_id LIMIT 50), o AS (SELECT * FROM art WHERE doc_id % 2 = 1 ORDER BY doc_id LIMIT 50) SELECT doc_id, source FROM e UNION ALL SELECT doc_id, source FROM o")
def union_limit(spark, sf):
    a = articles(spark, sf).select("doc_id", "source")
    return ingest.union_limit(a.where("doc_id % 2 = 0"), a.where("doc_id % 2 = 1"), 101, "doc_id")


@query(f"WITH {ART}, t AS (SELECT id, CASE WHEN doc_id % 9 = 0 THEN doc_id + 1 END AS tc FROM art), g AS (SELECT DISTINCT CAST(tc AS VARCHAR) AS g FROM t WHERE tc IS NOT NULL) SELECT id, coalesce(CAST(tc AS VARCHAR), g) AS label FROM t LEFT JOIN g ON id = g")
def ground_truth(spark, sf):
    a = articles(spark, sf).withColumn("true_cluster_id", F.when(F.col("doc_id") % 9 == 0, F.col("doc_id") + 1))
    return ingest.ground_truth(a).select("id", "label")


# -- text

LINES = "lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw_line FROM art), lined AS (SELECT doc_id, " + STRIP.format("raw_line") + " AS line FROM lines), boiler AS (SELECT line, count(DISTINCT doc_id) AS df FROM lined WHERE length(line) > 15 GROUP BY line HAVING count(DISTINCT doc_id) >= 5)"


def boilerplate(a: DataFrame, least: int = 5) -> DataFrame:
    return ingest.frequent_lines(a, "doc_id", "text", least)


@query(f"WITH {ART}, {LINES} SELECT line, df FROM boiler")
def boilerplate_mine(spark, sf):
    return boilerplate(articles(spark, sf))


@query(f"WITH {ART}, {LINES}, p AS (SELECT doc_id, pos, raw FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM art)), k AS (SELECT * FROM p WHERE {STRIP.format('raw')} NOT IN (SELECT line FROM boiler)) SELECT a.doc_id, md5(coalesce(string_agg(k.raw, chr(10) ORDER BY pos), '')) AS text_md5 FROM art a LEFT JOIN k ON a.doc_id = k.doc_id GROUP BY a.doc_id")
def boilerplate_strip(spark, sf):
    """PR2 for a dictionary of any size."""
    a = articles(spark, sf)
    return ingest.drop_known_lines(a, "doc_id", "text", boilerplate(a)).select("doc_id", F.md5("text").alias("text_md5"))


PHRASES = ("the ", "and", "ing", "e.\n", *BAD_PHRASES)


def sql_phrases(c: str, phrases) -> str:
    for p in phrases:
        c = f"replace({c}, '{p.replace(chr(39), chr(39) * 2)}', '')" if "\n" not in p else f"replace({c}, 'e.' || chr(10), '')"
    return c


@query(f"WITH {ART} SELECT doc_id, md5({sql_phrases('text', PHRASES)}) AS text_md5 FROM art")
def phrase_delete(spark, sf):
    return articles(spark, sf).select("doc_id", F.md5(T.delete_phrases(F.col("text"), PHRASES)).alias("text_md5"))


@query(f"WITH {ART}, c AS (SELECT id, {SQUEEZE.format(sql_phrases('title || chr(10) || text', BAD_PHRASES))} AS c FROM art) SELECT id, length(c) AS n_chars, md5(c) AS clean_md5 FROM c")
def clean_text(spark, sf):
    c = T.squeeze(T.delete_phrases(T.title_and_text(F.col("title"), F.col("text")), BAD_PHRASES))
    return articles(spark, sf).select("id", c.alias("c")).select("id", F.length("c").cast("long").alias("n_chars"), F.md5("c").alias("clean_md5"))


@query(f"WITH {TOKS} SELECT id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens_md5 FROM toks")
def tokens_unigram(spark, sf):
    a = articles(spark, sf).select("id", T.tokens(F.col("text")).alias("t"))
    return a.select("id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens_md5"))


@query(f"WITH {TOKS}, s AS (SELECT id, CASE WHEN len(t) < 3 THEN t ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END AS s FROM toks) SELECT id, len(s) AS n, md5(array_to_string(s, '|')) AS shingles_md5 FROM s")
def shingles_trigram(spark, sf):
    a = articles(spark, sf).select("id", T.tokens(F.col("text")).alias("t")).select("id", T.trigrams(F.col("t")).alias("s"))
    return a.select("id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|")).alias("shingles_md5"))


@query(f"WITH {ART} SELECT id, md5(lower({STRIP.format('text')})) AS text_hash FROM art")
def text_hash(spark, sf):
    return articles(spark, sf).select("id", T.text_hash(F.col("text")).alias("text_hash"))


@query(f"WITH {ART}, r AS (SELECT id, text, CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN title END AS t, CASE WHEN doc_id % 4 = 0 THEN '' WHEN doc_id % 4 <> 1 THEN '2024-02-03' END AS d FROM art) SELECT id, CASE WHEN coalesce(t, '') <> '' THEN t WHEN left(split_part(text, '. ', 1), 100) <> '' THEN left(split_part(text, '. ', 1), 100) || '...' ELSE 'News Article' END AS title, coalesce(nullif(d, ''), '2024-01-01') AS published_at FROM r")
def fill_title_date(spark, sf):
    a = articles(spark, sf).withColumns({"t": F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("title")), "d": F.when(F.col("doc_id") % 4 == 0, "").when(F.col("doc_id") % 4 != 1, "2024-02-03")})
    return a.select("id", T.made_up_title(F.col("t"), F.col("text")).alias("title"), F.coalesce(F.nullif("d", F.lit("")), F.lit("2024-01-01")).alias("published_at"))


DATES = """CASE doc_id % 9 WHEN 0 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(published_at, '%a, %d %b %Y %H:%M:%S GMT')
  WHEN 2 THEN strftime(published_at, '%-d %b %Y %H:%M:%S -0530') WHEN 3 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S+03:00') WHEN 4 THEN 'soon'
  WHEN 5 THEN strftime(published_at, '%B %-d, %Y') WHEN 6 THEN strftime(published_at, '%Y/%m/%d') WHEN 7 THEN '' END"""


@query(f"WITH {ART} SELECT id, {DATES} AS raw, CASE doc_id % 9 WHEN 2 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S-05:30') WHEN 3 THEN strftime(published_at, '%Y-%m-%dT%H:%M:%S+03:00') WHEN 4 THEN 'soon' WHEN 5 THEN strftime(published_at, '%Y-%m-%dT00:00:00+00:00') WHEN 6 THEN strftime(published_at, '%Y-%m-%dT00:00:00+00:00') WHEN 7 THEN '' WHEN 8 THEN NULL ELSE strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00') END AS published_at, CASE WHEN doc_id % 9 IN (4, 7, 8) THEN NULL WHEN doc_id % 9 = 2 THEN epoch_us(published_at + INTERVAL 330 MINUTE) WHEN doc_id % 9 = 3 THEN epoch_us(published_at - INTERVAL 3 HOUR) WHEN doc_id % 9 IN (5, 6) THEN epoch_us(date_trunc('day', published_at)) ELSE epoch_us(published_at) END AS t_us FROM art")
def parse_dates(spark, sf):
    p, m = F.col("published_at"), F.col("doc_id") % 9
    day = lambda f: F.date_format(p, f)
    raw = F.when(m == 0, day("yyyy-MM-dd'T'HH:mm:ss")).when(m == 1, day("EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(m == 2, day("d MMM yyyy HH:mm:ss '-0530'"))
    raw = raw.when(m == 3, day("yyyy-MM-dd'T'HH:mm:ss'+03:00'")).when(m == 4, "soon").when(m == 5, day("MMMM d, yyyy")).when(m == 6, day("yyyy/MM/dd")).when(m == 7, "")
    return articles(spark, sf).select("id", raw.alias("raw")).select("id", "raw", T.fixed_date(F.col("raw")).alias("published_at"), F.unix_micros(T.flexible_date(F.col("raw"))).alias("t_us"))


@query(r"WITH p AS (SELECT page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS source FROM pages) SELECT page_id, source, CASE WHEN contains(source, '.ru') OR contains(source, 'meduza') THEN 'ru' ELSE 'en' END AS lang FROM p")
def url_source_lang(spark, sf):
    host = T.netloc(F.col("url"))
    return table(spark, sf, "pages").select("page_id", host.alias("source"), T.site_language(host).alias("lang"))


@query()
def html_extract(spark, sf):
    return table(spark, sf, "pages").select("page_id", main_text(F.col("html")).alias("text"))


# -- filters and exact copies

# Fixed values, as texts of the oracle; the last two are no markers.
MARKED = """marked AS (SELECT * REPLACE (text || CASE doc_id % 10 WHEN 0 THEN 'Yahoo on osa' WHEN 1 THEN ' Just a moment...' WHEN 2 THEN 'Access to this page has been denied'
  WHEN 3 THEN 'Target URL returned error 403' WHEN 4 THEN 'Prices of cryptocurrencies' WHEN 5 THEN 'Markdown Content: Before we continue' WHEN 6 THEN 'just a moment...' WHEN 7 THEN 'Risk Disclosure' ELSE '' END AS text) FROM art)"""


def marked(spark, sf) -> DataFrame:
    parts = MARKED.partition("text || ")[2].rpartition(" AS text")[0]
    return articles(spark, sf).withColumn("text", F.concat("text", F.expr(parts)))


@query(f"WITH {ART}, {MARKED} SELECT id FROM marked WHERE NOT regexp_matches(text, 'Yahoo on osa|Just a moment\\.\\.\\.|Access to this page has been denied|Target URL returned error|Prices of cryptocurrencies|Markdown Content: Before we continue')")
def broken_filter(spark, sf):
    return ingest.not_broken(marked(spark, sf)).select("id")


@query(f"WITH {ART}, {MARKED} SELECT id FROM marked WHERE NOT regexp_matches(text, 'Yahoo on osa|Just a moment\\.\\.\\.|Access to this page has been denied')")
def broken_filter_short(spark, sf):
    return ingest.not_broken(marked(spark, sf), markers=ingest.BROKEN_SHORT).select("id")


@query(f"WITH {ART} SELECT id FROM art WHERE length({STRIP.format('text')}) >= 400")
def min_length(spark, sf):
    return ingest.long_enough(articles(spark, sf), least=400).select("id")


@query(f"WITH {ART} SELECT id FROM art WHERE source IS DISTINCT FROM 'src3' OR source IS NULL")
def drop_synthetic(spark, sf):
    a = articles(spark, sf).withColumn("source", F.when(F.col("source") == "src3", "Synthetic").otherwise(F.col("source")))
    return ingest.not_synthetic(a).select("id")


@query(f"WITH {ART}, {NOISED} SELECT min(doc_id) AS doc_id FROM noised GROUP BY {KEY}")
def dedup_exact_keep_first(spark, sf):
    return ingest.keep_first(noised(spark, sf), T.noise_key(F.col("text")), "doc_id").select("doc_id")


@query(f"WITH {ART}, {NOISED} SELECT doc_id, md5({KEY}) AS key_md5 FROM noised")
def noise_strip(spark, sf):
    return noised(spark, sf).select("doc_id", F.md5(T.noise_key(F.col("text"))).alias("key_md5"))


TC = f"{NOISED}, tc AS (SELECT *, {KEY} AS k, CASE WHEN doc_id % 4 = 0 THEN doc_id + 7 WHEN doc_id % 4 = 1 THEN 0 END AS tcid FROM noised)"


def with_labels(spark, sf):
    return noised(spark, sf).withColumn("true_cluster_id", F.when(F.col("doc_id") % 4 == 0, F.col("doc_id") + 7).when(F.col("doc_id") % 4 == 1, F.lit(0)))


@query(f"WITH {ART}, {TC} SELECT doc_id, CASE WHEN length(k) > 50 THEN first_value(coalesce(nullif(tcid, 0), doc_id)) OVER (PARTITION BY k ORDER BY doc_id) ELSE coalesce(nullif(tcid, 0), doc_id) END AS true_cluster_id FROM tc")
def dedup_merge_labels(spark, sf):
    return ingest.merge_labels(with_labels(spark, sf), T.noise_key(F.col("text")), "doc_id").select("doc_id", "true_cluster_id")


@query(f"WITH {ART}, {TC}, n AS (SELECT doc_id, tcid, CASE WHEN doc_id % 11 <> 0 THEN k END AS k, doc_id % 6 = 3 AS absent FROM tc) SELECT doc_id, CASE WHEN row_number() OVER w = 1 THEN tcid ELSE first_value(CASE WHEN absent THEN doc_id ELSE tcid END) OVER w END AS true_cluster_id FROM n WINDOW w AS (PARTITION BY k ORDER BY doc_id)")
def dedup_merge_later(spark, sf):
    """Some keys are null, and some records have no label at all (doc_id % 6 = 3, whose label is null here)."""
    key = F.when(F.col("doc_id") % 11 != 0, T.noise_key(F.col("text")))
    return ingest.merge_later(with_labels(spark, sf), key, "doc_id", F.col("doc_id") % 6 == 3).select("doc_id", "true_cluster_id")


@query(f"WITH {ART}, h AS (SELECT doc_id, md5(lower({STRIP.format('text')})) AS text_hash FROM art), f AS (SELECT text_hash, min(doc_id) AS doc_id FROM h GROUP BY text_hash) SELECT doc_id, text_hash, 1000 + row_number() OVER (ORDER BY doc_id) AS new_id FROM f")
def dedup_ingest_hash(spark, sf):
    h = T.text_hash(F.col("text"))
    return ingest.dense_ids(ingest.keep_first(articles(spark, sf), h, "doc_id").select("doc_id", h.alias("text_hash")), "doc_id", 1000)


@query("SELECT p.page_id, p.url FROM pages p WHERE p.url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0 AND url IS NOT NULL)")
def incremental_anti(spark, sf):
    p = table(spark, sf, "pages").select("page_id", "url")
    return ingest.unseen(p, p.where("page_id % 3 = 0"), "url")


@query("SELECT p.page_id, p.url FROM pages p WHERE p.page_id % 4 = 0 AND p.url NOT IN (SELECT url FROM pages WHERE page_id % 4 <> 0 AND url IS NOT NULL)")
def seen_index(spark, sf):
    """FI6, IO17: three batches of addresses in an index, and the rows of a fourth that none of them had."""
    p, seen = table(spark, sf, "pages").select("page_id", "url"), SeenKeys(spark, fresh_path(spark, "seen"))
    for k in (1, 2, 3):
        seen.add(p.where(F.col("page_id") % 4 == k).select("url"))
    return seen.unseen(p.where("page_id % 4 = 0"), "url")


# -- sketches

H = "CAST('0x' || substr(md5(w), 1, 8) AS BIGINT)"


def sql_sig(n: int) -> str:
    mins = ", ".join(f"min(({a}::BIGINT * h + {b}) % {sketch.PRIME})" for a, b in sketch.coefficients(n))
    return WORDS + f", hs AS (SELECT id, {H} AS h FROM words), ms AS (SELECT id, [{mins}] AS sig FROM hs GROUP BY id), sigs AS (SELECT a.id, a.published_at, coalesce(sig, list_transform(range({n}), lambda x: {sketch.PRIME}::BIGINT)) AS sig FROM art a LEFT JOIN ms ON a.id = ms.id)"


def signed(spark, sf) -> DataFrame:
    a = articles(spark, sf)
    return a.select("id", "published_at").join(sketch.signatures(a, "id", T.tokens(F.col("text"))), "id")


@query(f"WITH {sql_sig(128)} SELECT id, md5(array_to_string(sig, ',')) AS sig_md5 FROM sigs")
def minhash_signature(spark, sf):
    return signed(spark, sf).select("id", F.md5(F.array_join("sig", ",")).alias("sig_md5"))


@query(f"WITH {sql_sig(128)} SELECT first_value(id) OVER (PARTITION BY sig ORDER BY published_at, id) AS rep_id, id AS member_id FROM sigs")
def minhash_groups(spark, sf):
    return sketch.signature_groups(stage(signed(spark, sf), "signed"), "id", "published_at")


BANDS = ", same AS (SELECT id, min(id) OVER (PARTITION BY sig) AS rep FROM sigs), bands AS (SELECT id, b, array_to_string(sig[b * 4 + 1 : b * 4 + 4], ',') AS k FROM sigs, range(32) AS r(b) WHERE id IN (SELECT rep FROM same)), cand AS (SELECT DISTINCT x.id AS id_a, y.id AS id_b FROM bands x JOIN bands y ON x.b = y.b AND x.k = y.k AND x.id < y.id UNION ALL SELECT rep, id FROM same WHERE id <> rep)"


@query(f"WITH {sql_sig(128)}{BANDS} SELECT id_a, id_b FROM cand")
def lsh_candidates(spark, sf):
    return sketch.band_candidates(stage(signed(spark, sf), "signed"), "id")


EST = "len(list_filter(range(1, 129), lambda i: {}[i] = {}[i])) / 128.0"


@query(f"WITH {sql_sig(128)}{BANDS} SELECT id_a, id_b, {EST.format('x.sig', 'y.sig')} AS jac FROM cand JOIN sigs x ON x.id = id_a JOIN sigs y ON y.id = id_b WHERE {EST.format('x.sig', 'y.sig')} >= 0.7")
def minhash_jaccard_pairs(spark, sf):
    s = stage(signed(spark, sf), "signed")
    pairs = sketch.band_candidates(s, "id").join(s.select(F.col("id").alias("id_a"), F.col("sig").alias("sa")), "id_a").join(s.select(F.col("id").alias("id_b"), F.col("sig").alias("sb")), "id_b")
    return pairs.select("id_a", "id_b", sketch.estimate(F.col("sa"), F.col("sb")).alias("jac")).where("jac >= 0.7")


@query(f"WITH {WORDS}, sets AS (SELECT id, list_sort(list(w)) AS s FROM words GROUP BY id), same AS (SELECT id, min(id) OVER (PARTITION BY s) AS rep FROM sets), n AS (SELECT id, len(s) AS n FROM sets), own AS (SELECT * FROM words WHERE id IN (SELECT rep FROM same)), b AS (SELECT x.id AS id_a, y.id AS id_b, count(*) AS c FROM own x JOIN own y ON x.w = y.w AND x.id < y.id GROUP BY ALL) SELECT id_a, id_b, round(c / (p.n + q.n - c), 6) AS jaccard FROM b JOIN n p ON p.id = id_a JOIN n q ON q.id = id_b WHERE c / (p.n + q.n - c) >= 0.7 UNION ALL SELECT rep, id, 1.0 FROM same WHERE id <> rep")
def exact_jaccard_pairs(spark, sf):
    """Pairs of representatives, and each with the copies it stands for."""
    a = articles(spark, sf).select("id", T.tokens(F.col("text")).alias("t"))
    return sketch.jaccard_pairs(a, "id", "t", 0.7).select("id_a", "id_b", F.round("jaccard", 6).alias("jaccard"))


# -- windows and vectors


@query("SELECT a.user_id, a.event_id AS id_a, b.event_id AS id_b FROM events a JOIN events b ON a.user_id = b.user_id AND (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id)) AND b.ts < a.ts + INTERVAL 3 DAY")
def band_join_events(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id")
    return windowed.band_join(e, "event_id", "ts", 2, by=("user_id",)).select("user_id", F.col("event_id_a").alias("id_a"), F.col("event_id_b").alias("id_b"))


@query("SELECT a.user_id, a.event_id, count(b.event_id) AS n_after FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id)) AND b.ts < a.ts + INTERVAL 3 DAY GROUP BY ALL")
def window_neighbour_count(spark, sf):
    return windowed.neighbours(table(spark, sf, "events").select("event_id", "ts", "user_id"), "event_id", "ts", 2, "user_id")


#: Every other event in one hour, the others where they are.
CROWDED = "crowded AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN TIMESTAMP '2024-01-10' + (event_id % 3600) * INTERVAL 1 SECOND ELSE ts END AS ts FROM events WHERE ts IS NOT NULL)"


def crowded(spark, sf) -> DataFrame:
    at = F.timestamp_micros(F.lit(1_704_844_800_000_000) + F.col("event_id") % 3600 * 1_000_000)
    return table(spark, sf, "events").where("ts is not null").select("event_id", F.when(F.col("event_id") % 2 == 0, at).otherwise(F.col("ts").cast("timestamp")).alias("ts"))


@query(f"WITH {CROWDED} SELECT event_id, count(*) OVER (ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND 259199999999 FOLLOWING) - row_number() OVER (PARTITION BY ts ORDER BY event_id) AS n_after FROM crowded")
def global_neighbour_count(spark, sf):
    """WI3 without a key, one hour holding half of all rows."""
    return windowed.followers(crowded(spark, sf), "event_id", "ts", 3 * windowed.DAY).select(F.col("id").alias("event_id"), "n_after")


@query("SELECT a.event_id AS id_a, b.event_id AS id_b FROM events a JOIN events b ON (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id)) AND b.ts < a.ts + INTERVAL 10 MINUTE")
def global_window_pairs(spark, sf):
    """JO1 without a key: ten minutes over all events."""
    return windowed.window_pairs(table(spark, sf, "events").select("event_id", "ts"), "event_id", "ts", 600_000_000)


def timed_vectors(spark, sf) -> DataFrame:
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (F.col("vec_id") * 7919 % 43200) * 60_000_000)
    return table(spark, sf, "embeddings").where("embedding is not null").select("vec_id", at.alias("t"), F.col("embedding").alias("v"))


VEC = "vec AS (SELECT vec_id, TIMESTAMP '2024-01-01' + ((vec_id * 7919) % 43200) * INTERVAL 1 MINUTE AS t, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL)"


@query(f"WITH {VEC} SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_dot_product(a.v, b.v), 5) AS cos FROM vec a JOIN vec b ON (b.t > a.t OR (b.t = a.t AND b.vec_id > a.vec_id)) AND b.t < a.t + INTERVAL 3 DAY WHERE list_dot_product(a.v, b.v) >= 0.3")
def window_cosine_pairs(spark, sf):
    return windowed.cosine_pairs(timed_vectors(spark, sf), "vec_id", "t", "v", 2, 0.3).withColumn("cos", F.round("cos", 5))


@query(f"WITH {VEC} SELECT vec_id, round(sqrt(list_dot_product(v, v)), 5) AS norm, round(v[1] / sqrt(list_dot_product(v, v)), 5) AS first FROM vec")
def l2_normalise(spark, sf):
    v = timed_vectors(spark, sf)
    return v.select("vec_id", F.round(F.sqrt(windowed.dot(F.col("v"), F.col("v"))), 5).alias("norm"), F.round(windowed.normalised(F.col("v"))[0], 5).alias("first"))


CELLS = ", cells AS (SELECT id, (h >> 1) % 256 AS i, sum(CASE WHEN h % 2 = 1 THEN 1 ELSE -1 END) AS s FROM (SELECT id, " + H + " AS h FROM (SELECT id, unnest(t) AS w FROM toks)) GROUP BY ALL), norms AS (SELECT id, sqrt(sum(s * s)) AS z FROM cells GROUP BY id HAVING sum(s * s) > 0)"


@query(f"WITH {TOKS}{CELLS} SELECT cells.id, i::INT AS i, round(s / z, 6) AS x FROM cells JOIN norms ON cells.id = norms.id WHERE s <> 0")
def hashed_embedding(spark, sf):
    v = windowed.hashed_vectors(articles(spark, sf), "id", T.tokens(F.col("text")))
    return v.select("id", F.posexplode("v").alias("i", "x")).where("x <> 0").select("id", "i", F.round("x", 6).alias("x"))


COS = ", vecs AS MATERIALIZED (SELECT n.id, list(coalesce(c.s, 0)::DOUBLE ORDER BY r.i) AS v, any_value(n.z) AS z FROM norms n CROSS JOIN range(256) AS r(i) LEFT JOIN cells c ON c.id = n.id AND c.i = r.i GROUP BY n.id), placed AS MATERIALIZED (SELECT vecs.*, published_at AS t FROM vecs JOIN art ON art.id = vecs.id), cosines AS MATERIALIZED (SELECT a.id AS id_a, b.id AS id_b, list_dot_product(a.v, b.v) / (a.z * b.z) AS cos FROM placed a JOIN placed b ON (b.t > a.t OR (b.t = a.t AND b.id > a.id)) AND b.t < a.t + INTERVAL 3 DAY)"
JAC = f"WITH {sql_sig(128)}{CELLS}{COS}, veto AS (SELECT id_a, id_b, cos, {EST.format('x.sig', 'y.sig')} AS jac FROM cosines JOIN sigs x ON x.id = id_a JOIN sigs y ON y.id = id_b WHERE cos >= 0.9)"


def counted_vectors(spark, sf) -> DataFrame:
    """id, v (counts of words), sig, published_at: one pass over the texts."""
    return windowed.hashed_vectors(articles(spark, sf), "id", T.tokens(F.col("text")), counts=True, keep=("published_at",), signed=128)


def vetoed(spark, sf, jac: float = 0.7) -> DataFrame:
    return windowed.cosine_pairs(counted_vectors(spark, sf), "id", "published_at", "v", 2, 0.9, cosine=True, sig_col="sig", veto=jac)


@query(f"{JAC} SELECT id_a, id_b, round(cos, 6) AS cos, jac FROM veto WHERE jac >= 0.7")
def window_cosine_veto(spark, sf):
    return vetoed(spark, sf).select("id_a", "id_b", F.round("cos", 6).alias("cos"), "jac")


GRID = [(c, j) for c in (0.9, 0.95, 0.97) for j in (0.0, 0.5, 0.7, 0.9)]


@query(f"{JAC}, grid AS (SELECT c, j FROM (VALUES (0.9), (0.95), (0.97)) AS g(c), (VALUES (0.0), (0.5), (0.7), (0.9)) AS k(j)) SELECT c::DOUBLE AS min_cos, j::DOUBLE AS min_jac, count(id_a) AS n_pairs FROM grid LEFT JOIN veto ON cos >= c AND jac >= j GROUP BY ALL")
def threshold_sweep(spark, sf):
    """The pairs of VE3: candidates once, at the lowest thresholds; each counts for the grid points it passes."""
    counts = vetoed(spark, sf, 0.0).agg(*[F.count_if((F.col("cos") >= c) & (F.col("jac") >= j)).alias(f"g{i}") for i, (c, j) in enumerate(GRID)])
    points = F.array(*[F.struct(F.lit(c).alias("min_cos"), F.lit(j).alias("min_jac"), F.col(f"g{i}").alias("n_pairs")) for i, (c, j) in enumerate(GRID)])
    return counts.select(F.explode(points).alias("p")).select("p.*")


SHN = ", sh AS (SELECT id, unnest(CASE WHEN len(t) < 3 THEN t ELSE list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]) END) AS s FROM (SELECT id, " + TOK.format("left(text, 2000)") + " AS t FROM art)), shd AS (SELECT DISTINCT id, s FROM sh), shc AS (SELECT id, count(*) AS n FROM shd GROUP BY id)"
RERANK = f", link AS (SELECT id_a, id_b FROM veto WHERE jac >= 0.7), bothn AS (SELECT id_a, id_b, count(y.s) AS c FROM link JOIN shd x ON x.id = id_a LEFT JOIN shd y ON y.id = id_b AND y.s = x.s GROUP BY ALL), scored AS (SELECT id_a, id_b, 1 / (1 + exp(-10 * (c / (p.n + q.n - c) - 0.5))) AS score FROM bothn JOIN shc p ON p.id = id_a JOIN shc q ON q.id = id_b)"


@query(f"{JAC}{SHN}{RERANK} SELECT id_a, id_b, round(score, 6) AS score FROM scored WHERE score >= 0.8")
def rerank_sigmoid_filter(spark, sf):
    found = rerank(vetoed(spark, sf), articles(spark, sf).withColumnRenamed("text", "clean_text"), DedupConfig())
    return found.select("id_a", "id_b", F.round("score", 6).alias("score"))


# -- graphs and clusters, on links of equal exact keys and shared bands

LINKS = f"WITH RECURSIVE {sql_sig(128)}{BANDS}, links AS (SELECT id_a, id_b FROM cand JOIN sigs x ON x.id = id_a JOIN sigs y ON y.id = id_b WHERE {EST.format('x.sig', 'y.sig')} >= 0.7), both_ways AS (SELECT id_a AS a, id_b AS b FROM links UNION SELECT id_b, id_a FROM links), reach AS (SELECT id, id AS r FROM art UNION SELECT reach.id, b FROM reach JOIN both_ways ON r = a), comp AS (SELECT id, min(r) AS cluster_id FROM reach GROUP BY id)"
LABELLED = f", keyed AS (SELECT *, {KEY} AS k FROM art), lab AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY k) > 1 THEN CAST(min(doc_id) OVER (PARTITION BY k) AS VARCHAR) END AS label FROM keyed)"


def components(spark, sf) -> DataFrame:
    parts = graph.connected_components(minhash_jaccard_pairs(spark, sf), "id_a", "id_b")
    return stage(articles(spark, sf).select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("cluster_id")), "components")


@query(f"{LINKS} SELECT id, cluster_id FROM comp")
def connected_components(spark, sf):
    return components(spark, sf)


@query()
def louvain_clusters(spark, sf):
    return graph.louvain(articles(spark, sf), minhash_jaccard_pairs(spark, sf).withColumnRenamed("jac", "score"))


@query(f"WITH {sql_sig(128)}, g AS (SELECT first_value(id) OVER (PARTITION BY sig ORDER BY published_at, id) AS rep_id, id FROM sigs) SELECT id, rep_id AS cluster_id FROM g")
def restore_hidden(spark, sf):
    groups = stage(minhash_groups(spark, sf), "groups")
    return clusters.restore(groups.select(F.col("rep_id").alias("id"), F.col("rep_id").alias("cluster_id")).distinct(), groups)


@query(f"{LINKS} SELECT cluster_id, arg_min(art.id, (published_at, art.id)) AS canonical_id FROM comp JOIN art ON art.id = comp.id GROUP BY cluster_id")
def canonical_articles(spark, sf):
    return clusters.canonical(components(spark, sf), articles(spark, sf))


CLUSTERS = f"{LINKS}, cl AS (SELECT cluster_id, arg_min(art.id, (published_at, art.id)) AS canonical_news_id, string_agg(art.id, ',' ORDER BY art.id) AS news_ids, count(*) AS n FROM comp JOIN art ON art.id = comp.id GROUP BY cluster_id)"


@query(f"{CLUSTERS} SELECT cluster_id, canonical_news_id, news_ids FROM cl")
def cluster_output(spark, sf):
    return clusters.cluster_rows(components(spark, sf), articles(spark, sf)).withColumn("news_ids", F.array_join("news_ids", ","))


@query(f"{CLUSTERS} SELECT cluster_id, n FROM cl ORDER BY n DESC, cluster_id LIMIT 5")
def top_clusters(spark, sf):
    return components(spark, sf).groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(5)


PM = "prd AS (SELECT x.id AS a, y.id AS b FROM comp x JOIN comp y ON x.cluster_id = y.cluster_id AND x.id < y.id), tru AS (SELECT x.id AS a, y.id AS b FROM lab x JOIN lab y ON x.label = y.label AND x.id < y.id)"
PRF = "CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1"
RND = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


@query(f"{LINKS}{LABELLED}, {PM}, m AS (SELECT (SELECT count(*) FROM prd JOIN tru USING (a, b)) AS tp, (SELECT count(*) FROM prd) AS np, (SELECT count(*) FROM tru) AS nt), s AS (SELECT tp, np - tp AS fp, nt - tp AS fn FROM m), z AS (SELECT tp, fp, fn, {PRF} FROM s) SELECT tp, fp, fn, {RND} FROM z")
def pair_metrics(spark, sf):
    m = clusters.pair_metrics(components(spark, sf), labelled(articles(spark, sf)))
    return m.select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{LINKS}{LABELLED}, {PM} SELECT a AS id_a, b AS id_b FROM prd EXCEPT SELECT a, b FROM tru")
def fp_pairs(spark, sf):
    p = clusters.pairs_within(components(spark, sf), "cluster_id")
    return p.subtract(clusters.pairs_within(labelled(articles(spark, sf)).where("label is not null"), "label"))


@query(f"{LINKS}{LABELLED}, {PM} SELECT a AS id_a, b AS id_b FROM tru EXCEPT SELECT a, b FROM prd")
def fn_pairs(spark, sf):
    return clusters.missed_pairs(labelled(articles(spark, sf)), components(spark, sf))


#: Labels that clusters miss: one for each three neighbouring identifiers.
TRIPLES = ", lab AS (SELECT id, CAST(doc_id // 3 AS VARCHAR) AS label FROM art WHERE doc_id % 5 <> 0)"


@query(f"""{LINKS}{TRIPLES}, {PM}, fp AS (SELECT 'FP' AS kind, a AS id_a, b AS id_b FROM (SELECT a, b FROM prd EXCEPT SELECT a, b FROM tru) ORDER BY a, b LIMIT 5), fn AS (SELECT 'FN' AS kind, a AS id_a, b AS id_b FROM (SELECT a, b FROM tru EXCEPT SELECT a, b FROM prd) ORDER BY a, b LIMIT 5), few AS (SELECT * FROM fp UNION ALL SELECT * FROM fn)
SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY id_a, id_b)::INT AS place, id_a, id_b, md5(CASE kind WHEN 'FP' THEN x.title || '. ' || left(x.text, 800) || '...' ELSE left(x.title || chr(10) || x.text, 300) || '...' END) AS view_a_md5, md5(CASE kind WHEN 'FP' THEN y.title || '. ' || left(y.text, 800) || '...' ELSE left(y.title || chr(10) || y.text, 300) || '...' END) AS view_b_md5 FROM few JOIN art x ON x.id = id_a JOIN art y ON y.id = id_b""")
def error_view(spark, sf):
    """PR22: the first five false positives and negatives."""
    rows = articles(spark, sf).where("doc_id % 5 <> 0").select("id", F.expr("cast(doc_id div 3 as string)").alias("label"))
    true, pred = stage(clusters.pairs_within(rows, "label"), "true-pairs"), stage(clusters.pairs_within(components(spark, sf), "cluster_id"), "predicted-pairs")
    view = clusters.error_view(pred.subtract(true), true.subtract(pred), articles(spark, sf))
    return view.select("kind", "place", "id_a", "id_b", F.md5("view_a").alias("view_a_md5"), F.md5("view_b").alias("view_b_md5"))


@query(f"{CLUSTERS}, known AS (SELECT id, CASE WHEN doc_id % 4 <> 0 THEN title END AS title FROM art WHERE doc_id % 3 <> 0) SELECT comp.cluster_id, comp.id, CASE WHEN known.id IS NULL THEN 'Unknown Article' ELSE coalesce(title, 'No Title') END AS title FROM comp LEFT JOIN known ON known.id = comp.id")
def titles_with_defaults(spark, sf):
    """PR32: some titles are null here, and some articles missing."""
    known = articles(spark, sf).where("doc_id % 3 <> 0").select("id", F.when(F.col("doc_id") % 4 != 0, F.col("title")).alias("title"))
    return clusters.titled(components(spark, sf), known).select("cluster_id", "id", "title")


@query(f"{LINKS}{LABELLED}, c AS (SELECT label, cluster_id, count(*) AS n FROM lab JOIN comp ON lab.id = comp.id WHERE label IS NOT NULL GROUP BY ALL), s AS (SELECT sum(n * (n - 1) / 2) AS s, sum(n) AS n FROM c), a AS (SELECT sum(n * (n - 1) / 2) AS a FROM (SELECT sum(n) AS n FROM c GROUP BY label)), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM (SELECT sum(n) AS n FROM c GROUP BY cluster_id)) SELECT round(coalesce((s - a * b / (n * (n - 1) / 2)) / nullif((a + b) / 2 - a * b / (n * (n - 1) / 2), 0), 1), 6) AS ari FROM s, a, b")
def ari(spark, sf):
    return clusters.adjusted_rand(components(spark, sf), labelled(articles(spark, sf))).select(F.round("ari", 6).alias("ari"))


@query(f"WITH c AS (SELECT count(*) AS processed, count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality = 1 AND toxic = 0) AS fp, count(*) FILTER (quality = 0 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 0) AS tn FROM labels WHERE toxic IS NOT NULL), z AS (SELECT *, {PRF} FROM c) SELECT processed, tp, fp, fn, tn, {RND} FROM z")
def confusion_metrics(spark, sf):
    m = clusters.confusion(table(spark, sf, "labels"), "quality", "toxic")
    return m.select("processed", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{LINKS}, sized AS (SELECT cluster_id, row_number() OVER (ORDER BY count(*) DESC, cluster_id) - 1 AS cluster FROM comp GROUP BY cluster_id) SELECT id, cluster_id, cluster FROM comp JOIN sized USING (cluster_id)")
def cluster_numbers(spark, sf):
    """GR4."""
    return clusters.cluster_numbers(components(spark, sf))


@query(f"{LINKS} SELECT id, cluster_id FROM comp")
def incremental_clusters(spark, sf):
    """AG8, IO18: articles from a stream of files, a micro-batch each, clustered as they come."""
    held = stage(articles(spark, sf).select("id", "text").repartition(3), "arriving")
    arriving = spark.readStream.schema(held.schema).option("maxFilesPerTrigger", 1).parquet(staged_at(held))
    tables = NearDuplicates(spark, fresh_path(spark, "near"))
    deduplicate_stream(arriving, tables, fresh_path(spark, "near-stream")).awaitTermination()
    return tables.clusters()


FOREST = f"WITH RECURSIVE {JAC[5:]}, grid AS (SELECT c::DOUBLE AS c, j::DOUBLE AS j FROM (VALUES (0.9), (0.95), (0.97)) AS g(c), (VALUES (0.0), (0.5), (0.7), (0.9)) AS k(j)), passed AS (SELECT c, j, id_a, id_b FROM grid JOIN veto ON cos >= c AND jac >= j), ways AS (SELECT c, j, id_a AS a, id_b AS b FROM passed UNION SELECT c, j, id_b, id_a FROM passed), reach AS (SELECT c, j, a AS id, a AS r FROM ways UNION SELECT reach.c, reach.j, reach.id, b FROM reach JOIN ways ON ways.c = reach.c AND ways.j = reach.j AND r = a), comp AS (SELECT c, j, id, min(r) AS cluster_id FROM reach GROUP BY ALL)"
FOREST += f""", keyed AS (SELECT *, {KEY} AS k FROM art), lab AS (SELECT id, CASE WHEN count(*) OVER (PARTITION BY k) > 1 THEN CAST(min(doc_id) OVER (PARTITION BY k) AS VARCHAR) END AS label FROM keyed),
lb AS (SELECT * FROM lab WHERE label IS NOT NULL), tru AS (SELECT coalesce(sum(n * (n - 1) // 2), 0) AS t, sum(n) AS m FROM (SELECT count(*) AS n FROM lb GROUP BY label)),
prd AS (SELECT c, j, count(*) AS n_clusters, sum(n * (n - 1) // 2) AS p FROM (SELECT c, j, count(*) AS n FROM comp GROUP BY c, j, cluster_id) GROUP BY ALL),
hit AS (SELECT c, j, sum(n * (n - 1) // 2) AS tp FROM (SELECT c, j, count(*) AS n FROM comp JOIN lb USING (id) GROUP BY c, j, cluster_id, label) GROUP BY ALL),
blk AS (SELECT c, j, sum(n * (n - 1) // 2) AS b FROM (SELECT c, j, count(*) AS n FROM comp JOIN lb USING (id) GROUP BY c, j, cluster_id) GROUP BY ALL),
pts AS (SELECT grid.c, grid.j, (SELECT count(*) FROM passed x WHERE x.c = grid.c AND x.j = grid.j) AS n_pairs, coalesce(n_clusters, 0) AS n_clusters, coalesce(tp, 0) AS tp, coalesce(p, 0) AS p, coalesce(b, 0) AS b, t, m FROM grid LEFT JOIN prd ON prd.c = grid.c AND prd.j = grid.j LEFT JOIN hit ON hit.c = grid.c AND hit.j = grid.j LEFT JOIN blk ON blk.c = grid.c AND blk.j = grid.j, tru)
SELECT c AS min_cos, j AS min_jac, n_pairs, n_clusters, tp::BIGINT AS tp, (p - tp)::BIGINT AS fp, (t - tp)::BIGINT AS fn, round(CASE WHEN p = 0 THEN 0 ELSE tp / p END, 6) AS precision, round(CASE WHEN t = 0 THEN 0 ELSE tp / t END, 6) AS recall,
  round(coalesce((tp - t * b / (m * (m - 1) / 2)) / nullif((t + b) / 2 - t * b / (m * (m - 1) / 2), 0), 1), 6) AS ari FROM pts"""


@query(FOREST)
def threshold_forest(spark, sf):
    """VE3 for components, at all points of the grid at once; pairs are counted and joined where vectors meet."""
    points = sweep_blocks(counted_vectors(spark, sf), labelled(articles(spark, sf)), GRID, 2)
    return points.select("min_cos", "min_jac", "n_pairs", "n_clusters", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ari")])


# -- synthetic copies, samples, replies, inspection

RAND = "CAST('0x' || substr(md5({}), 1, 8) AS BIGINT)"


@query(rf"WITH {ART}, s AS (SELECT id, text, string_split(regexp_replace(text, '([.!?])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)) AS p, string_split(trim(regexp_replace(text, '[\s\p{{Z}}]+', ' ', 'g')), ' ') AS w FROM art), x AS (SELECT id, string_agg(part, ' ' ORDER BY md5('42|' || id || '|' || (i - 1)), i) AS shuffled FROM (SELECT id, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM s) GROUP BY id) SELECT s.id, md5(CASE WHEN text = '' THEN text WHEN len(p) > 1 THEN shuffled WHEN len(w) > 3 THEN array_to_string(list_concat(w[1 : {RAND.format("'42|' || s.id")} % len(w)], w[{RAND.format("'42|' || s.id")} % len(w) + 2 :]), ' ') ELSE text END) AS text_md5 FROM s JOIN x ON s.id = x.id")
def synth_mutate(spark, sf):
    return articles(spark, sf).select("id", F.md5(T.mutate(F.col("text"), F.col("id"))).alias("text_md5"))


@query(f"WITH {ART} SELECT id, CAST(doc_id + 1000000 AS VARCHAR) AS new_id, 'Synthetic' AS source, id AS true_cluster_id, epoch_us(published_at) + (3600 + {RAND.format(chr(39) + 't|' + chr(39) + ' || id')} % 39601) * 1000000 AS t_us FROM art")
def synth_ids_dates(spark, sf):
    secs = 3600 + F.pmod(T.draw(F.lit("t"), F.col("id")), F.lit(39601))
    return articles(spark, sf).select("id", T.copy_id(F.col("id")).alias("new_id"), F.lit("Synthetic").alias("source"), F.col("id").alias("true_cluster_id"), (F.unix_micros("published_at") + secs * 1_000_000).alias("t_us"))


NATURAL = "NOT (ends_with({0}, '_dup') OR coalesce(TRY_CAST({0} AS BIGINT) >= 1000000, false))"
DRAWN = "CAST('0x' || substr(md5('42|{0}|' || k), 1, 15) AS BIGINT)"
EXPERT = f"""{LINKS}, nat AS (SELECT art.*, cluster_id, row_number() OVER (ORDER BY cluster_id, doc_id) - 1 AS spot FROM art JOIN comp ON art.id = comp.id WHERE {NATURAL.format('art.id')}),
cls AS (SELECT cluster_id, min(spot) AS start, count(*) AS n, (SELECT count(*) FROM nat) AS many FROM nat GROUP BY cluster_id),
cum AS (SELECT *, n * (n - 1) // 2 AS inside, n * (many - start - n) AS across FROM cls),
run AS (SELECT *, sum(inside) OVER (ORDER BY start) - inside AS ahead_in, sum(across) OVER (ORDER BY start) - across AS ahead_out, sum(inside) OVER () AS all_in, sum(across) OVER () AS all_out FROM cum),
tot AS (SELECT max(all_in)::BIGINT AS p, max(all_out)::BIGINT AS n FROM run),
ks AS (SELECT unnest(range(0, 20000)) AS k),
ranks AS (SELECT 1 AS label, r, min(k) AS k FROM (SELECT CASE WHEN tot.p <= 500 THEN k ELSE {DRAWN.format('p')} % tot.p END AS r, k FROM ks, tot WHERE tot.p > 500 OR k < tot.p) GROUP BY r QUALIFY row_number() OVER (ORDER BY min(k)) <= 500
  UNION ALL SELECT 0, r, min(k) FROM (SELECT CASE WHEN tot.n <= 500 THEN k ELSE {DRAWN.format('n')} % tot.n END AS r, k FROM ks, tot WHERE tot.n > 500 OR k < tot.n) GROUP BY r QUALIFY row_number() OVER (ORDER BY min(k)) <= 500),
numbered AS (SELECT *, row_number() OVER (ORDER BY label DESC, k) - 1 AS pair_id FROM ranks),
ins AS (SELECT pair_id, start, n, (r - ahead_in)::BIGINT AS off FROM numbered JOIN run ON label = 1 AND r >= ahead_in AND r < ahead_in + inside),
firsts AS (SELECT ins.*, i FROM ins, LATERAL (SELECT max(x) AS i FROM (SELECT unnest(range(0, ins.n)) AS x) WHERE x * (2 * ins.n - x - 1) // 2 <= ins.off)),
placed AS (SELECT pair_id, 1 AS algorithmic_label, start + i AS x, start + off - i * (2 * n - i - 1) // 2 + i + 1 AS y FROM firsts
  UNION ALL SELECT pair_id, 0, start + (r - ahead_out)::BIGINT // (many - start - n), start + n + (r - ahead_out)::BIGINT % (many - start - n) FROM numbered JOIN run ON label = 0 AND r >= ahead_out AND r < ahead_out + across),
expert AS (SELECT pair_id, algorithmic_label, CASE WHEN algorithmic_label = 1 THEN least(p.id, q.id) ELSE p.id END AS a, CASE WHEN algorithmic_label = 1 THEN greatest(p.id, q.id) ELSE q.id END AS b FROM placed JOIN nat p ON p.spot = x JOIN nat q ON q.spot = y),
told AS (SELECT e.*, 'TITLE: ' || p.title || chr(10) || chr(10) || 'CONTENT:' || chr(10) || p.text AS text_a, 'TITLE: ' || q.title || chr(10) || chr(10) || 'CONTENT:' || chr(10) || q.text AS text_b,
  row_number() OVER (ORDER BY md5('s|' || pair_id), pair_id) - 1 AS place FROM expert e JOIN art p ON p.id = a JOIN art q ON q.id = b)"""


def expert(spark, sf) -> DataFrame:
    return clusters.expert_pairs(components(spark, sf), articles(spark, sf), "doc_id")


@query(f"{EXPERT} SELECT pair_id, a AS news_id_a, b AS news_id_b, algorithmic_label, md5(text_a) AS text_a_md5, md5(text_b) AS text_b_md5, place FROM told")
def expert_pairs(spark, sf):
    """SA2, SA5, FI11, PR26: seeded samples of 500 pairs within and 500 across clusters, numbered, with their texts."""
    return expert(spark, sf).select("pair_id", "news_id_a", "news_id_b", "algorithmic_label", F.md5("text_a").alias("text_a_md5"), F.md5("text_b").alias("text_b_md5"), "place")


@query(f"{EXPERT} SELECT pair_id, a AS news_id_a, b AS news_id_b, algorithmic_label FROM told WHERE algorithmic_label = 1")
def expert_pairs_positive(spark, sf):
    return expert(spark, sf).where("algorithmic_label = 1").select("pair_id", "news_id_a", "news_id_b", "algorithmic_label")


@query(f"{EXPERT} SELECT pair_id, a AS news_id_a, b AS news_id_b, algorithmic_label FROM told WHERE algorithmic_label = 0")
def expert_pairs_negative(spark, sf):
    return expert(spark, sf).where("algorithmic_label = 0").select("pair_id", "news_id_a", "news_id_b", "algorithmic_label")


SIDE = "'Article {0}:' || chr(10) || left({1}, 1500) || '...' || chr(10) || chr(10)"


@query(f"""{EXPERT}, asked AS (SELECT place // 10 AS batch, count(*) AS n, string_agg('--- PAIR ' || (place % 10) || ' ---' || chr(10) || {SIDE.format('A', 'text_a')} || {SIDE.format('B', 'text_b')}, '' ORDER BY place) AS pairs FROM told GROUP BY ALL)
SELECT batch, n, md5('You will evaluate pairs of news articles. For each pair, answer exactly ''1'' if they are about the EXACT SAME EVENT (duplicates/rewrites), or ''0'' if they are about DIFFERENT events (or one is a broad summary and the other is a specific event). Do not output anything else except a JSON array of integers: [1, 0, ...]' || chr(10) || chr(10) || pairs || 'Output ONLY a valid JSON array of integers with exactly ' || n || ' elements. Example: [1, 0, 1].') AS prompt_md5 FROM asked""")
def llm_batch_prompts(spark, sf):
    """PR28, SA4: ten pairs to a question."""
    return judge.prompts(expert(spark, sf)).select("batch", F.size("pairs").cast("long").alias("n"), F.md5("prompt").alias("prompt_md5"))


#: Replies of one to ten labels, made of each text's digest: a list, loose figures, a list that isn't one, a list in words, and
#: one that is too long.
BITS = "transform(sequence(1, 11), i -> cast(ascii(substr(md5(text), i, 1)) % 2 as string))"
REPLY = f"""CASE doc_id % 5 WHEN 0 THEN concat('[', array_join(slice({BITS}, 1, n), ', '), ']') WHEN 1 THEN concat('labels: ', array_join(slice({BITS}, 1, n), ' then '))
  WHEN 2 THEN concat('[', {BITS}[0], ', maybe]') WHEN 3 THEN concat('Sure [', array_join(slice({BITS}, 1, n), ','), '] done 7') ELSE concat('[', array_join(slice({BITS}, 1, n + 1), ','), ']') END"""


@query(f"WITH {ART}, b AS (SELECT doc_id, 1 + doc_id % 10 AS n, list_transform(range(1, 11), lambda i: CAST(ascii(substr(md5(text), i, 1)) % 2 AS VARCHAR)) AS bits FROM art) SELECT doc_id, CASE WHEN doc_id % 5 = 2 AND n > 1 THEN array_to_string(list_transform(range(0, n), lambda i: '0'), ',') ELSE array_to_string(bits[1 : n], ',') END AS labels FROM b")
def llm_reply_parse(spark, sf):
    a = articles(spark, sf).select("doc_id", "text", (1 + F.col("doc_id") % 10).cast("int").alias("n"))
    return a.select("doc_id", F.array_join(T.reply_labels(F.expr(REPLY), F.col("n")), ",").alias("labels"))


@query(f"{CLUSTERS}, pick AS (SELECT cluster_id FROM cl WHERE n > 1 ORDER BY md5('42|' || cluster_id) LIMIT 5) SELECT comp.cluster_id, art.id, left(text, 200) AS snippet, strftime(published_at, '%Y-%m-%d') AS day FROM pick JOIN comp ON comp.cluster_id = pick.cluster_id JOIN art ON art.id = comp.id")
def inspect_multi(spark, sf):
    """SA1, FI10: five seeded clusters of several articles."""
    c = components(spark, sf)
    pick = c.groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.md5(F.concat_ws("|", F.lit("42"), "cluster_id"))).limit(5)
    a = articles(spark, sf).select("id", F.substring("text", 1, 200).alias("snippet"), F.date_format("published_at", "yyyy-MM-dd").alias("day"))
    return c.join(F.broadcast(pick.select("cluster_id")), "cluster_id").join(a, "id").select("cluster_id", "id", "snippet", "day")


@query(f"{CLUSTERS}, big AS (SELECT cluster_id FROM cl ORDER BY n DESC, cluster_id LIMIT 1) SELECT art.id, title FROM big JOIN comp ON comp.cluster_id = big.cluster_id JOIN art ON art.id = comp.id ORDER BY art.id LIMIT 20")
def inspect_largest(spark, sf):
    c = components(spark, sf)
    big = c.groupBy("cluster_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cluster_id").limit(1)
    return c.join(F.broadcast(big.select("cluster_id")), "cluster_id").join(articles(spark, sf).select("id", "title"), "id").select("id", "title").orderBy("id").limit(20)


@query(f"{CLUSTERS}, nat AS (SELECT cluster_id, count(*) AS n FROM comp WHERE NOT (CAST(id AS BIGINT) >= 1000000 OR id LIKE '%_dup') GROUP BY cluster_id HAVING count(*) > 1) SELECT cluster_id, n FROM nat")
def inspect_natural(spark, sf):
    return components(spark, sf).where(T.is_original(F.col("id"))).groupBy("cluster_id").agg(F.count("*").alias("n")).where("n > 1")


@query()
def stage_metrics(spark, sf):
    pipe, a = DedupPipeline(DedupConfig(threshold=0.9)), articles(spark, sf)
    m = pipe.stage_metrics(pipe.run(a), labelled(a))
    return m.select("stage", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "ari")])


@query()
def threshold_sweep_quality(spark, sf):
    """VE3 whole: clusters and their quality at each point of the grid, on representatives of equal signatures."""
    a = articles(spark, sf)
    m = DedupPipeline().sweep(a, labelled(a), GRID)
    return m.select("min_cos", "min_jac", "n_pairs", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "ari")])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return DedupPipeline(DedupConfig(threshold=0.9)).run(articles(spark, sf))["clusters"]


@query()
def flagship_pipeline(spark, sf):
    return flagship(spark, sf).withColumn("news_ids", F.array_join("news_ids", ","))
