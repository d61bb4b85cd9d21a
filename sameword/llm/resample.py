"""Importance resampling towards a target: hashed n-gram counts by DuckDB in each partition, merged and scored by Spark.

A task opens a DuckDB of its own, cuts a batch's texts into words, makes n-grams by SQL windows and takes each distinct
n-gram's bucket from a registered CRC-32 function. Each document's bucket counts are spilled to a Parquet table in the
shared folder; Spark adds them up to the totals of a bucket, makes gains of them, and scores and ranks the documents.

Defined cases: a null text has no words; a document without words has no features and weight 0; a null identifier sorts
last and is hashed as an empty one; repeated rows are documents of their own; an empty table gives an empty result, and an
empty target one with T = 0; other columns are ignored, whatever their names. Very long texts go through SQL in pieces.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.llm.arrow import small_batches
from sameword.llm.locate import Located, with_locator
from sameword.operators.order import numbered
from sameword.shared import stage

BUCKETS = 10_000
#: What is drawn of the documents with enough words, in hundredths.
PERCENT = 10
LEAST_WORDS = 20
SEED = "2024"
#: Characters of a piece of a long text, and of the pieces that one SQL statement takes.
PIECE, AT_ONCE = 1 << 20, 1 << 22
#: Memory of a task's DuckDB. It has no folder to spill to: what it is given at once is bounded.
MEMORY = "512MB"
WORD = re.compile("[0-9a-z\x80-\U0010ffff]+", re.ASCII)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(text: str, n: int) -> Iterator[tuple[int, str]]:
    """(skip, piece): a text cut between words. A piece begins with up to n - 1 words of the one before, which are skipped:
    only n-grams that end behind them are its own."""
    if len(text) <= PIECE:
        yield 0, text
        return
    low, at, held = text.translate(str.maketrans(UPPER, LOWER)), 0, []
    while at < len(low):
        end = at + PIECE
        while end < len(low) and WORD.match(low, end):  # to the end of the word that is cut
            end = WORD.match(low, end).end()
        piece, at = low[at:end], end
        yield len(held), " ".join([*held, piece])
        if n > 1:
            held = [*held, *WORD.findall(piece)][1 - n :]


def statement(n: int, buckets: int) -> str:
    """SQL over batch (row, piece, skip, text): row, bucket, n, ordered by row and bucket; bucket -1 holds the words."""
    grams = ["SELECT row, w AS g FROM words WHERE pos > skip"]
    for k in range(2, n + 1):
        grams.append(
            f"SELECT row, g FROM (SELECT row, skip, pos, string_agg(w, ' ') OVER ahead AS g, count(*) OVER ahead AS size FROM words "
            f"WINDOW ahead AS (PARTITION BY piece ORDER BY pos ROWS BETWEEN CURRENT ROW AND {k - 1} FOLLOWING)) WHERE size = {k} AND pos + {k - 1} > skip"
        )
    return rf"""
WITH cut AS (SELECT row, piece, skip, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM batch),
words AS {"MATERIALIZED" if n > 1 else "NOT MATERIALIZED"} (SELECT row, piece, skip, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM cut),
tf AS MATERIALIZED (SELECT row, g, count(*) AS n FROM ({" UNION ALL ".join(grams)}) GROUP BY ALL),
code AS (SELECT g, crc(g) % {buckets} AS bucket FROM (SELECT DISTINCT g FROM tf))
SELECT row, bucket, sum(n)::BIGINT AS n FROM tf JOIN code USING (g) GROUP BY row, bucket
UNION ALL SELECT row, -1, sum(greatest(len(ws) - skip, 0))::BIGINT FROM cut GROUP BY row HAVING sum(greatest(len(ws) - skip, 0)) > 0
ORDER BY row, bucket"""


def crc(words: pa.Array) -> pa.Array:
    found = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    return pa.array([zlib.crc32(x) for x in found.cast(pa.binary()).to_pylist()], pa.int64())


def database():
    import duckdb

    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    con.create_function("crc", crc, ["VARCHAR"], "BIGINT", type="arrow")
    return con


def counted(con, sql: str, texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """row, bucket, count of a batch's texts, by row and bucket."""
    done: list[pa.Table] = []
    rows, skips, cut, size = [], [], [], 0

    def flush() -> None:
        nonlocal size
        if rows:
            con.register("batch", pa.table({"row": pa.array(rows, pa.int64()), "piece": pa.array(range(len(rows)), pa.int64()), "skip": pa.array(skips, pa.int64()), "text": pa.array(cut, pa.string())}))
            done.append(con.sql(sql).to_arrow_table())
            con.unregister("batch")
        rows.clear(), skips.clear(), cut.clear()
        size = 0

    for row, text in enumerate(texts):
        for skip, piece in pieces(text or "", n):
            rows.append(row), skips.append(skip), cut.append(piece)
            size += len(piece)
            if size >= AT_ONCE:
                flush()
    flush()
    at, bucket, count = (np.concatenate([t.column(k).to_numpy() for t in done]).astype(np.int64) if done else np.zeros(0, np.int64) for k in range(3))
    if len(done) > 1:  # a text's pieces may be in several statements
        order = np.lexsort((bucket, at))
        at, bucket, count = at[order], bucket[order], count[order]
        first = np.flatnonzero(np.r_[True, (np.diff(at) != 0) | (np.diff(bucket) != 0)])
        at, bucket, count = at[first], bucket[first], np.add.reduceat(count, first)
    return at, bucket, count


def bucket_counts(docs: DataFrame, text_col: str = "text", n: int = 1, buckets: int = BUCKETS, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns `keep` of each document, n_words, n_features, and its n-grams' buckets with their counts: words of the
    lower-cased (A-Z) text, runs of 1 to n of them, joined by a space. `keep` has long columns."""
    small_batches(docs.sparkSession)
    sql = statement(n, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = database()
        try:
            for batch in batches:
                many = batch.num_rows
                at, bucket, count = counted(con, sql, batch.column(0).to_pylist(), n)
                words = np.zeros(many, np.int64)
                words[at[bucket < 0]] = count[bucket < 0]
                own = bucket >= 0
                at, bucket, count = at[own], bucket[own], count[own]
                ends = pa.array(np.searchsorted(at, np.arange(many + 1)), pa.int32())
                total = np.bincount(at, weights=count, minlength=many).astype(np.int64)
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (bucket, count)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(words), pa.array(total), *lists], [*keep, "n_words", "n_features", "buckets", "counts"])
        finally:
            con.close()

    kept = "".join(f"`{c}` bigint, " for c in keep)
    return docs.select(F.col(text_col), *[F.col(c) for c in keep]).mapInArrow(run, f"{kept}n_words bigint, n_features bigint, buckets array<int>, counts array<int>")


def totals(counts: DataFrame) -> DataFrame:
    """bucket, n over all documents; a task sends one row for each bucket at most."""
    pairs = counts.select(F.explode(F.arrays_zip("buckets", "counts")).alias("p"))
    return pairs.groupBy(F.col("p.buckets").alias("bucket")).agg(F.sum("p.counts").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain of every bucket: a thousand times the logarithm of its smoothed share in the target over that in the
    corpus, rounded down. corpus and target are totals()."""
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    each = every.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    for name, all_of in (("s_all", corpus), ("t_all", target)):
        each = each.join(all_of.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name)), F.lit(True), "left")
    s, t, s_all, t_all = (F.col(c).cast("double") for c in ("s", "t", "s_all", "t_all"))
    return each.select("bucket", F.floor(1000 * F.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))).alias("gain"))


def noise(id_: Column, seed: str = SEED) -> Column:
    """A Gumbel draw in thousandths, rounded down, fixed by the seed and the identifier."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame | Located, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 1, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """One row per document: id, file, row (its locator), n_features, weight, score, rank. Of the documents with at least
    `least_words` words, floor(percent * N / 100) have a rank, by score; ties go to the smaller identifier, then to fewer
    features. The gains, `buckets` numbers, are part of the plan: a bound by the parameter, whatever the corpus."""
    at = docs if isinstance(docs, Located) else with_locator(docs.select(F.col(id_col), F.col(text_col)))
    rows = at.rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(at.file).alias("file"), F.col(at.row).alias("row"))
    counts = stage(bucket_counts(rows, "text", n, buckets, ("id", "file", "row")), "resample-counts")
    wanted = stage(bucket_counts(target.select(F.col(text_col).alias("text")), "text", n, buckets), "resample-target")
    gain = [r.gain for r in gains(totals(counts), totals(wanted), buckets).orderBy("bucket").collect()]
    table = F.from_json(F.lit(str(gain)), "array<bigint>")
    parts = F.zip_with("buckets", "counts", lambda b, c: table[b] * c)
    weighed = counts.select("id", "file", "row", "n_features", F.aggregate(parts, F.lit(0).cast("bigint"), lambda x, y: x + y).alias("weight"), (F.col("n_words") >= least_words).alias("fit"))
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    placed = numbered(scored, F.desc("fit"), F.desc("score"), F.asc_nulls_last("id"), "n_features")
    drawn = placed.where("fit").count() * percent // 100
    rank = F.when(F.col("fit") & (F.col("place") < drawn), F.col("place") + 1)
    return placed.select("id", "file", "row", "n_features", "weight", "score", rank.alias("rank"))


def sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The drawn rows of docs, its columns unchanged."""
    at = with_locator(docs)
    drawn = resample(at, target, id_col, text_col, **how).where("rank is not null").select(F.col("file").alias(at.file), F.col("row").alias(at.row))
    return at.rows.join(stage(drawn, "resample-drawn"), at.place, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def op11_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target).select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


#: The CRC of a word's bytes goes by a table of 256 that range() and eight steps make.
ORACLE = r"""
WITH tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
doc_words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM documents),
target_words AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark),
every AS (SELECT DISTINCT w FROM (SELECT w FROM doc_words UNION ALL SELECT w FROM target_words)),
code AS (SELECT w, xor(4294967295, list_reduce(list_transform(range(0, strlen(w)), lambda i: ('0x' || substr(hex(encode(w)), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(t[xor(c, b) % 256 + 1], c >> 8), 4294967295::BIGINT)) % 10000 AS bucket FROM every, tab),
s AS (SELECT bucket, count(*) AS s FROM doc_words JOIN code USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_words JOIN code USING (w) GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM doc_words) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT count(*) FROM target_words) + 10000)::DOUBLE)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
weighed AS (SELECT doc_id, count(*) AS n, sum(gain)::BIGINT AS weight FROM doc_words JOIN code USING (w) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM documents d LEFT JOIN weighed w ON w.doc_id = d.doc_id),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS many FROM scored WHERE n_features >= 20)
SELECT scored.doc_id, n_features, weight, score, CASE WHEN r <= many * 10 // 100 THEN r END AS rank FROM scored LEFT JOIN ranked ON ranked.doc_id = scored.doc_id
"""
