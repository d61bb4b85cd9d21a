"""Validation, filters and exact-copy rules (IO2-IO5, FI1-FI6, FI13, FI14, AG5-AG8, AG17, AG18, PR25)."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sameword.functions import text as T
from sameword.operators.order import numbered
from sameword.operators.salted import meet
from sameword.operators.sieve import flagged, maybe_in
from sameword.shared import stage

# What a failed scrape looks like (FI1), and the shorter list (FI2).
BROKEN = (
    "Yahoo on osa",
    "Just a moment...",
    "Access to this page has been denied",
    "Target URL returned error",
    "Prices of cryptocurrencies",
    "Markdown Content: Before we continue",
)
BROKEN_SHORT = (
    "Yahoo on osa",
    "Just a moment...",
    "Access to this page has been denied",
)


def article_time(c: Column) -> Column:
    """ISO dates, with a zone or in the session's, and seconds since 1970; null for anything else."""
    seconds = F.when(c.rlike(r"^-?\d+(\.\d+)?$"), F.timestamp_micros((c.try_cast("decimal(20,6)") * 1_000_000).cast("long")))
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}($|[T ])"), F.try_to_timestamp(c)).otherwise(seconds)


def validate(raw: DataFrame) -> DataFrame:
    """IO5: rows of the article schema; a row whose required field is null or whose label is no integer goes."""
    made = raw.withColumns({"ts": article_time(F.col("published_at")), "label": F.col("true_cluster_id").try_cast("bigint")})
    ok = F.col("id").isNotNull() & F.col("title").isNotNull() & F.col("text").isNotNull() & F.col("source").isNotNull() & F.col("ts").isNotNull()
    ok &= F.col("true_cluster_id").isNull() | F.col("label").isNotNull()
    return made.where(ok).select("id", "title", "text", "source", F.col("ts").alias("published_at"), F.col("label").alias("true_cluster_id"))


def union_limit(a: DataFrame, b: DataFrame, limit: int | None, order: str) -> DataFrame:
    """IO2, IO3: half the limit, rounded down, from each."""
    if limit is not None:
        a, b = a.orderBy(order).limit(limit // 2), b.orderBy(order).limit(limit // 2)
    return a.unionByName(b, allowMissingColumns=True)


def ground_truth(articles: DataFrame) -> DataFrame:
    """PR25: an article whose id is a label, or that has one, is labelled; labels are strings."""
    named = articles.select(F.col("true_cluster_id").cast("string").alias("g")).where("g is not null").distinct()
    return articles.join(named, F.col("id") == F.col("g"), "left").withColumn("label", F.coalesce(F.col("true_cluster_id").cast("string"), "g")).drop("g")


def not_broken(rows: DataFrame, text: str = "text", markers: Iterable[str] = BROKEN) -> DataFrame:
    return rows.where(~reduce(lambda a, b: a | b, [F.col(text).contains(m) for m in markers]))


def not_synthetic(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("source").eqNullSafe("Synthetic"))


def long_enough(rows: DataFrame, text: str = "text", least: int = 100) -> DataFrame:
    return rows.where(F.length(T.strip(F.col(text))) >= least)


#: Lines of up to so many characters, stripped, are in no dictionary.
SHORT = 15


def long_lines(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos (from 0), line: the stripped lines that a dictionary can hold."""
    lines = rows.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("pos", "line")).withColumn("line", T.strip(F.col("line")))
    return lines.where(F.length("line") > SHORT)


def frequent_lines(rows: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """AG19: line, df: lines that at least `least` documents have. They are counted by digests, each document's once,
    with partial counts before anything moves; texts are looked up for digests that are frequent enough only."""
    lines = long_lines(rows, id_col, text_col).select(id_col, "line", digest(F.col("line")).alias("_k"))
    counts = lines.select(id_col, "_k").distinct().groupBy("_k").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= least)
    counts = stage(counts, "frequent-lines")
    texts = maybe_in(lines.select("_k", "line"), counts, "_k").groupBy("_k").agg(F.min("line").alias("line"))
    return texts.join(counts, "_k").select("line", "df")


def drop_known_lines(rows: DataFrame, id_col: str, text_col: str, known: DataFrame) -> DataFrame:
    """PR2 for a dictionary (line) of any size. A text whose lines all go is empty. Identifiers are unique.

    Short lines never leave their text, and of the others only those that a bitmap of the dictionary lets pass are moved, as
    digests; the rows of a line meet the dictionary in parts. Then texts that lose a line are joined with the places of
    those; other texts stay where they are."""
    keys = stage(known.where(F.length("line") > SHORT).select(digest(F.col("line")).alias("_k")).distinct(), "known-lines")
    lines = long_lines(rows, id_col, text_col).select(F.col(id_col).alias("_id"), "pos", digest(F.col("line")).alias("_k"))
    maybe = stage(maybe_in(lines, keys, "_k"), "maybe-known")
    lost = stage(meet(maybe, keys, ["_k"], ["_id", "pos"]).groupBy("_id").agg(F.collect_set("pos").alias("_lost")), "lost-lines")
    split = flagged(rows, lost.withColumnRenamed("_id", id_col), "_hit", id_col)
    kept = F.array_join(F.filter(F.split(text_col, "\n"), lambda x, i: ~F.array_contains("_lost", i)), "\n")
    hit = split.where("_hit").join(lost, F.col(id_col) == F.col("_id"), "left").withColumn(text_col, F.when(F.col("_lost").isNull(), F.col(text_col)).otherwise(kept))
    return split.where("not _hit").drop("_hit").unionByName(hit.select(*rows.columns))


def up_to(rows: DataFrame, have: int, target: int, order: str) -> DataFrame:
    """FI13: so many more rows, in order, that the target is met."""
    return rows.orderBy(order).limit(max(0, target - have))


def shuffled(rows: DataFrame, order: str, seed: str = "42") -> DataFrame:
    """IO4: a permutation that a seed fixes."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(order).cast("string"))), order)


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """AG5, AG8: of each key the first in order. Only key and order are moved before rows are chosen."""
    first = rows.groupBy(key.alias("_k")).agg(F.min(order).alias("_o")).select("_o")
    return rows.join(first, F.col(order) == F.col("_o"), "left_semi")


def digest(key: Column) -> Column:
    """What stands for a key of any length; null for null."""
    return F.unhex(F.sha2(key, 256))


def merge_labels(rows: DataFrame, key: Column, order: str, least: int = 50) -> DataFrame:
    """AG6: every row gets the label of its key's first holder, or that one's identifier where it has none or 0. Keys of up
    to `least` characters (and null ones) don't merge: their rows keep their own label, or get their own identifier. `order`
    is unique. Only it, labels and digests of keys move for that; copies of one key meet its first holder in parts."""
    own = F.coalesce(F.when(F.col("true_cluster_id") != 0, F.col("true_cluster_id")), F.col(order))
    k = stage(rows.select(F.col(order).alias("_o"), digest(F.when(F.length(key) > least, key)).alias("_k"), own.alias("_own")).where("_k is not null"), "merge-keys")
    first = k.groupBy("_k").agg(F.min_by("_own", "_o").alias("_l"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    labels = meet(k, first, ["_k"], ["_o"]).select("_o", "_l")
    return rows.join(labels, F.col(order) == F.col("_o"), "left").withColumn("true_cluster_id", F.coalesce(F.col("_l"), own)).drop("_o", "_l")


def merge_later(rows: DataFrame, key: Column, order: str, absent: Column | None = None) -> DataFrame:
    """AG7: later holders get the first one's label as it is, null too; the first row stays untouched. absent: where the
    first holder's record has no label at all, not even null, its identifier is the label. Null keys are one key. `order` is
    unique; what moves is as in merge_labels()."""
    label = F.when(F.lit(False) if absent is None else absent, F.col(order)).otherwise(F.col("true_cluster_id"))
    k = stage(rows.select(F.col(order).alias("_o"), digest(key).alias("_k"), label.alias("_own")), "merge-keys")
    first = k.groupBy("_k").agg(F.min_by(F.struct(F.col("_own").alias("l")), "_o").alias("_l"), F.min("_o").alias("_first"))
    later = meet(k, first, ["_k"], ["_o"]).where("_o <> _first").select("_o", "_l")
    return rows.join(later, F.col(order) == F.col("_o"), "left").withColumn("true_cluster_id", F.when(F.col("_l").isNull(), F.col("true_cluster_id")).otherwise(F.col("_l.l"))).drop("_o", "_l")


def reported(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """AG17, AG18: the rows, and their count (get["rows"]) once something has run over them."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def unseen(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """FI6, IO17, JO5."""
    return rows.join(seen.select(key).distinct(), key, "left_anti")


def undone(rows: DataFrame, batch: str, label: str) -> DataFrame:
    """FI14: rows of batches that lack a label; a batch that has some of them comes back whole."""
    open_ = rows.groupBy(batch).agg(F.count(label).alias("_l"), F.count("*").alias("_n")).where("_l < _n").select(F.col(batch).alias("_b"))
    return rows.join(open_, F.col(batch).eqNullSafe(F.col("_b")), "left_semi")


def dense_ids(rows: DataFrame, order: str, after: int = 0) -> DataFrame:
    """PR29: numbers after `after`, in order."""
    return numbered(rows, order, name="new_id").withColumn("new_id", F.col("new_id") + after + 1)
