"""Clusters: restoring collapsed rows, canonical articles, outputs, pairs for experts, and their quality (JO3, JO7, JO8,
AG9-AG16, SA2, SA5, SE1-SE2)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sameword.functions import text as T
from sameword.operators.order import numbered, running
from sameword.operators.salted import meet
from sameword.shared import stage


def restore(assigned: DataFrame, groups: DataFrame) -> DataFrame:
    """JO3: cluster of every member, from clusters of those that stand for them."""
    return assigned.join(groups, F.col("id") == F.col("rep_id")).select(F.col("member_id").alias("id"), "cluster_id")


def canonical(assigned: DataFrame, articles: DataFrame) -> DataFrame:
    """AG9: cluster_id, canonical_id: the earliest, ties by id."""
    return assigned.join(articles.select("id", "published_at"), "id").groupBy("cluster_id").agg(F.min(F.struct("published_at", "id")).alias("m")).select("cluster_id", F.col("m.id").alias("canonical_id"))


def cluster_rows(assigned: DataFrame, articles: DataFrame) -> DataFrame:
    """IO8: cluster_id, canonical_news_id, news_ids."""
    a = assigned.join(articles.select("id", "published_at"), "id")
    return a.groupBy("cluster_id").agg(F.min(F.struct("published_at", "id")).alias("m"), F.array_sort(F.collect_list("id")).alias("news_ids")).select("cluster_id", F.col("m.id").alias("canonical_news_id"), "news_ids")


def pairs_within(rows: DataFrame, group: str, id_col: str = "id") -> DataFrame:
    """JO7: unordered pairs of a group, smaller string first; a metric over labelled groups asks for all of them."""
    a, b = rows.select(group, F.col(id_col).alias("id_a")), rows.select(group, F.col(id_col).alias("id_b"))
    return a.join(b, group).where("id_a < id_b").select("id_a", "id_b").distinct()


def missed_pairs(labelled: DataFrame, assigned: DataFrame) -> DataFrame:
    """id_a, id_b: the pairs of one label (id, label) that lie in two clusters (id, cluster_id), or of which one has no cluster;
    smaller string first. A label's parts by cluster meet first and then their rows, so that no pair of one cluster is made,
    however many copies it has."""
    one = labelled.where("label is not null and id is not null").select("id", "label").distinct()
    alone = F.when(F.col("cluster_id").isNull(), F.col("id"))  # a part of its own
    rows = stage(one.join(assigned.select("id", "cluster_id").distinct(), "id", "left").select("id", "label", F.struct(F.col("cluster_id").alias("c"), alone.alias("own")).alias("part")), "label-parts")
    parts = rows.select("label", "part").distinct()
    met = parts.join(parts.select("label", F.col("part").alias("part_b")), "label").where("part < part_b")
    a, b = rows.select("label", "part", F.col("id").alias("x")), rows.select("label", F.col("part").alias("part_b"), F.col("id").alias("y"))
    found = met.join(a, ["label", "part"]).join(b, ["label", "part_b"]).where("x <> y")
    return found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def drawn_ranks(total: int, most: int, tag: str, seed: str) -> list[int]:
    """Up to `most` different numbers under total, in the order they are drawn; all of them if there are no more."""
    if total <= most:
        return list(range(total))
    out: dict[int, None] = {}
    k = 0
    while len(out) < most:  # a number that is there already is drawn again
        out.setdefault(int(hashlib.md5(f"{seed}|{tag}|{k}".encode()).hexdigest()[:15], 16) % total)
        k += 1
    return list(out)


def unranked(off: int, n: int) -> tuple[int, int]:
    """The pair i < j of n things that is number `off` in the order of (i, j)."""
    i = n - 2 - (math.isqrt(4 * n * (n - 1) - 8 * off - 7) - 1) // 2
    return i, off - i * (2 * n - i - 1) // 2 + i + 1


def sampled_pairs(placed: DataFrame, most: int, seed: str) -> list[tuple[int, int, int, int]]:
    """(pair_id, label, place, place): `most` pairs of one cluster (label 1) and `most` of two (0), drawn evenly from all
    such pairs, of which none is listed. placed: cluster_id, place, clusters side by side.

    Pairs are numbered by the clusters' order: a cluster of n rows has n (n - 1) / 2 inside, and n times as many rows as
    come after it across. A drawn number is looked for in the running sums of these; only what is found, at most 2 most
    rows, comes to the driver. Numbers are of 64 bits: sums of up to 2^63 pairs."""
    rows = placed.agg(F.count(F.lit(1))).first()[0]
    sized = placed.groupBy("cluster_id").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("n"))
    n, after = F.col("n"), F.lit(rows) - F.col("start") - F.col("n")
    counted = stage(running(sized.withColumns({"inside": F.expr("n * (n - 1) div 2"), "across": n * after}), {"ahead_1": F.col("inside"), "ahead_0": F.col("across")}, "start"), "pair-counts")
    totals = counted.agg(F.coalesce(F.sum("across"), F.lit(0)), F.coalesce(F.sum("inside"), F.lit(0))).first()
    drawn = {1: drawn_ranks(totals[1], most, "p", seed), 0: drawn_ranks(totals[0], most, "n", seed)}
    wanted = {label: np.sort(np.array(ranks, np.int64)) for label, ranks in drawn.items()}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, *sides = (c.to_numpy() for c in batch.columns)
            for label, (count, ahead) in {1: sides[:2], 0: sides[2:]}.items():
                low, high = np.searchsorted(wanted[label], ahead), np.searchsorted(wanted[label], ahead + count)
                hit = np.flatnonzero(high > low)
                many = (high - low)[hit]
                at = np.repeat(low[hit] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                of = np.repeat(hit, many)
                ranks = wanted[label][at]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), label, np.int64)), pa.array(ranks), pa.array(ranks - ahead[of]), pa.array(start[of]), pa.array(size[of])], ["label", "rank", "off", "start", "n"])

    found = {(r.label, r.rank): r for r in counted.select("start", "n", "inside", "ahead_1", "across", "ahead_0").mapInArrow(look, "label bigint, rank bigint, off bigint, start bigint, n bigint").collect()}
    out = []
    for label in (1, 0):
        for rank in drawn[label]:
            r = found[label, rank]
            if label:
                i, j = unranked(r.off, r.n)
                i, j = r.start + i, r.start + j
            else:
                i, j = r.start + r.off // (rows - r.start - r.n), r.start + r.n + r.off % (rows - r.start - r.n)
            out.append((len(out), label, i, j))
    return out


def expert_pairs(assigned: DataFrame, articles: DataFrame, order: str, most: int = 500, seed: str = "42") -> DataFrame:
    """pair_id, news_id_a, news_id_b, text_a, text_b, algorithmic_label, place (SA2, SA5, JO8, FI11, PR26).

    Seeded samples of `most` pairs of natural articles of one cluster, then of several, all there are if fewer; place is the
    shuffled order in which they are judged. order: a column that numbers the articles, unique. An article without a cluster
    takes no part."""
    nat = articles.where(T.is_original(F.col("id"))).join(assigned, "id").select("id", order, "cluster_id").where("cluster_id is not null")
    placed = stage(numbered(nat, "cluster_id", order), "natural-places")
    pairs = sampled_pairs(placed, most, seed)
    ends = placed.sparkSession.createDataFrame([(p, label, end, side) for p, label, *ends in pairs for side, end in enumerate(ends)], "pair_id bigint, label int, place bigint, side int")
    told = placed.join(F.broadcast(ends), "place").select("pair_id", "label", "side", "id")
    told = told.join(articles.select("id", T.pair_text(F.col("title"), F.col("text")).alias("t")), "id")
    both = told.groupBy("pair_id", "label").agg(F.array_sort(F.collect_list(F.struct("side", "id", "t"))).alias("s"))
    # within a cluster the smaller identifier is the first of the pair
    turn = (F.col("label") == 1) & (F.col("s")[0]["id"] > F.col("s")[1]["id"])
    a, b = F.when(turn, F.col("s")[1]).otherwise(F.col("s")[0]), F.when(turn, F.col("s")[0]).otherwise(F.col("s")[1])
    place = F.row_number().over(W.orderBy(F.md5(F.concat(F.lit("s|"), F.col("pair_id").cast("string"))), "pair_id")) - 1
    out = both.select("pair_id", a.alias("a"), b.alias("b"), "label").withColumn("place", place.cast("long"))
    return out.select("pair_id", F.col("a.id").alias("news_id_a"), F.col("b.id").alias("news_id_b"), F.col("a.t").alias("text_a"), F.col("b.t").alias("text_b"), F.col("label").alias("algorithmic_label"), "place")


def cluster_numbers(assigned: DataFrame) -> DataFrame:
    """GR4: id, cluster_id and cluster, the clusters' number from 0, the largest first, ties by cluster_id."""
    sized = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    return meet(stage(assigned, "assigned"), numbered(sized, F.desc("n"), "cluster_id", name="cluster").drop("n"), ["cluster_id"], ["id"])


def titled(ids: DataFrame, articles: DataFrame) -> DataFrame:
    """PR32: ids with title: 'No Title' where the article has none, 'Unknown Article' where there is no such article."""
    known = articles.select("id", F.coalesce("title", F.lit("No Title")).alias("title"))
    return ids.join(known, "id", "left").withColumn("title", F.coalesce("title", F.lit("Unknown Article")))


def error_view(false_positives: DataFrame, false_negatives: DataFrame, articles: DataFrame, most: int = 5) -> DataFrame:
    """PR22: kind (FP, FN), place (from 1), id_a, id_b, view_a, view_b: the first pairs of each kind by identifiers. A false
    positive shows its titles and 800 characters of its texts, a false negative 300 of title and text together."""
    first = lambda pairs, kind: pairs.select("id_a", "id_b").orderBy("id_a", "id_b").limit(most).withColumn("kind", F.lit(kind))
    few = first(false_positives, "FP").unionByName(first(false_negatives, "FN"))
    few = few.withColumn("place", F.row_number().over(W.partitionBy("kind").orderBy("id_a", "id_b")))
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    views = articles.select("id", F.concat(title, F.lit(". "), F.substring(text, 1, 800), F.lit("...")).alias("long"), F.concat(F.substring(T.title_and_text(title, text), 1, 300), F.lit("...")).alias("short"))
    for x in ("a", "b"):
        own = views.select(F.col("id").alias(f"id_{x}"), F.col("long"), F.col("short"))
        few = few.join(own, f"id_{x}", "left").withColumn(f"view_{x}", F.when(F.col("kind") == "FP", F.col("long")).otherwise(F.col("short"))).drop("long", "short")
    return few.select("kind", "place", "id_a", "id_b", "view_a", "view_b")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """AG14: 0 where there is nothing to divide by."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def pair_metrics(assigned: DataFrame, labelled: DataFrame) -> DataFrame:
    """AG15, from counts instead of pairs: predicted pairs of all rows, true pairs of labelled rows, and their overlap."""
    two = lambda c: (c * (c - 1) / 2).cast("long")
    count = lambda df, *by: df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(two(F.col("n"))), F.lit(0)).alias("s"))
    both = assigned.join(labelled.where("label is not null").select("id", "label"), "id")
    pred = count(assigned, "cluster_id").withColumnRenamed("s", "pred")
    true = count(labelled.where("label is not null"), "label").withColumnRenamed("s", "true")
    hit = count(both, "cluster_id", "label").withColumnRenamed("s", "tp")
    one = hit.join(pred, F.lit(True), "left").join(true, F.lit(True), "left")
    out = one.select("tp", (F.col("pred") - F.col("tp")).alias("fp"), (F.col("true") - F.col("tp")).alias("fn"))
    return out.select("tp", "fp", "fn", *scores(F.col("tp"), F.col("fp"), F.col("fn")))


def adjusted_rand(assigned: DataFrame, labelled: DataFrame) -> DataFrame:
    """AG16 over labelled rows; a row without a cluster has cluster -1."""
    t = labelled.where("label is not null").join(assigned, "id", "left").select("label", F.coalesce(F.col("cluster_id").cast("string"), F.lit("-1")).alias("pred"))
    cells = t.groupBy("label", "pred").agg(F.count("*").alias("n"))
    two = lambda c: c * (c - 1) / 2
    s = cells.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    a = cells.groupBy("label").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("a"))
    b = cells.groupBy("pred").agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("b"))
    every = F.col("a") * F.col("b") / F.nullif(two(F.col("n")), F.lit(0))
    one = s.join(a, F.lit(True), "left").join(b, F.lit(True), "left")
    return one.select(F.coalesce((F.col("s") - every) / F.nullif((F.col("a") + F.col("b")) / 2 - every, F.lit(0)), F.lit(1.0)).alias("ari"))


def grid_metrics(assigned: DataFrame, labelled: DataFrame, by: list[str]) -> DataFrame:
    """AG15 and AG16 of several clusterings at once, one row of each `by`: tp, fp, fn, precision, recall, f1, ari. assigned
    (by, id, cluster_id) may leave out articles that are alone in their cluster, but has a row of each `by`."""
    two = lambda c: (c * (c - 1) / 2).cast("long")
    sums = lambda cells, name: cells.groupBy(*by).agg(F.coalesce(F.sum(two(F.col("n"))), F.lit(0)).alias(name))
    count = lambda df, *more: df.groupBy(*by, *more).agg(F.count(F.lit(1)).alias("n"))
    lab = labelled.where("label is not null").select("id", "label")
    both = stage(assigned.join(lab, "id"), "grid-labelled")
    out = sums(count(assigned, "cluster_id"), "pred")
    for cells, name in ((count(both, "cluster_id", "label"), "tp"), (count(both, "cluster_id"), "b")):
        out = out.join(sums(cells, name), by, "left").na.fill(0, [name])
    labels = lab.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(two(F.col("n"))), F.lit(0)).alias("true"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    out = out.join(labels, F.lit(True), "left")
    tp, fp, fn = F.col("tp"), F.col("pred") - F.col("tp"), F.col("true") - F.col("tp")
    every = F.col("true") * F.col("b") / F.nullif(two(F.col("n")), F.lit(0))
    ari = F.coalesce((tp - every) / F.nullif((F.col("true") + F.col("b")) / 2 - every, F.lit(0)), F.lit(1.0))
    return out.select(*by, "tp", fp.alias("fp"), fn.alias("fn"), *scores(tp, fp, fn), ari.alias("ari"))


def confusion(rows: DataFrame, pred: str, truth: str) -> DataFrame:
    """AG13: null truths are skipped; other labels count in processed only."""
    r = rows.where(F.col(truth).isNotNull())
    c = lambda p, t: F.count_if((F.col(pred) == p) & (F.col(truth) == t))
    got = r.agg(F.count("*").alias("processed"), c(1, 1).alias("tp"), c(1, 0).alias("fp"), c(0, 1).alias("fn"), c(0, 0).alias("tn"))
    return got.select("*", *scores(F.col("tp"), F.col("fp"), F.col("fn")))
