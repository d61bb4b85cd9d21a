"""The pipeline from the command line (IO21, OR3, SO3): python -m sameword.cli --input articles.json --output kept"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.config import DedupConfig
from sameword.operators import clusters, ingest
from sameword.plans.pipeline import DedupPipeline, load
from sameword.sources.readers import write_canonical, write_clusters

log = logging.getLogger("sameword")


def parser() -> argparse.ArgumentParser:
    d = DedupConfig()
    p = argparse.ArgumentParser(description="Find and cluster near-duplicate articles")
    p.add_argument("--input", required=True, help="articles: a JSON array or JSON lines")
    p.add_argument("--dup_input", help="labelled copies, in the same form")
    p.add_argument("--model_path", default=d.embedder_name, help="the embedder's name; only the stand-in is built in")
    p.add_argument("--limit", type=int, help="of all rows; with --dup_input half from each file")
    p.add_argument("--threshold", type=float, default=d.threshold)
    p.add_argument("--time_window", type=int, default=d.time_window_days, help="whole days")
    p.add_argument("--minhash_threshold", type=float, default=d.minhash_threshold)
    p.add_argument("--reranker_path", default=d.scorer_name, help="the pair scorer's name; disabled or empty turns it off")
    p.add_argument("--cross_threshold", type=float, default=d.cross_threshold)
    p.add_argument("--boilerplate", help="a JSON array of lines to remove")
    p.add_argument("--vector_cache", help="a folder that keeps vectors")
    p.add_argument("--score_cache", help="a folder that keeps pair scores")
    p.add_argument("--output", required=True, help="folder for canonical articles")
    p.add_argument("--clusters_output", required=True, help="folder for clusters")
    return p


def config(a: argparse.Namespace) -> DedupConfig:
    d, off = DedupConfig(), not a.reranker_path or a.reranker_path.lower() == "disabled"
    for given, known in ((a.model_path, d.embedder_name), (a.reranker_path, None if off else d.scorer_name)):
        if known and given != known:
            raise SystemExit(f"no model named {given} is built in; give DedupPipeline one from Python")
    return DedupConfig(
        threshold=a.threshold, time_window_days=a.time_window, minhash_threshold=a.minhash_threshold, cross_threshold=a.cross_threshold, rerank=not off,
        limit=a.limit, boilerplate_path=a.boilerplate, vector_cache=a.vector_cache, score_cache=a.score_cache,
    )


def top_clusters(rows: DataFrame, articles: DataFrame, k: int = 5) -> DataFrame:
    """SO3: the k largest clusters: cluster_id, size, canonical_news_id, title."""
    sized = rows.select("cluster_id", F.size("news_ids").alias("size"), "canonical_news_id").orderBy(F.desc("size"), "cluster_id").limit(k)
    return sized.join(articles.select(F.col("id").alias("canonical_news_id"), "title"), "canonical_news_id").orderBy(F.desc("size"), "cluster_id")


def run(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame] | None:
    cfg = config(a)
    articles, seen = ingest.reported(ingest.ground_truth(load(spark, a.input, a.dup_input, cfg)), "loaded")
    pipe = DedupPipeline(cfg)
    done = pipe.run(articles)
    if done["assigned"].isEmpty():
        log.warning("no clusters: the input holds no valid article")
        return None
    write_clusters(done["clusters"], a.clusters_output)
    write_canonical(done["assigned"], articles, a.output)
    log.info("%s articles", seen.get.get("rows"))
    for r in pipe.stage_metrics(done, articles).collect():
        log.info("%s: ARI %.4f, precision %.4f, recall %.4f, F1 %.4f", r.stage, r.ari, r.precision, r.recall, r.f1)
    for r in top_clusters(done["clusters"], articles).collect():
        log.info("cluster %s: %d articles, canonical %s: %s", r.cluster_id, r["size"], r.canonical_news_id, r.title)
    return done


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(message)s")
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("sameword").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    run(spark, a)
    return 0


if __name__ == "__main__":
    sys.exit(main())
