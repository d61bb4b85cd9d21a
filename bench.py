"""One JSON line with the seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]."""

import json
import os
import time

from pyspark.sql import SparkSession

from sameword.plans import registry
from sameword.shared import clear

NAMES = ["clean_text", "boilerplate_strip", "minhash_signature", "minhash_groups", "lsh_candidates", "exact_jaccard_pairs", "band_join_events", "window_neighbour_count", "dedup_exact_keep_first", "connected_components", "cluster_output", "pair_metrics", "window_cosine_pairs", "window_cosine_veto", "threshold_sweep", "rerank_sigmoid_filter", "louvain_clusters", "flagship_pipeline"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in NAMES:
        began = time.time()
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 2)
        clear(spark)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 2), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
