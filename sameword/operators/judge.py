"""A language model as judge of pairs (LM1, IO22, PR27, PR28, SA4, FI14). The service is a function the caller gives."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sameword.functions import text as T
from sameword.operators.ingest import undone

#: (status, reply) of one question.
Service = Callable[[str], tuple[int, str | None]]


def ask(service: Service, prompt: str, tries: int = 5, wait: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """IO22: the reply of the first try that ends with status 200; after any other status, or an error, wait and try again;
    null when no try is left."""
    for _ in range(tries):
        try:
            status, reply = service(prompt)
            if status == 200:
                return reply
        except Exception:  # noqa: BLE001  a service may fail in any way
            pass
        sleep(wait)
    return None


def prompts(pairs: DataFrame, size: int = 10) -> DataFrame:
    """batch, pairs (place, pair_id, text_a, text_b in order), prompt: `size` pairs to a question, by place."""
    cut = pairs.select(F.floor(F.col("place") / size).alias("batch"), F.struct("place", "pair_id", F.substring("text_a", 1, 1500).alias("text_a"), F.substring("text_b", 1, 1500).alias("text_b")).alias("p"))
    whole = cut.groupBy("batch").agg(F.array_sort(F.collect_list("p")).alias("pairs"))
    return whole.withColumn("prompt", T.pair_prompt(F.col("pairs")))


def judged(pairs: DataFrame, service: Service, size: int = 10, tries: int = 5, wait: float = 5.0) -> DataFrame:
    """pairs with llm_label. Where they have that column, only batches that lack a label are asked again, whole (FI14);
    a question without a reply gives zeros."""
    kept = [c for c in pairs.columns if c != "llm_label"]
    batched = pairs.withColumn("_batch", F.floor(F.col("place") / size))
    open_ = undone(batched, "_batch", "llm_label") if "llm_label" in pairs.columns else batched

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies = [ask(service, p, tries, wait) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(replies, pa.string())], ["batch", "reply"])

    asked = prompts(open_.select(*kept), size)
    replies = asked.select("batch", "prompt").mapInArrow(run, "batch long, reply string")
    labels = asked.select("batch", F.transform("pairs", lambda p: p["place"]).alias("places")).join(replies, "batch")
    labels = labels.select(F.explode(F.arrays_zip("places", T.reply_labels(F.col("reply"), F.size("places")).alias("labels"))).alias("x")).select(F.col("x.places").alias("place"), F.col("x.labels").alias("_new"))
    met = pairs.join(labels, "place", "left")
    return met.select(*kept, F.coalesce("_new", "llm_label").alias("llm_label") if "llm_label" in pairs.columns else F.col("_new").alias("llm_label"))
