"""The corpus pipeline: quality, exact copies, near copies, mix, tokens.

Defined cases, for every stage: a null or empty text is a text like any other (one empty passage, one token, no
shingles, no near copies); repeated rows are copies, of which one stays; rows with a null identifier are scored, deduped
exactly, never near copies, mixed and encoded; an empty table gives an empty table; extra columns, whatever their names,
go through all stages but the last unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.llm import bpe, exact_dedup, mixing, ngram_join, quality
from sameword.shared import fresh_name, stage


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled documents that are still here, accepts."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = fresh_name("_score", *docs.columns)
    return quality.score(docs, model, score_col=name).where(F.col(name) >= quality.THRESHOLD).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; no source more than twice over."""
    return mixing.mix(docs)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", drop_low_quality),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", to_tokens),
]

#: A trained classifier, hashed permutations and BPE have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
