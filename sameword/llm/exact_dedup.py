"""Stateful exact deduplication: a stream of digests folds into disk-backed keyed state that never expires.

A key's state holds the digest, the smallest identifier seen and a locator of its content. Rows that hit a key with an
earlier holder are compared with it byte by byte; rows whose digest agrees but whose text differs form groups of their own.
Only DataFrame operations run here.

Defined cases: a null text counts as empty; a null identifier sorts after every other; file in the result is a hash of
the path, which locate.file_table() has in full; repeated rows (same identifier
too) are separate rows of a group of which one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.llm.locate import Located, with_locator
from sameword.operators.sieve import maybe_in
from sameword.shared import fresh_path, remove, stage, staged_at

#: Parts in which copies of one text meet what is held of it.
SALTS = 1024
#: State on disk, with no space reserved ahead: many partitions hold little each.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def one_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def located(docs: DataFrame | Located, id_col: str, text_col: str) -> DataFrame:
    """id, norm and the locator (file, row)."""
    at = docs if isinstance(docs, Located) else with_locator(docs.select(F.col(id_col), F.col(text_col)))
    return at.rows.select(F.col(id_col).alias("id"), one_space(F.col(text_col)).alias("norm"), F.col(at.file).alias("file"), F.col(at.row).alias("row"))


def fold_digests(spark: SparkSession, log: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """Run the staged log (key, id, file, row) through keyed state; return the state, staged: key, holder, size. The
    stream's folder is deleted after that."""
    if log.isEmpty():  # a stream without files has no state to read
        kind = log.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"key binary, holder struct<late:boolean,id:{kind},file:bigint,row:bigint>, size bigint")
    reader = spark.readStream.schema(log.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    holder = F.struct(F.col("id").isNull().alias("late"), "id", "file", "row")
    state = reader.parquet(staged_at(log)).groupBy("key").agg(F.min(holder).alias("holder"), F.count(F.lit(1)).alias("size"))
    path, before = fresh_path(spark, "dedup-state"), {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        run = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", path).trigger(availableNow=True).start()
        run.awaitTermination()
        held = spark.read.format("statestore").load(path)
        smallest, count = [f.name for f in held.schema["value"].dataType.fields]
        out = stage(held.select(F.col("key.key").alias("key"), F.col("value")[smallest].alias("holder"), F.col("value")[count].alias("size")), "dedup-held")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    remove(spark, path)
    return out


def exact_dedup(docs: DataFrame | Located, id_col: str = "doc_id", text_col: str = "text", key_bytes: int = 32, files_per_batch: int | None = None, rows_per_salt: int = 4096) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, and the locator (file, row).

    key_bytes: how much of the SHA-256 digest keys the state; whatever it is, full bytes decide. Large groups are
    compared with their holder in salted parts of about rows_per_salt rows.
    """
    rows = located(docs, id_col, text_col)
    spark = rows.sparkSession
    sha = F.unhex(F.sha2("norm", 256))
    log = stage(rows.select("id", "file", "row", sha.alias("sha")).withColumn("key", F.substring("sha", 1, key_bytes)), "dedup-log")
    state = fold_digests(spark, log, files_per_batch)
    # copies of one text meet its state in SALTS parts
    salted = log.withColumn("salt", F.pmod(F.xxhash64("file", "row"), F.lit(SALTS)))
    parted = salted.groupBy("key", "salt").agg(F.count(F.lit(1)).alias("n")).drop("n").join(state.hint("merge"), "key")
    assigned = stage(salted.join(parted.hint("merge"), ["key", "salt"]).drop("salt"), "dedup-assigned")
    hits = stage(assigned.where("size > 1").drop("sha"), "dedup-hits")
    texts = stage(maybe_in(rows.drop("id"), hits, "file", "row").join(hits.hint("merge"), ["file", "row"]), "dedup-texts")
    parts = F.ceil(F.col("size") / rows_per_salt).cast("int")
    mine = (F.col("file") == F.col("holder.file")) & (F.col("row") == F.col("holder.row"))
    held = texts.where(mine).select("key", F.col("norm").alias("held"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
    others = texts.where(~mine).withColumn("salt", F.pmod(F.xxhash64("file", "row"), parts).cast("int"))
    odd = stage(others.join(held.hint("merge"), ["key", "salt"]).where(F.col("norm") != F.col("held")).select("key", "id", "file", "row", "norm"), "dedup-odd")
    if not odd.isEmpty():
        again = odd.groupBy("key", "norm").agg(F.min(F.struct(F.col("id").isNull().alias("late"), "id", "file", "row")).alias("own"), F.count(F.lit(1)).alias("own_size"))
        moved = odd.join(again, ["key", "norm"]).select("file", "row", "own", "own_size")
        fewer = odd.groupBy("key").agg(F.count(F.lit(1)).alias("gone"))
        assigned = assigned.join(fewer, "key", "left").join(moved, ["file", "row"], "left").withColumns(
            {"holder": F.coalesce("own", "holder"), "size": F.coalesce("own_size", F.col("size") - F.coalesce("gone", F.lit(0)))}
        )
    kept = (F.col("file") == F.col("holder.file")) & (F.col("row") == F.col("holder.row"))
    return assigned.select("id", F.col("holder.id").alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"), "file", "row")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs, its columns unchanged, without the rows whose text an earlier row has."""
    at = with_locator(docs)
    lost = exact_dedup(at, id_col, text_col, **how).where("not kept").select(F.col("file").alias(at.file), F.col("row").alias(at.row))
    return at.rows.join(stage(lost, "dedup-lost"), at.place, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_dedup(docs).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
