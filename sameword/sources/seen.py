"""FI6, IO17, JO5: an index of the keys that earlier batches brought, so that a new batch doesn't read them all.

Each batch leaves its keys, and a bitmap in which HASHES bits are set for each. A new batch's keys are looked up in the
bitmaps, two bytes for each key ever seen; those that a bitmap lets pass, the keys that are there and a few by chance, are
compared with the keys of that batch alone. So of keys that are new, hardly any stored one is read, and none is lost.

Defined cases: a null key is never seen; repeated keys are one; a batch that is added again takes the place of its former
self; an index that has not begun has seen nothing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.shared import fresh_name, stage

#: Bits of a bitmap that are set for each key, bits that it has for each, and bits of one stored row.
HASHES, BITS_A_KEY, CHUNK = 4, 16, 32768


class SeenKeys:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def stored(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(f"{schema}, batch bigint").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], f"{schema}, batch bigint")

    def keys(self) -> DataFrame:
        return self.stored("keys", "key string")

    def bitmaps(self) -> DataFrame:
        return self.stored("bitmaps", "size bigint, chunk bigint, bits binary")

    def batches(self) -> list[tuple[int, int]]:
        """(batch, bits of its bitmap) of all batches."""
        return sorted((r.batch, r["size"]) for r in self.stored("sizes", "size bigint").collect())

    def add(self, keys: DataFrame, batch: int | None = None) -> None:
        """keys: one column of strings. Its number is the next one if none is given."""
        held = self.batches()
        batch = batch if batch is not None else max((b for b, _ in held), default=-1) + 1
        own = stage(keys.toDF("key").where("key is not null").distinct(), "seen-keys")
        size = CHUNK
        while size < BITS_A_KEY * own.count():
            size *= 2
        bits = own.select(F.explode(self.places(F.lit(size))).alias("bit")).select(F.floor(F.col("bit") / CHUNK).alias("chunk"), F.pmod("bit", F.lit(CHUNK)).alias("at"))
        made = bits.groupBy("chunk").agg(F.expr("bitmap_construct_agg(at)").alias("bits")).select(F.lit(size).cast("bigint").alias("size"), "chunk", "bits")
        own.write.mode("overwrite").parquet(f"{self.path}/keys/batch={batch}")
        made.write.mode("overwrite").parquet(f"{self.path}/bitmaps/batch={batch}")
        self.spark.createDataFrame([(size,)], "size bigint").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/sizes/batch={batch}")

    @staticmethod
    def places(size) -> F.Column:
        """The bits of a column `key` in a bitmap."""
        return F.array_distinct(F.array(*[F.pmod(F.xxhash64("key", F.lit(k)), size) for k in range(HASHES)]))

    def possible(self, own: DataFrame) -> DataFrame:
        """key, batch: what the bitmaps let pass of own (key)."""
        held = self.batches()
        if not held:
            return self.spark.createDataFrame([], "key string, batch bigint")
        each = F.explode(F.array(*[F.struct(F.lit(b).cast("bigint").alias("batch"), F.lit(s).cast("bigint").alias("size")) for b, s in held]))
        asked = own.select("key", each.alias("b")).select("key", "b.batch", self.places(F.col("b.size")).alias("bits"))
        asked = asked.select("key", "batch", F.size("bits").alias("wanted"), F.explode("bits").alias("bit")).withColumn("chunk", F.floor(F.col("bit") / CHUNK))
        at = F.pmod("bit", F.lit(CHUNK))
        byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        met = asked.join(self.bitmaps().select("batch", "chunk", "bits"), ["batch", "chunk"])
        there = met.where(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1)
        return there.groupBy("key", "batch").agg(F.count(F.lit(1)).alias("n"), F.first("wanted").alias("wanted")).where("n = wanted").select("key", "batch")

    def known(self, keys: DataFrame) -> DataFrame:
        """Which of keys (one column) are in the index: key."""
        own = stage(keys.toDF("key").where("key is not null").distinct(), "seen-own")
        maybe = stage(self.possible(own), "seen-maybe")
        some = [r.batch for r in maybe.select("batch").distinct().collect()]  # as many as batches at most
        return maybe.join(self.keys().where(F.col("batch").isin(some)), ["key", "batch"], "left_semi").select("key").distinct()

    def unseen(self, rows: DataFrame, key: str) -> DataFrame:
        """rows whose key no batch has brought."""
        own = fresh_name("_seen", *rows.columns)
        seen = self.known(rows.select(F.col(key).cast("string"))).withColumnRenamed("key", own)
        return rows.join(seen, F.col(key).cast("string") == F.col(own), "left_anti")

    def catch_up(self, keys: DataFrame) -> None:
        """Add what the index lacks of keys, as one batch: after a run that was cut short between a table and its index."""
        lacking = stage(self.unseen(keys.toDF("key").where("key is not null"), "key"), "seen-lacking")
        if not lacking.isEmpty():
            self.add(lacking)
