"""A bitmap of fixed size that tells rows apart in a scan before a join moves them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sameword.shared import fresh_name

#: Bits of the bitmap: 1 MB, whatever the size of the key table.
BITS = 1 << 23


def flagged(rows: DataFrame, keys: DataFrame, flag: str, *cols: str) -> DataFrame:
    """rows with a column `flag`: false where the key is surely not in keys."""
    bit = F.pmod(F.xxhash64(*cols), F.lit(BITS))
    at, chunk, held = (fresh_name(x, *rows.columns, flag) for x in ("_bit", "_chunk", "_bits"))
    bits = keys.select(bit.alias(at)).groupBy(F.floor(F.col(at) / 32768).alias(chunk)).agg(F.expr(f"bitmap_construct_agg(pmod({at}, 32768))").alias(held))
    met = rows.withColumn(at, bit).withColumn(chunk, F.floor(F.col(at) / 32768)).join(F.broadcast(bits), chunk, "left")
    byte = f"cast(conv(hex(substring({held}, cast(pmod({at}, 32768) div 8 as int) + 1, 1)), 16, 10) as int)"
    return met.withColumn(flag, F.expr(f"coalesce(getbit({byte}, cast(pmod({at}, 8) as int)) = 1, false)")).select(*[F.col(f"`{c}`") for c in rows.columns], flag)


def maybe_in(rows: DataFrame, keys: DataFrame, *cols: str) -> DataFrame:
    """rows without most of those whose key isn't in keys. What stays by chance is for a join to take out."""
    flag = fresh_name("_maybe", *rows.columns)
    return flagged(rows, keys, flag, *cols).where(flag).drop(flag)
