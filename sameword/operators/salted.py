"""Joins in which one key may hold any share of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sameword.shared import fresh_name

#: Parts in which the rows of one key meet what is held of it.
SALTS = 1024


def meet(rows: DataFrame, held: DataFrame, keys: list[str], by: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """rows joined with `held`, which has one row of each key, null keys too; how: inner or left. The rows of a key are dealt
    to `salts` parts by a hash of the columns `by`; what is held of a key goes to the parts that it has, and each part
    meets its own; with one salt it is a plain join. `rows` is read twice: it should be a staged table, or cheap."""
    salt, own = fresh_name("_salt", *rows.columns, *held.columns), [fresh_name(f"_of_{k}", *rows.columns, *held.columns) for k in keys]
    renamed = held.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], *[c for c in held.columns if c not in keys])
    same = lambda a, b, ks: reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[o]) for k, o in ks])
    if salts == 1:
        return rows.join(renamed, same(rows, renamed, list(zip(keys, own, strict=True))), how).drop(*own)
    spread = rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)))
    at = fresh_name("_at", *rows.columns, *held.columns, salt)
    parts = spread.select(*keys, F.col(salt).alias(at)).distinct()
    parts = parts.join(renamed, same(parts, renamed, list(zip(keys, own, strict=True)))).drop(*keys)
    met = spread.join(parts, same(spread, parts, list(zip(keys, own, strict=True))) & (spread[salt] == parts[at]), how)
    return met.drop(salt, at, *own)
