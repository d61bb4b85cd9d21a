"""Places of rows in a global order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sameword.shared import fresh_name, stage

#: monotonically_increasing_id() has the partition above these bits and the row in it below.
ROW_BITS = 33


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """rows with `name`: their place, from 0, in `order`. One exchange by ranges; the sorted rows are written to the shared
    folder with their place in their own range, and the sizes of the ranges (as many as partitions) move them on. Rows
    equal in `order` are numbered in any way, but each number is given once."""
    at, part, before = (fresh_name(x, *rows.columns, name) for x in ("_at", "_part", "_before"))
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stage(ranged.withColumn(at, F.monotonically_increasing_id()), "ordered").withColumn(part, F.shiftright(at, ROW_BITS))
    ahead = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    sizes = held.groupBy(part).agg(F.count(F.lit(1)).alias(before)).select(part, F.coalesce(F.sum(before).over(ahead), F.lit(0)).alias(before))
    place = F.col(before) + F.col(at).bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    return held.join(F.broadcast(sizes), part).withColumn(name, place).drop(at, part, before)


def running(rows: DataFrame, weights: dict[str, Column], *order: Column | str) -> DataFrame:
    """rows with a column for each of `weights` (name, whole numbers): their sum over the rows ahead in `order`. As numbered(),
    with sums in place of counts; a range is one window partition."""
    at, part, own = (fresh_name(x, *rows.columns, *weights) for x in ("_at", "_part", "_own"))
    sums = {name: fresh_name(f"_sum_{name}", *rows.columns, *weights) for name in weights}
    ranged = rows.withColumns({sums[name]: w for name, w in weights.items()}).repartitionByRange(*order).sortWithinPartitions(*order)
    held = stage(ranged.withColumn(at, F.monotonically_increasing_id()), "ordered").withColumn(part, F.shiftright(at, ROW_BITS))
    ahead, inside = (w.rowsBetween(W.unboundedPreceding, -1) for w in (W.orderBy(own), W.partitionBy(part).orderBy(at)))
    sizes = held.groupBy(F.col(part).alias(own)).agg(*[F.sum(s).alias(name) for name, s in sums.items()])
    sizes = sizes.select(own, *[F.coalesce(F.sum(name).over(ahead), F.lit(0)).alias(name) for name in weights])
    inner = held.withColumns({s: F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums.values()})
    met = inner.join(F.broadcast(sizes), F.col(part) == F.col(own))
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], *[(F.col(name) + F.col(s)).alias(name) for name, s in sums.items()])


def numbered_within(rows: DataFrame, group: str, *order: Column | str, name: str = "place", size: str = "size") -> DataFrame:
    """rows with `name`, their place from 0 among the rows of one `group` (null is one), and `size`, how many those are. One
    exchange by ranges of (group, order): a group of any size is spread, and rows meet what is ahead of their own range."""
    at, part, low, many, before, key, own = (fresh_name(x, *rows.columns, name, size) for x in ("_at", "_part", "_low", "_many", "_before", "_group", "_own"))
    sorted_by = [F.asc_nulls_first(group), *order]
    ranged = rows.repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by)
    held = stage(ranged.withColumn(at, F.monotonically_increasing_id()), "ordered").withColumn(part, F.shiftright(at, ROW_BITS))
    runs = held.groupBy(F.col(part).alias(own), F.col(group).alias(key)).agg(F.min(at).alias(low), F.count(F.lit(1)).alias(many))
    every = W.partitionBy(key)
    ahead = every.orderBy(own).rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(own, key, low, F.coalesce(F.sum(many).over(ahead), F.lit(0)).alias(before), F.sum(many).over(every).alias(size))
    met = held.join(runs, (F.col(part) == F.col(own)) & F.col(group).eqNullSafe(F.col(key)))
    return met.withColumn(name, F.col(before) + F.col(at) - F.col(low)).drop(at, part, low, before, key, own)
