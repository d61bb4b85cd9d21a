"""Mixing sources to target weights by temperature.

A source's weight is its share of tokens to the power of an exponent, normalised. The exponent is bisected until the
weights have a given entropy, or until no source repeats more than a given number of times. A source's budget is then
spent on permutations of its blocks: every epoch puts the blocks, and the documents in a block, in a new hashed order, and
the last epoch ends where the budget does. Sources interleave by the share of their budget that they have spent.

Defined cases: a null source is a source of its own; a null or empty text counts as one token, so that it has a place;
repeated rows are rows of their own; one source gets weight 1; an empty table gives an empty result; the table's other
columns stay as they are, whatever their names. An entropy that no exponent gives is refused (ValueError).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sameword.llm.locate import Located, with_locator
from sameword.shared import fresh_name, stage

BLOCK_TOKENS = 1_000_000
REPEATS = 2.0
#: Exponents for an entropy go up to this, and entropies differ by so much at least.
MOST_EXPONENT, SLACK = 1024.0, 1e-9


def tokens_of(text: Column) -> Column:
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")
    return F.greatest(F.size(words), F.lit(1)).cast("long")


def totals_of(slim: DataFrame) -> DataFrame:
    return slim.groupBy("source").agg(F.sum("tokens").alias("tokens"))


def bisect_exponent(totals: DataFrame, repeats: float | None = None, entropy: float | None = None, rounds: int = 6, cuts: int = 32) -> float:
    """The exponent at which the weights have a given entropy, or the largest one in [0, 1] at which no source comes more
    often than `repeats` times as often as another; 1 leaves shares as they are, and above it large sources gain. Each round
    cuts the interval into equal parts in one aggregation over the sources, so that the driver never holds one row for each
    source.

    An entropy lies between the logarithm of the number of largest sources (all weight on these) and that of the number of
    sources (equal weights); ValueError for any other. Equal sources have one entropy, met by every exponent: 1. What can't
    be met in (0, MOST_EXPONENT) but by its bounds is met by them to within SLACK."""
    sums = totals.agg(F.sum("tokens"), F.max("tokens"), F.count(F.lit(1))).first()
    if not sums[0]:
        return 1.0
    p = F.col("tokens") / F.lit(float(sums[1]))  # of the largest, so that no power overflows
    if entropy is None:
        low, high = 0.0, 1.0
        for _ in range(rounds):
            grid = [low + (high - low) * k / cuts for k in range(cuts + 1)]
            row = totals.agg(*[F.max(F.pow(p, F.lit(x - 1))).alias(f"a{k}") for k, x in enumerate(grid)], *[F.min(F.pow(p, F.lit(x - 1))).alias(f"b{k}") for k, x in enumerate(grid)]).first()
            fits = [row[f"a{k}"] / row[f"b{k}"] <= repeats for k in range(cuts + 1)]  # repeats fall to 1 as it grows to 1
            best = min(k for k, ok in enumerate(fits) if ok) if any(fits) else cuts
            low, high = grid[max(best - 1, 0)], grid[best]
        return high

    def entropies(grid: list[float]) -> list[float]:
        row = totals.agg(*[F.sum(F.pow(p, F.lit(x))).alias(f"z{k}") for k, x in enumerate(grid)], *[F.sum(F.pow(p, F.lit(x)) * F.log(p)).alias(f"l{k}") for k, x in enumerate(grid)]).first()
        return [math.log(row[f"z{k}"]) - x * row[f"l{k}"] / row[f"z{k}"] for k, x in enumerate(grid)]  # falls as the exponent grows

    least, most = math.log(totals.where(F.col("tokens") == sums[1]).count()), math.log(sums[2])
    if not least - SLACK <= entropy <= most + SLACK:
        raise ValueError(f"no exponent gives an entropy of {entropy}: these sources have from {least} to {most}")
    if most - least < SLACK:
        return 1.0
    grid = [0.0, *[2.0**k for k in range(-10, int(math.log2(MOST_EXPONENT)) + 1)]]  # first which power of two, then within
    for _ in range(rounds + 1):
        best = max((k for k, x in enumerate(entropies(grid)) if x >= entropy), default=0)
        low, high = grid[best], grid[min(best + 1, len(grid) - 1)]
        grid = [low + (high - low) * k / cuts for k in range(cuts + 1)]
    return low


def plan_of(totals: DataFrame, exponent: float, budget: float | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """source, tokens, share, weight, budget, epochs, blocks. Without a budget, the total is the least at which every
    document comes once at least; with an exponent above 1, which takes weight from small sources, it is what there is."""
    every, top = (float(x or 1) for x in totals.agg(F.sum("tokens"), F.max("tokens")).first())
    power = F.pow(F.col("tokens") / top, F.lit(exponent))  # of the largest, so that no power overflows
    norm, most = (float(x or 1) for x in totals.agg(F.sum(power), F.max(F.when(power > 0, F.col("tokens") / power))).first())
    whole = budget if budget is not None else most * norm if exponent <= 1 else every
    out = totals.withColumns({"share": F.col("tokens") / every, "weight": power / norm})
    out = out.withColumn("budget", F.greatest(F.round(F.col("weight") * whole), F.lit(1.0)).cast("long"))
    return out.withColumns({"epochs": F.col("budget") / F.col("tokens"), "blocks": F.ceil(F.col("tokens") / block_tokens).cast("long")})


FILE, ROW = "at_file", "at_row"


def mix_order(docs: DataFrame | Located, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", repeats: float = REPEATS, entropy: float | None = None, budget: float | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """A row for each place in the mix: id, source, tokens, weight, epoch, block, seq (0 to 1, the order), and locator."""
    at = docs if isinstance(docs, Located) else with_locator(docs)
    slim = stage(at.rows.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), tokens_of(F.col(text_col)).alias("tokens"), F.col(at.file).alias(FILE), F.col(at.row).alias(ROW)), "mix-rows")
    totals = stage(totals_of(slim), "mix-totals")
    plan = stage(plan_of(totals, bisect_exponent(totals, repeats, entropy), budget, block_tokens), "mix-plan")
    own = plan.select(F.col("source").alias("s"), F.col("tokens").alias("all"), "weight", "budget", "blocks")
    rows = slim.join(own, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("block", F.pmod(F.xxhash64(FILE, ROW, F.lit(seed)), F.col("blocks")))
    epochs = F.sequence(F.lit(0), F.ceil(F.col("budget") / F.col("all")).cast("int") - 1)
    sums = rows.groupBy("source", "block").agg(F.sum("tokens").alias("size"), F.first("all").alias("all"), F.first("budget").alias("budget"))
    order = W.partitionBy("source", "epoch").orderBy("turn", "block").rowsBetween(W.unboundedPreceding, -1)
    placed = sums.withColumn("epoch", F.explode(epochs)).withColumn("turn", F.xxhash64("epoch", "block", F.lit(seed)))
    placed = placed.withColumn("start", F.col("epoch") * F.col("all") + F.coalesce(F.sum("size").over(order), F.lit(0))).where("start < budget")
    placed = placed.select(F.col("source").alias("s"), F.col("block").alias("b"), "epoch", "start")
    within = W.partitionBy("source", "block", "epoch").orderBy("turn", FILE, ROW).rowsBetween(W.unboundedPreceding, -1)
    out = rows.join(placed, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("turn", F.xxhash64(FILE, ROW, "epoch", F.lit(seed)))
    out = out.withColumn("start", F.col("start") + F.coalesce(F.sum("tokens").over(within), F.lit(0))).where("start < budget")
    return out.select("id", "source", "tokens", "weight", "epoch", "block", (F.col("start") / F.col("budget")).alias("seq"), FILE, ROW)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents, columns unchanged, written in the order of the mix."""
    at = with_locator(docs)
    seq = fresh_name("_mix_seq", *at.rows.columns)
    order = stage(mix_order(at, **how).select(F.col("seq").alias(seq), F.col(FILE).alias(at.file), F.col(ROW).alias(at.row)), "mix-order")
    return at.rows.join(order, at.place).repartitionByRange(seq, *at.place).sortWithinPartitions(seq, *at.place).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_order(docs).withColumnRenamed("id", "doc_id").drop(FILE, ROW)
