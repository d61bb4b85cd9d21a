"""Synthetic copies of articles, and a small labelled set (PR14-PR21, IO20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.functions import text as T


def later(date, key, seed: str):
    """PR20: an ISO date, its offset kept, 1 to 12 hours later; anything else as it is."""
    wall, offset = T.wall_and_zone(date)
    moved = F.timestamp_micros(F.unix_micros(wall) + (3600 + F.pmod(T.draw(F.lit(seed), F.lit("t"), key), F.lit(39601))) * 1_000_000)
    zone = F.when(date.rlike(r"\d:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"), offset).otherwise("")
    return F.when(date.rlike(r"^\d{4}-\d{2}-\d{2}") & wall.isNotNull(), F.concat(F.date_format(moved, "yyyy-MM-dd'T'HH:mm:ss"), zone)).otherwise(date)


def synthetic_copies(rows: DataFrame, limit: int = 0, order: str = "id", seed: str = "42") -> DataFrame:
    """Changed copies of the first `limit` rows (0: all), columns as they are, true_cluster_id and source added or replaced.

    The identifier is id, else _id, else a drawn number. title is changed, and content if the table has it, else text
    (PR21). Null and empty texts stay."""
    columns = set(rows.columns)
    few = rows.orderBy(order).limit(limit) if limit > 0 else rows
    drawn = (1000 + F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in sorted(columns)], F.lit(seed)), F.lit(9000))).cast("string")
    own = F.coalesce(*[F.col(c).cast("string") for c in ("id", "_id") if c in columns], drawn)
    few = few.withColumn("_own", own)
    changed = {"id": T.copy_id(F.col("_own")), "source": F.lit("Synthetic"), "true_cluster_id": F.col("_own")}
    if "published_at" in columns:
        changed["published_at"] = later(F.col("published_at"), F.col("_own"), seed)
    for c in [x for x in ("title", "content" if "content" in columns else "text") if x in columns]:
        changed[c] = T.mutate(F.col(c), F.col("_own"), seed)
    return few.withColumns(changed).drop("_own")


def toy_articles(spark: SparkSession) -> DataFrame:
    """IO20: three articles and two retellings of each, labelled, on one day."""
    told = [
        [("Bridge over the Lena opens", "The new bridge over the Lena was opened to traffic on Tuesday after six years of work."), ("Traffic crosses Lena bridge", "After six years of building, cars crossed the Lena on its new bridge for the first time."), ("Lena bridge done", "Drivers can use the bridge over the Lena from today; building it took six years.")],
        [("Central bank keeps rate", "The central bank left its key rate at four percent and named steady prices as its reason."), ("Rate stays at four percent", "Prices are steady, the central bank said, and its key rate stays where it was."), ("No change from the bank", "Four percent it remains: the bank sees no need to move its rate.")],
        [("Comet seen by eye", "A comet found in May can now be seen without a telescope low in the west after dusk."), ("May's comet grows bright", "Look west after dusk: the comet found in May no longer needs a telescope."), ("Evening comet", "Low in the western sky the new comet has become visible to the naked eye.")],
    ]
    number = [[1, 4, 5], [2, 6, 7], [3, 8, 9]]
    rows = [(str(number[k][j]), title, text, "Original" if j == 0 else "Retold", f"2023-09-12 {10 + k}:{20 * j:02d}:00", k + 1) for k, three in enumerate(told) for j, (title, text) in enumerate(three)]
    raw = spark.createDataFrame(rows, "id string, title string, text string, source string, at string, true_cluster_id long")
    return raw.select("id", "title", "text", "source", F.col("at").cast("timestamp").alias("published_at"), "true_cluster_id").orderBy("id")
