"""Places that the driver and all executors can read: the folder named by spark.checkpoint.dir.

Each application writes to a folder of its own there. What a later table makes needless is discarded at once; the rest
stays until clear(), as results are read from it lazily.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only a local session without one (a test, a trial) gets a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sameword-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/sameword-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def fresh_name(name: str, *taken: str) -> str:
    """name, with as many underscores as make it none of the names taken, in any case of letters."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, and a lost executor loses nothing."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def staged_at(df: DataFrame) -> str:
    """The folder of a table that stage() returned."""
    return df._staged_at


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Delete a table that stage() returned and that nothing will read any more."""
    remove(df.sparkSession, staged_at(df))


def clear(spark: SparkSession) -> None:
    """Delete all that this application has staged. Results that haven't been written by then are lost."""
    remove(spark, own_dir(spark))
