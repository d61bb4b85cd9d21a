"""Arrow helpers shared by the operators that run Python over whole texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, mb: int = 8) -> None:
    """Bound what one Arrow batch holds, so that very long texts don't fill a worker. A lower setting stays. Plans run
    later than they are made, so the setting can't be put back here; it changes no result."""
    now = spark.conf.get(BYTES_PER_BATCH, None)
    size = int(now) if now and now.strip("-").isdigit() else 0
    if not 0 < size <= mb << 20:
        spark.conf.set(BYTES_PER_BATCH, str(mb << 20))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column end to end, and the offsets where each text starts and ends."""
    texts = as_bytes(column)
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=ends[1:])
    return np.frombuffer(b"".join(texts), np.uint8), ends


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total)
