"""How much data Spark hands to Python at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
DEFAULT, SMALL = "67108864b", "4194304b"


def bound_batches(spark: SparkSession) -> None:
    """Batches of 4 MB instead of 64 MB, unless the session says otherwise.

    Texts and media differ in size by orders of magnitude, and a task holds a batch, its objects in Python and its results
    at the same time, in memory outside the heap.
    """
    if spark.conf.get(BYTES_PER_BATCH, DEFAULT) == DEFAULT:
        spark.conf.set(BYTES_PER_BATCH, SMALL)
