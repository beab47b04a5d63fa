"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side of a join is broadcast only when it was counted and has at most this many rows.
BROADCAST_ROW_LIMIT = 200_000


def local_session(cpus: int | str = "*", app: str = "tallyframe", shuffle_partitions: int = 8) -> SparkSession:
    """A session for one machine (tests and the bench); a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables, as named by the session.

    Only a local master may fall back to a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that every executor can reach.")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tallyframe-"))
    return spark.sparkContext.getCheckpointDir()


# Paths handed out inside each open ``scratch_tables`` block, the innermost last.
_OPEN: list[list[str]] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/tallyframe/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[None]:
    """Own the scratch tables made inside: at the end they are deleted, so write or collect results before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and continue from that table.

    Used where two branches of a plan must see the very same rows in the very same positions. The table outlives
    executors, and later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def file_blocks(spark: SparkSession, block_bytes: int) -> Iterator[None]:
    """Jobs run inside read files in blocks of this size; nothing else should run there, as each block is a task."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, str(block_bytes))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of driver-side parameters (class lists, quotas, thresholds) as a local relation of known size."""
    names = [field.strip().split()[0] for field in schema.split(",")]
    types = [field.strip().split()[1] for field in schema.split(",")]
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    columns = [pa.array([row[i] for row in rows], arrow[kind]) for i, kind in enumerate(types)]
    return spark.createDataFrame(pa.table(columns, names=names))


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast ``df`` when a count shows that it is small; otherwise leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
