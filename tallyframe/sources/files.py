"""File inventories, text lines with their position, and images.

Spark's file sources skip names that start with ``_`` or ``.``, and a listing shows files only: empty directories are
not visible.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyframe.functions import paths
from tallyframe.functions.image_headers import checked_header
from tallyframe.session import broadcast_if_small, materialize

INVENTORY_SCHEMA = "path string, length bigint"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path``, which may hold wildcards, is there; the store is asked for that path alone."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = store.globStatus(hadoop)
    return found is not None and len(found) > 0


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Path and size of every file below ``root``, contents unread; a missing root gives no rows."""
    if not exists(spark, root):
        return spark.createDataFrame([], INVENTORY_SCHEMA)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select(paths.plain_path(F.col("path")).alias("path"), "length")


def images(inventory: DataFrame) -> DataFrame:
    return inventory.where(paths.is_image(F.col("path")))


def image_inventory(spark: SparkSession, root: str) -> DataFrame:
    return images(file_inventory(spark, root))


def annotation_files(inventory: DataFrame) -> DataFrame:
    return inventory.where(paths.is_annotation(F.col("path"))).orderBy("path")


def source_path() -> Column:
    """Plain path of the file a row was read from."""
    encoded = F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))
    return paths.plain_path(F.url_decode(encoded))


def text_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source, block, seq, value`` of every line; (source, block, seq) has the order of the lines."""
    return spark.read.text(path).select(
        source_path().alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )


def indexed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Non-blank lines with a dense 0-based ``index`` in file order; no line is shuffled, sorted or written.

    A first pass counts lines per block of a file; a line's index is the number of lines in earlier blocks plus its
    place in its own block. Both passes split the same files alike, so their places agree.
    """
    kept = spark.read.text(path).select(
        source_path().alias("source"), F.col("_metadata.file_block_start").alias("block"), "value"
    ).where(F.trim("value") != "")
    placed = kept.withColumn("slot", F.monotonically_increasing_id())
    blocks = placed.groupBy("source", "block").agg(F.count("*").alias("n"), F.min("slot").alias("first"))
    # One row per block of the input.
    earlier = Window.orderBy("source", "block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        "source", "block", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift")
    )
    offsets = materialize(offsets, "blocks")
    return placed.join(broadcast_if_small(offsets), ["source", "block"]).select(
        "source", (F.col("slot") + F.col("shift")).alias("index"), "value"
    )


def list_entries(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed non-blank lines of a list file with a sortable ``position``; a missing file gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "entry string, position struct<block:bigint,seq:bigint>")
    return text_rows(spark, path).select(
        F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("entry"), F.struct("block", "seq").alias("position")
    ).where("entry <> ''")


def count_list_entries(spark: SparkSession, path: str) -> int | None:
    """Number of entries of a list file, None when the file is absent."""
    return list_entries(spark, path).count() if exists(spark, path) else None


def image_headers(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """Size and channels of every image file below ``root``, from its header; no pixel is decoded.

    An image that can not be read has its ``error`` and ``readable`` false instead of failing the query.
    """
    stored = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    found = stored.select(paths.plain_path(F.col("path")).alias("path"), "content").where(paths.is_image(F.col("path")))
    return found.select("path", checked_header(F.col("content")).alias("header")).select("path", "header.*")


def pixel_ranges(spark: SparkSession, files: list[str]) -> DataFrame:
    """Smallest and largest byte of the decoded pixels of a few chosen images."""
    @F.pandas_udf("low int, high int")
    def extent(data: pd.Series) -> pd.DataFrame:
        pixels = [np.frombuffer(raw, np.uint8) if raw else None for raw in data]
        return pd.DataFrame(
            {
                "low": pd.Series([None if p is None else int(p.min()) for p in pixels], dtype="Int32"),
                "high": pd.Series([None if p is None else int(p.max()) for p in pixels], dtype="Int32"),
            }
        )

    decoded = spark.read.format("image").load(files)
    return decoded.select(
        paths.plain_path(F.col("image.origin")).alias("path"),
        F.array(F.col("image.height"), F.col("image.width"), F.col("image.nChannels")).alias("shape"),
        extent(F.col("image.data")).alias("range"),
    ).select("path", "shape", "range.low", "range.high")


def total_size(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.coalesce(F.sum("length"), F.lit(0)).cast("bigint").alias("size_bytes"))


def path_size_bytes(spark: SparkSession, path: str) -> int:
    """Size of a file, or of all files below a directory; a missing path is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return total_size(file_inventory(spark, path)).first()["size_bytes"]


def file_metadata(spark: SparkSession, path: str) -> DataFrame:
    size = path_size_bytes(spark, path)
    row = spark.range(1).select(F.lit(path).alias("path"), F.lit(size).cast("bigint").alias("size_bytes"))
    return row.withColumn("size_gb", F.col("size_bytes") / float(1024**3))


def files_per_directory(inventory: DataFrame, root: str) -> DataFrame:
    """Every directory from ``root`` down to the files: depth, name, and number of files directly in it."""
    root = root.rstrip("/")
    directory = paths.parent_dir(F.col("path"))
    counts = inventory.groupBy(directory.alias("directory")).agg(F.count("*").alias("direct_files"))
    below = F.filter(F.split(F.substr(F.col("directory"), F.lit(len(root) + 1)), "/"), lambda p: p != "")
    levels = counts.withColumn("parts", below).select(
        "parts", "direct_files", F.posexplode(F.sequence(F.lit(0), F.size("parts"))).alias("depth", "n")
    )
    return (
        levels.select(
            F.concat_ws("/", F.lit(root), F.slice("parts", F.lit(1), F.col("depth"))).alias("directory"),
            F.col("depth").cast("bigint").alias("depth"),
            F.when(F.col("depth") == F.size("parts"), F.col("direct_files")).otherwise(0).alias("direct_files"),
        )
        .groupBy("directory", "depth")
        .agg(F.sum("direct_files").alias("direct_files"))
        .orderBy("directory")
    )
