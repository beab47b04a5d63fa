"""Record sets ``(path, split, category)``: path resolution, union, duplicates, fill-in and counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions import paths, tokens
from tallyframe.functions.text import complete_rows
from tallyframe.session import small_table

RECORD_COLUMNS = ("path", "split", "category")


def resolve_paths(
    df: DataFrame, inventory: DataFrame, root: str, raw_col: str, keep_unresolved: bool = False
) -> DataFrame:
    """Add ``path``: the file of the inventory that a raw path means.

    In order: the path itself (below ``root`` when relative), its base name directly in ``root``, any file with that
    base name. Several files with one base name give the smallest path. Two equi-joins with the inventory; the second
    one with one row per base name, so that neither repeats rows. Rows without a raw path do not take part. A path that
    very many rows share makes one large join partition, which adaptive execution splits: the inventory side has a single
    row for it.
    """
    root = root.rstrip("/")
    raw = F.col(raw_col)
    is_absolute = raw.startswith("/")
    full = F.when(is_absolute, raw).otherwise(paths.clean_path(F.concat(F.lit(root + "/"), raw)))
    keyed = df.where(raw.isNotNull()).withColumn("__full", full).withColumn("__base", paths.base_name(raw))

    exact = inventory.select(F.col("path").alias("__exact")).distinct()
    by_name = (
        inventory.select("path", paths.base_name(F.col("path")).alias("__name"))
        .groupBy("__name")
        .agg(
            F.max(F.when(F.col("path") == F.concat(F.lit(root + "/"), F.col("__name")), F.col("path"))).alias("__top"),
            F.min("path").alias("__any"),
        )
    )
    joined = keyed.join(exact, F.col("__full") == F.col("__exact"), "left").join(
        by_name, F.col("__base") == F.col("__name"), "left"
    )
    found = F.coalesce("__exact", F.when(~is_absolute, F.col("__top")), "__any")
    out = joined.withColumn("path", found).drop("__full", "__base", "__exact", "__name", "__top", "__any")
    if not keep_unresolved:
        return out.where("path is not null")
    return out.unionByName(df.where(raw.isNull()).withColumn("path", F.lit(None).cast("string")))


def existing_only(df: DataFrame, inventory: DataFrame, path_col: str = "path") -> DataFrame:
    return df.join(inventory.select(F.col("path").alias(path_col)), path_col, "left_semi")


def missing_paths(df: DataFrame, inventory: DataFrame, path_col: str = "path") -> DataFrame:
    return df.join(inventory.select(F.col("path").alias(path_col)), path_col, "left_anti")


def relative_paths(df: DataFrame, path_col: str = "path") -> DataFrame:
    return df.where(~F.col(path_col).startswith("/"))


def records_from_folders(
    inventory: DataFrame, root: str, aliases: Mapping[str, Sequence[str]] = defaults.CATEGORY_ALIASES
) -> DataFrame:
    """Class and split from the path alone; without a class a file is no record, without a split it is ``unsplit``."""
    path = F.col("path")
    return inventory.where(paths.is_image(path)).select(
        complete_rows(
            path,
            F.coalesce(tokens.split_from_path(path, root), F.lit("unsplit")).alias("split"),
            tokens.category_from_path(path, root, aliases).alias("category"),
            required=("category",),
        )
    )


def distinct_records(records: DataFrame) -> DataFrame:
    return records.select(*RECORD_COLUMNS).distinct()


def contributing_files(records: DataFrame) -> DataFrame:
    return records.select("source").distinct().orderBy("source")


def missing_categories(records: DataFrame, targets: Sequence[str] = defaults.TARGET_CATEGORIES) -> DataFrame:
    """Target classes without any record."""
    table = small_table(records.sparkSession, [(t,) for t in targets], "category string")
    present = records.where(F.col("category").isin(*targets)).select("category").distinct()
    return table.join(present, "category", "left_anti")


def fill_missing_categories(
    records: DataFrame, fallback: DataFrame, targets: Sequence[str] = defaults.TARGET_CATEGORIES
) -> DataFrame:
    """Add the fallback records of target classes that the records lack altogether."""
    # At most one row per target class.
    lacking = F.broadcast(missing_categories(records, targets))
    return records.select(*RECORD_COLUMNS).unionByName(
        fallback.select(*RECORD_COLUMNS).join(lacking, "category", "left_semi").select(*RECORD_COLUMNS)
    )


def combine_records(
    annotated: DataFrame, folders: DataFrame, targets: Sequence[str] = defaults.TARGET_CATEGORIES
) -> tuple[DataFrame, str]:
    """Annotated records filled up from folders; the folder records alone when there are no annotated ones."""
    if annotated.isEmpty():
        return folders.select(*RECORD_COLUMNS), "folders"
    return fill_missing_categories(distinct_records(annotated), folders, targets), "annotations"


def split_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("split").agg(F.count("*").alias("n"))


def class_distribution(
    records: DataFrame,
    classes: Sequence[str] = defaults.TARGET_CATEGORIES,
    splits: Sequence[str] = defaults.SPLITS,
) -> DataFrame:
    """Rows per split (known splits first, then others by name) with one zero-filled column per class."""
    counted = records.groupBy("split").agg(*[F.count_if(F.col("category") == c).alias(c) for c in classes])
    table = small_table(records.sparkSession, [(s, i) for i, s in enumerate(splits)], "split string, split_order bigint")
    joined = table.join(counted, "split", "full_outer").na.fill(0, list(classes))
    order = F.coalesce("split_order", F.lit(len(splits)))
    return joined.withColumn("split_order", order).orderBy("split_order", "split").drop("split_order")


def distribution(records: DataFrame) -> DataFrame:
    """Rows per split and class."""
    return records.groupBy("split", "category").agg(F.count("*").alias("n"))


def extra_splits(records: DataFrame, splits: Sequence[str] = defaults.SPLITS) -> DataFrame:
    return records.select("split").where(~F.col("split").isin(*splits)).distinct().orderBy("split")


def dataset_counts(records: DataFrame) -> DataFrame:
    """Train and validation rows."""
    return records.agg(
        F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "val").alias("val")
    )


def annotated_listed_images(
    categories: DataFrame, annotations: DataFrame, images: DataFrame, entries: DataFrame, category_name: str
) -> DataFrame:
    """Images annotated with a named class that also stand in a list: ``(position, file_name)``.

    ``categories(id, name)``, ``annotations(image_id, category_id)``, ``images(position, id, file_name)``,
    ``entries(entry)``.
    """
    wanted = categories.where(F.col("name") == category_name).select(F.col("id").alias("category_id"))
    marked = annotations.join(wanted, "category_id", "left_semi").select(F.col("image_id").alias("id"))
    listed = entries.select(F.col("entry").alias("file_name"))
    return images.join(marked, "id", "left_semi").join(listed, "file_name", "left_semi").select("position", "file_name")


def count_differences(
    records: DataFrame, expected: DataFrame, keys: Sequence[str] = ("split", "category")
) -> DataFrame:
    """Groups whose row count differs from ``expected(keys..., n)``, also those only one side has."""
    actual = records.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.count("*").alias("actual"))
    wanted = expected.select(*keys, F.col("n").alias("expected"))
    same = reduce(Column.__and__, [wanted[k].eqNullSafe(actual[f"__{k}"]) for k in keys])
    return (
        wanted.join(actual, same, "full_outer")
        .select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], "expected", "actual")
        .na.fill(0, ["expected", "actual"])
        .where("expected <> actual")
    )
