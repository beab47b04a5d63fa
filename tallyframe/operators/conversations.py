"""Validation of conversation files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.records import missing_paths, relative_paths
from tallyframe.operators.sampling import require_none
from tallyframe.session import small_table


def violations(rows: DataFrame) -> DataFrame:
    """Rows that cannot be used, with what they lack. ``rows`` is what ``sources.conversations.parsed_lines`` gives."""
    problem = (
        F.when(F.col("messages").isNull(), "invalid JSON")
        .when(F.col("image_path").isNull(), "missing image path")
        .when(F.col("label").isNull(), "missing answer")
    )
    return rows.select(
        *[c for c in ("split", "source", "block", "seq", "index") if c in rows.columns], problem.alias("problem")
    ).where("problem is not null")


def label_path_counts(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per answer: rows, rows whose image is missing, rows whose image path is relative.

    Rows are counted per (label, path) before they meet the inventory, so a path that very many rows share reaches the
    join once per label.
    """
    counted = rows.groupBy("label", "image_path").agg(F.count("*").alias("n"))
    known = inventory.select(F.col("path").alias("image_path"), F.lit(True).alias("known")).distinct()
    checked = counted.join(known, "image_path", "left")
    missing = F.col("image_path").isNotNull() & F.col("known").isNull()
    relative = F.col("image_path").isNotNull() & ~F.col("image_path").startswith("/")
    zero = F.lit(0)
    return checked.groupBy("label").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(missing, F.col("n")).otherwise(zero)).alias("missing"),
        F.sum(F.when(relative, F.col("n")).otherwise(zero)).alias("relative"),
    )


def validation_summary(rows: DataFrame, inventory: DataFrame, strict: bool = False) -> DataFrame:
    """One row: records, records per class, missing and relative image paths, and whether the paths are all right.

    ``strict`` raises when a row has no image path or answer. Path problems are counted here; ``path_problems`` lists
    them.
    """
    if strict:
        require_none(violations(rows), "Invalid rows")
    entries = F.array_sort(F.collect_list(F.struct(F.col("label").alias("key"), F.col("n").alias("value"))))
    return (
        label_path_counts(rows, inventory)
        .agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"),
            F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull())).alias("category_counts"),
            F.coalesce(F.sum("missing"), F.lit(0)).alias("missing_paths"),
            F.coalesce(F.sum("relative"), F.lit(0)).alias("relative_paths"),
        )
        .withColumn("is_valid", (F.col("missing_paths") == 0) & (F.col("relative_paths") == 0))
    )


def split_summaries(rows: DataFrame, inventory: DataFrame, splits: Sequence[str]) -> DataFrame:
    """What ``validation_summary`` tells, one row per ``split``: the wanted ones, also without rows, and all others met."""
    counted = rows.groupBy("split", "label", "image_path").agg(F.count("*").alias("n"))
    known = inventory.select(F.col("path").alias("image_path"), F.lit(True).alias("known")).distinct()
    given = F.col("image_path").isNotNull()
    n_if = lambda flag: F.sum(F.when(flag, F.col("n")).otherwise(0))
    per_label = counted.join(known, "image_path", "left").groupBy("split", "label").agg(
        F.sum("n").alias("n"),
        n_if(given & F.col("known").isNull()).alias("missing"),
        n_if(given & ~F.col("image_path").startswith("/")).alias("relative"),
    )
    entries = F.array_sort(F.collect_list(F.struct(F.col("label").alias("key"), F.col("n").alias("value"))))
    found = per_label.groupBy("split").agg(
        F.sum("n").alias("total_records"),
        F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull())).alias("category_counts"),
        F.sum("missing").alias("missing_paths"),
        F.sum("relative").alias("relative_paths"),
    )
    wanted = small_table(rows.sparkSession, [(s,) for s in splits], "wanted string")
    joined = found.join(F.broadcast(wanted), F.col("split").eqNullSafe(F.col("wanted")), "full_outer")
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return joined.select(
        F.coalesce("split", "wanted").alias("split"),
        F.col("wanted").isNotNull().alias("expected_split"),
        F.coalesce("total_records", F.lit(0)).alias("total_records"),
        F.coalesce("category_counts", nothing).alias("category_counts"),
        F.coalesce("missing_paths", F.lit(0)).alias("missing_paths"),
        F.coalesce("relative_paths", F.lit(0)).alias("relative_paths"),
    ).withColumn("is_valid", (F.col("missing_paths") == 0) & (F.col("relative_paths") == 0))


def path_problems(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Every image path that is missing or relative, with the kind of problem."""
    given = rows.where("image_path is not null").select("image_path")
    missing = missing_paths(given, inventory, "image_path").withColumn("problem", F.lit("missing"))
    relative = relative_paths(given, "image_path").withColumn("problem", F.lit("relative"))
    return missing.unionByName(relative)


def expectation_table(spark, expected: Mapping[str, Mapping[str, int]]) -> DataFrame:
    rows = [(split, category, n) for split, per_class in expected.items() for category, n in per_class.items()]
    return small_table(spark, rows, "split string, category string, n bigint")
