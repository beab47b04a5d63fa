"""Building a conversation dataset: choose records, write conversations, read them back and validate them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions import messages as msg
from tallyframe.functions import tokens
from tallyframe.operators import conversations, records, sampling
from tallyframe.session import materialize
from tallyframe.sources import annotations, files, sinks
from tallyframe.sources import conversations as readers


def load_records(
    spark: SparkSession, root: str, inventory: DataFrame | None = None, folder: str | None = None
) -> tuple[DataFrame, DataFrame | None, str]:
    """Records of a dataset folder, the annotation files that contributed, and ``annotations`` or ``folders``.

    Annotation files are read below ``folder`` (``root`` unless given).
    """
    listed = files.file_inventory(spark, root) if inventory is None else inventory
    annotated = materialize(annotations.annotation_records(spark, root, listed, folder=folder), "records")
    combined, kind = records.combine_records(annotated, records.records_from_folders(listed, root))
    return combined, records.contributing_files(annotated) if kind == "annotations" else None, kind


def flat_folder_records(
    inventory: DataFrame,
    folder: str,
    root: str,
    quotas: Mapping[str, Mapping[str, int]] = defaults.SPLIT_QUOTAS,
    strict: bool = True,
) -> DataFrame:
    """Images directly in one folder, split by quota in the order of their names."""
    prefix = folder.rstrip("/") + "/"
    direct = files.images(inventory).where(
        F.col("path").startswith(prefix) & ~F.substr(F.col("path"), F.lit(len(prefix) + 1)).contains("/")
    )
    classed = direct.select("path", tokens.category_from_path(F.col("path"), root).alias("category"))
    if strict and not classed.isEmpty():
        sampling.require_none(sampling.quota_shortfall(classed, "category", quotas), "Too few images")
    return sampling.quota_split(classed, "category", ["path"], quotas).select("path", "split", "category")


def choose_records(
    spark: SparkSession,
    root: str,
    split_lists: Mapping[str, str],
    image_root: str,
    flat_folder: str,
    quotas: Mapping[str, Mapping[str, int]] = defaults.SPLIT_QUOTAS,
    inventory: DataFrame | None = None,
    folder: str | None = None,
) -> DataFrame:
    """Records of all wanted splits; per split the first source that has any: list file, quota folder, annotations.

    ``inventory`` has the files below ``root`` (their ``path``); unless given, the folder is listed. Annotation files are
    read below ``folder`` (``root`` unless given), so that an inventory may tell of a root that this store does not hold.
    """
    root = root.rstrip("/")
    inventory = materialize(files.file_inventory(spark, root) if inventory is None else inventory, "inventory")
    flat = everything = None
    chosen = []
    for split, list_file in split_lists.items():
        found = readers.listed_records(spark, list_file, split, image_root, files.images(inventory), root)
        if found.isEmpty() and split in quotas:
            flat = flat_folder_records(inventory, flat_folder, root, quotas) if flat is None else flat
            found = flat.where(F.col("split") == split)
        if found.isEmpty():
            everything = load_records(spark, root, inventory, folder)[0] if everything is None else everything
            found = everything.where(F.col("split") == split)
        chosen.append(found.select("path", "split", "category"))
    union = chosen[0]
    for part in chosen[1:]:
        union = union.unionByName(part)
    return union


@dataclass(frozen=True)
class DatasetBuild:
    """``summaries`` has one row per split, ``differences`` the groups of split and class whose counts are not as expected."""

    summaries: DataFrame
    differences: DataFrame


def build_dataset(
    chosen: DataFrame,
    inventory: DataFrame,
    output: str,
    splits: Sequence[str] = ("train", "val"),
    expected: Mapping[str, Mapping[str, int]] = defaults.SPLIT_QUOTAS,
) -> DatasetBuild:
    """Write one folder of conversations per split in one job, then read all of them once and validate them.

    A wanted split without rows has a summary of zeros; splits that were not asked for are summed up and compared too.
    """
    spark = chosen.sparkSession
    talks = chosen.select("split", msg.training_messages(F.col("path"), F.col("category")).alias("messages"))
    sinks.write_conversations(talks, output, by_split=True)
    lines = readers.parsed_splits(spark, output)
    parsed = materialize(lines.withColumn("messages", F.when(F.col("messages").isNotNull(), True)), "written")
    sampling.require_none(conversations.violations(parsed), "Invalid rows")
    labels = parsed.select("split", F.col("label").alias("category"))
    differences = records.count_differences(labels, conversations.expectation_table(spark, expected))
    return DatasetBuild(conversations.split_summaries(parsed, inventory, splits), differences)


def listed_samples(
    entries: DataFrame,
    inventory: DataFrame,
    image_root: str,
    prefixes: Mapping[str, str],
    coco: tuple[DataFrame, DataFrame, DataFrame] | None = None,
    annotated: tuple[str, str] | None = None,
) -> DataFrame:
    """``path, category``: per class the first list entry below a folder, or the first annotated image that is listed.

    ``entries`` is ``files.list_entries``; ``prefixes`` maps a class to its folder; ``annotated`` is (class, name of the
    category in the ``coco`` tables). Files that do not exist are passed over.
    """
    root = image_root.rstrip("/") + "/"
    path = F.concat(F.lit(root), F.col("entry")).alias("path")
    present = records.existing_only(entries.select("entry", "position", path), inventory)
    folder = F.create_map(*[F.lit(x) for category, prefix in prefixes.items() for x in (f"{prefix}/", category)])
    category = F.try_element_at(folder, F.concat(F.substring_index("entry", "/", 1), F.lit("/")))
    firsts = (
        present.withColumn("category", category)
        .where("category is not null")
        .groupBy("category")
        .agg(F.min_by("path", "position").alias("path"))
        .select("path", "category")
    )
    if coco is None or annotated is None:
        return firsts
    wanted, name = annotated
    marked = records.annotated_listed_images(*coco, entries, name)
    located = marked.select("position", F.concat(F.lit(root), F.col("file_name")).alias("path"))
    first = sampling.first_row(records.existing_only(located, inventory), "path", "position")
    return firsts.unionByName(first.select("path", F.lit(wanted).alias("category")))


def dataset_size(spark: SparkSession, list_files: Mapping[str, str], root: str) -> tuple[int, int]:
    """Rows for training and validation: from the list files when both exist, else from the records of the folder."""
    listed = {split: files.count_list_entries(spark, path) for split, path in list_files.items()}
    if listed.get("train") is not None and listed.get("val") is not None:
        return listed["train"], listed["val"]
    row = records.dataset_counts(load_records(spark, root)[0]).first()
    return row["train"], row["val"]


def sample_records(
    listed: DataFrame | None, fallback: DataFrame, classes: Sequence[str] = defaults.SAMPLE_ORDER
) -> DataFrame:
    """One record per class: the listed ones when every class has one, else the smallest path per class."""
    if listed is not None and listed.where(F.col("category").isin(*classes)).count() == len(classes):
        return listed.select("path", "category")
    picked = sampling.pick_per_class(fallback.where(F.col("category").isin(*classes)), "category", "path", "split", "train")
    return picked.select("path", "category")
