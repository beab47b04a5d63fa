"""Conversation files (one JSON object per line), split lists, COCO documents and metrics documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions import messages as msg
from tallyframe.functions import tokens
from tallyframe.functions.text import complete_rows
from tallyframe.operators.records import existing_only
from tallyframe.operators.sampling import first_rows, require_none
from tallyframe.session import small_table
from tallyframe.sources.files import exists, indexed_lines, list_entries, source_path, text_rows


def require_path(spark: SparkSession, path: str) -> None:
    if not exists(spark, path):
        raise FileNotFoundError(path)


def parsed_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``source, block, seq, messages, label, image_path`` of every non-blank line; what cannot be parsed is null."""
    lines = text_rows(spark, path).where(F.trim("value") != "")
    return _with_fields(lines)


def parsed_splits(spark: SparkSession, path: str) -> DataFrame:
    """``split`` and the columns of ``parsed_lines`` of a folder with one sub-folder ``split=...`` per split, in one read."""
    lines = spark.read.schema("value string, split string").text(path).select(
        "split",
        source_path().alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    return _with_fields(lines.where(F.trim("value") != ""))


def _with_fields(lines: DataFrame) -> DataFrame:
    parsed = lines.withColumn("messages", msg.parse_messages(F.col("value")))
    return parsed.select(
        *[c for c in lines.columns if c != "value"],
        "messages",
        msg.answer_label(F.col("messages")).alias("label"),
        msg.image_path(F.col("messages")).alias("image_path"),
    )


def training_rows(
    spark: SparkSession, path: str, limit: int | None = None, strict: bool = True
) -> DataFrame:
    """``messages_json, label`` of a conversation file, the first ``limit`` lines of it when given.

    ``strict`` raises when a line has no answer; otherwise such rows have a null label.
    """
    require_path(spark, path)
    lines = text_rows(spark, path).where(F.trim("value") != "")
    rows = _with_fields(first_rows(lines, limit, ["source", "block", "seq"]))
    if strict:
        require_none(rows.where("label is null").select("source", "block", "seq"), "Lines without an answer")
    return rows.select(msg.messages_json(F.col("messages")).alias("messages_json"), "label")


def evaluation_samples(
    spark: SparkSession, path: str, limit: int | None = None, strict: bool = True
) -> DataFrame:
    """``index, messages, true_label, image_path`` with a dense 0-based index over the non-blank lines."""
    require_path(spark, path)
    lines = indexed_lines(spark, path)
    if limit is not None:
        lines = lines.where(F.col("index") < limit)
    rows = _with_fields(lines)
    if strict:
        require_none(rows.where("label is null").select("source", "index"), "Lines without an answer")
    return rows.select("index", "messages", F.col("label").alias("true_label"), "image_path")


def listed_records(
    spark: SparkSession, list_file: str, split: str, image_root: str, inventory: DataFrame, root: str
) -> DataFrame:
    """Records of a split list: one relative path per line; files that do not exist or show no class are skipped."""
    entries = list_entries(spark, list_file)
    located = entries.select(F.concat(F.lit(image_root.rstrip("/") + "/"), F.col("entry")).alias("path"))
    category = tokens.category_from_path(F.col("path"), root).alias("category")
    return existing_only(located, inventory).select(
        complete_rows(F.col("path"), F.lit(split).alias("split"), category, required=("category",))
    )


COCO_SCHEMA = (
    "categories array<struct<id bigint, name string>>,"
    "annotations array<struct<image_id bigint, category_id bigint>>,"
    "images array<struct<id bigint, file_name string>>"
)


def coco_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``categories(id, name)``, ``annotations(image_id, category_id)``, ``images(position, id, file_name)``.

    A missing array gives no rows; ``position`` is the place in the document.
    """
    document = spark.read.schema(COCO_SCHEMA).json(path, multiLine=True)
    return (
        document.select(F.inline("categories")),
        document.select(F.inline("annotations")),
        document.select(F.posexplode("images").alias("position", "image")).select("position", "image.*"),
    )


METRICS_SCHEMA = (
    "total_samples bigint, labels array<string>, accuracy double, macro_f1 double,"
    "per_class map<string,struct<precision:double,recall:double,f1:double,support:bigint>>,"
    "binary_positive_labels array<string>,"
    "confusion_matrix struct<labels:array<string>,matrix:array<array<bigint>>>,"
    "class_distribution map<string,bigint>, prediction_distribution map<string,bigint>, binary_roc_auc double,"
    "gate struct<name:string,passed:boolean>"
)


def checkpoint_metrics(
    spark: SparkSession, pattern: str, steps: Sequence[int], step_pattern: str = r"checkpoint-([0-9]+)"
) -> DataFrame:
    """One row per expected step with ``found``, and the metrics document of the steps that have one."""
    expected = small_table(spark, [(int(s), i) for i, s in enumerate(steps)], "step bigint, step_order int")
    try:
        read = spark.read.schema(METRICS_SCHEMA).json(pattern, multiLine=True)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        read = spark.createDataFrame([], METRICS_SCHEMA).withColumn("step", F.lit(None).cast("bigint"))
    else:
        step = F.regexp_extract(source_path(), step_pattern, 1).try_cast("bigint")
        read = read.select(step.alias("step"), *read.columns)
    return (
        expected.join(read, "step", "left")
        .withColumn("found", F.col("total_samples").isNotNull())
        .orderBy("step_order")
        .drop("step_order")
    )


def sample_documents(records: DataFrame, classes: Sequence[str] = defaults.SAMPLE_ORDER) -> DataFrame:
    """One conversation per class in the given order; ``records`` holds one (path, category) per class."""
    order = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("category"))
    return records.where(order > 0).select(
        (order - 1).alias("position"), "category", msg.training_messages(F.col("path"), F.col("category")).alias("messages")
    )
