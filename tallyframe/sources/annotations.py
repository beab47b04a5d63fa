"""Annotation files of mixed formats (CSV, TSV, TXT, JSON, JSON lines) as record rows.

Files are found by the pattern of their names and read as lines, all of them in one scan; what belongs to a file (its
header, whether it can be decoded) is an aggregate per file that is joined back. No list of files or lines reaches the
driver. Which header field holds the image, the class and the split is decided once per file.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions import paths, tokens
from tallyframe.functions.messages import JSON_OPTIONS
from tallyframe.functions.text import complete_rows, strip
from tallyframe.operators.records import resolve_paths
from tallyframe.session import broadcast_if_small, file_blocks, materialize
from tallyframe.sources import delimited, json_documents
from tallyframe.sources.files import annotation_files, exists, source_path

RECORD_SCHEMA = "source string, path string, split string, category string"
TEXT_SUFFIXES = (".csv", ".tsv", ".txt")
# What a task reads where blocks are smaller.
BYTES_PER_TASK = 16 << 20


def _pattern(*suffixes: str) -> str:
    """A file name pattern for the suffixes in any case."""
    any_case = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in suffix) for suffix in suffixes]
    return "{" + ",".join(f"*{suffix}" for suffix in any_case) + "}"


def _lines(
    spark: SparkSession, folder: str, listed: DataFrame, *suffixes: str, separator: str | None = None, block_bytes: int | None = None
) -> DataFrame:
    """``source, block, seq, value`` of every line (or text between separators) of the ``listed`` files with these suffixes.

    With ``block_bytes`` files are cut into blocks of this size instead of the session's. Only this one read is cut so, and
    a task takes many small blocks: each task reports to the driver, so their number must not follow that of the blocks.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", _pattern(*suffixes))
    rows = reader.text(folder, lineSep=separator).select(
        source_path().alias("source"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
        "value",
    )
    if block_bytes is not None:
        with file_blocks(spark, block_bytes):
            tasks = max(spark.sparkContext.defaultParallelism, rows.rdd.getNumPartitions() * block_bytes // BYTES_PER_TASK)
            rows = materialize(rows.coalesce(tasks), "blocks")
    return rows.join(listed.select(F.col("path").alias("source")), "source", "left_semi")


def file_facts(lines: DataFrame) -> DataFrame:
    """Per file: its first line's place, its delimiter (null: none), and whether a line can not be decoded."""
    place = F.struct("block", "seq")
    facts = lines.groupBy("source").agg(
        F.min(place).alias("first"),
        F.min_by("value", place).alias("head"),
        F.bool_or(~F.is_valid_utf8("value")).alias("broken"),
    )
    return facts.select("source", "first", delimited.sniff_delimiter(F.col("source"), F.col("head")).alias("mark"), "broken")


def text_heads(records: DataFrame) -> DataFrame:
    """Which fields of a delimited file hold the image, the class and the split (0-based, null: none), per file.

    ``records`` has ``source, place, value, first, mark``. Files without a second named field in their header are left
    out; of equal header names the last one counts.
    """
    head = records.where(F.col("place") == F.col("first"))
    named = head.select("source", "first", "mark", delimited.fields(F.col("value"), F.col("mark")).alias("header"))
    named = named.where(F.size(F.filter("header", lambda name: name.isNotNull())) > 1)
    looked = named.join(header_columns(named).select("source", "image_col", "label_col", "split_col", "file_split"), "source")

    def place(name: str) -> Column:
        found = F.array_position(F.reverse("header"), F.col(name))
        return F.when(found > 0, F.size("header") - found).cast("int")

    places = [place(f"{kind}_col").alias(f"{kind}_at") for kind in ("image", "label", "split")]
    return looked.select("source", "file_split", *places)


def delimited_rows(
    records: DataFrame, heads: DataFrame, aliases: Mapping[str, Sequence[str]] = defaults.CATEGORY_ALIASES
) -> DataFrame:
    """Image, class and split as each record below a header tells them; ``heads`` is what ``text_heads`` gives."""
    below = records.join(heads.where("image_at IS NOT NULL"), "source")
    split = below.where((F.col("place") > F.col("first")) & (F.col("value") != "")).withColumn(
        "fields", delimited.fields(F.col("value"), F.col("mark"))
    )
    return split.select("source", "file_split", *_told(lambda kind: F.get("fields", F.col(f"{kind}_at")), aliases))


def _told(field: Callable[[str], Column], aliases: Mapping[str, Sequence[str]]) -> list[Column]:
    return [
        field("image").alias("raw_path"),
        tokens.canonical_category(field("label"), aliases).alias("given_category"),
        tokens.canonical_split(field("split")).alias("given_split"),
    ]


def _unreadable(line: Column) -> Column:
    """Whether a line is no JSON. Variants end at 16 MB, so a line that gives none is read as an object or a list."""
    checked = F.from_json(line, "__other string, __bad string", {**JSON_OPTIONS, "columnNameOfCorruptRecord": "__bad"})
    as_list = F.ltrim(line).startswith("[") & F.from_json(line, "array<string>", JSON_OPTIONS).isNotNull()
    return F.when(F.try_parse_json(line).isNotNull(), False).otherwise(checked["__bad"].isNotNull() & ~as_list)


def _json_values(pieces: DataFrame) -> DataFrame:
    """Rows of JSON documents read as pieces between commas; one item that can not be read drops its whole document."""
    items = materialize(json_documents.row_items(pieces, defaults.JSON_ROW_KEYS), "json-items")
    bad = items.where(_unreadable(F.col("item"))).select("source").distinct()
    return items.join(broadcast_if_small(materialize(bad, "bad-documents")), "source", "left_anti")


def _json_lines(lines: DataFrame) -> DataFrame:
    """Rows of JSON-lines files; one bad line drops its whole file."""
    kept = lines.where(F.trim("value") != "")
    bad = kept.where(~F.is_valid_utf8("value") | _unreadable(F.col("value"))).select("source").distinct()
    return kept.join(broadcast_if_small(materialize(bad, "bad-files")), "source", "left_anti").withColumnRenamed("value", "item")


def json_rows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, headers)`` of JSON items (``source, block, seq, item``); items that are no objects are dropped."""
    parsed = items.where(F.ltrim("item").startswith("{")).withColumn("row", F.from_json("item", "map<string,string>", JSON_OPTIONS))
    rows = materialize(parsed.select("source", "block", "seq", "row"), "json-rows")
    heads = rows.groupBy("source").agg(F.min_by(F.map_keys("row"), F.struct("block", "seq")).alias("header"))
    return rows.select("source", "row"), heads


def header_columns(heads: DataFrame) -> DataFrame:
    """Which header field holds the image, the class and the split, per file; and the split the file name tells."""
    return heads.select(
        "source",
        tokens.column_lookup(F.col("header"), defaults.IMAGE_COLUMNS).alias("image_col"),
        tokens.column_lookup(F.col("header"), defaults.LABEL_COLUMNS).alias("label_col"),
        tokens.column_lookup(F.col("header"), defaults.SPLIT_COLUMNS).alias("split_col"),
        tokens.canonical_split(paths.stem(F.col("source"))).alias("file_split"),
    )


def map_rows(
    rows: DataFrame, heads: DataFrame, aliases: Mapping[str, Sequence[str]] = defaults.CATEGORY_ALIASES
) -> DataFrame:
    """Image, class and split as each map ``row`` tells them, by the header of its file."""
    located = rows.join(broadcast_if_small(header_columns(heads)), "source").where("image_col is not null")
    return located.select("source", "file_split", *_told(lambda kind: F.try_element_at("row", F.col(f"{kind}_col")), aliases))


def records_from_rows(
    raw: DataFrame, inventory: DataFrame, root: str, aliases: Mapping[str, Sequence[str]] = defaults.CATEGORY_ALIASES
) -> DataFrame:
    """Resolve the image, then class and split of each row; rows that lack any of them are dropped."""
    found = resolve_paths(raw, inventory, root, "raw_path")
    return found.select(
        complete_rows(
            F.col("source"),
            F.col("path"),
            F.coalesce("given_split", "file_split", tokens.split_from_path(F.col("path"), root)).alias("split"),
            F.coalesce("given_category", tokens.category_from_path(F.col("path"), root, aliases)).alias("category"),
            required=("split", "category"),
        )
    )


def records_from_lists(
    lines: DataFrame,
    inventory: DataFrame,
    root: str,
    aliases: Mapping[str, Sequence[str]] = defaults.CATEGORY_ALIASES,
) -> DataFrame:
    """Headerless lists ``path [words...]`` given as (source, value): class and split are the first words that tell."""
    words = F.split(strip(F.col("value")), r"[\s,]+")
    parsed = lines.where(F.trim("value") != "").select("source", words.alias("words"))
    tail = F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0)))

    def first_known(of_word):
        return F.get(F.filter(F.transform(tail, of_word), lambda x: x.isNotNull()), F.lit(0))

    raw = parsed.select(
        "source",
        F.get("words", F.lit(0)).alias("raw_path"),
        first_known(lambda w: tokens.canonical_category(w, aliases)).alias("given_category"),
        F.coalesce(
            tokens.canonical_split(paths.stem(F.col("source"))), first_known(lambda w: tokens.canonical_split(w))
        ).alias("given_split"),
    )
    found = resolve_paths(raw, inventory, root, "raw_path")
    return found.select(
        complete_rows(
            F.col("source"),
            F.col("path"),
            F.coalesce("given_split", tokens.split_from_path(F.col("path"), root)).alias("split"),
            F.coalesce("given_category", tokens.category_from_path(F.col("path"), root, aliases)).alias("category"),
            required=("split", "category"),
        )
    )


def annotation_records(
    spark: SparkSession,
    root: str,
    inventory: DataFrame,
    aliases: Mapping[str, Sequence[str]] = defaults.CATEGORY_ALIASES,
    folder: str | None = None,
    block_bytes: int | None = None,
) -> DataFrame:
    """Records of all annotation files of the inventory, with their source file, before removing duplicates.

    The files lie below ``folder`` (``root`` unless given) and are read in blocks of ``block_bytes`` if given. A delimited
    file that yields no record under its header is taken for a headerless list; one that is not UTF-8 is passed over.
    """
    folder = folder or root
    if not exists(spark, folder):
        return spark.createDataFrame([], RECORD_SCHEMA)
    listed = materialize(annotation_files(inventory).select("path"), "annotation-names")
    name = F.lower("path")
    kinds = listed.agg(
        F.bool_or(name.endswith(".json")).alias("documents"),
        F.bool_or(name.endswith(".jsonl")).alias("lines"),
        F.bool_or(~name.rlike("[.]jsonl?$")).alias("text"),
    ).first()
    pictures = inventory.where(paths.is_image(F.col("path")))
    found = spark.createDataFrame([], RECORD_SCHEMA)

    def read(*suffixes: str, separator: str | None = None) -> DataFrame:
        return _lines(spark, folder, listed, *suffixes, separator=separator, block_bytes=block_bytes)

    items = [_json_values(read(".json", separator=json_documents.SEPARATOR))] if kinds["documents"] else []
    items += [_json_lines(read(".jsonl"))] if kinds["lines"] else []
    if items:
        rows, heads = json_rows(items[0] if len(items) == 1 else items[0].unionByName(items[1]))
        found = found.unionByName(records_from_rows(map_rows(rows, heads, aliases), pictures, root, aliases))
    if not kinds["text"]:
        return found

    # The positions must be the same for all that follows.
    lines = materialize(read(*TEXT_SUFFIXES), "annotation-lines")
    facts = materialize(file_facts(lines), "annotation-facts")
    lines = lines.join(facts.where("NOT broken").drop("broken"), "source")
    marked = lines.where(F.col("mark").isNotNull())
    records = delimited.logical_records(marked).join(facts.select("source", "first", "mark"), "source")
    heads = materialize(text_heads(records), "annotation-heads")
    headed = records_from_rows(delimited_rows(records, heads, aliases), pictures, root, aliases)
    headed = materialize(headed, "annotations")
    done = headed.select("source").distinct()
    rest = lines.join(broadcast_if_small(done), "source", "left_anti").select("source", "value")
    return found.unionByName(headed).unionByName(records_from_lists(rest, pictures, root, aliases))
