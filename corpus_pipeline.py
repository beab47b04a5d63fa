"""From raw documents to the token ids of a mixed corpus: stages that each write a table and read it again.

Every stage takes ``(spark, docs, sf_dir)``, works on all rows that the stage before it kept and returns the columns of
``docs``; the last returns token ids. ``sf_dir`` is there for stages that need other tables; none of these does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import byte_bpe, lines, mixing, quality, simhash
from tallyframe.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that keep every quality rule."""
    return quality.keep_good(docs)


def unshared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that they share with others of larger ids; ``n_chars`` follows the text."""
    kept = lines.drop_shared_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("bigint"))
    return kept.select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return simhash.keep_one(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them; sizes are words."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(quality.WORD)).cast("bigint")
    # The row as one column keeps the names of the mix and of the documents apart.
    mixed = mixing.mix(docs.select(F.struct("*").alias("row"), "source", size.alias("size")))
    return mixing.repeat_copies(mixed, ["row"]).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, the ids of the text and their number, and digests of the ids and of the decoded bytes."""
    coded = byte_bpe.encode(docs.select("doc_id", "source", "text"), decoded_col="decoded")
    return coded.select(
        "doc_id",
        "source",
        "n_tokens",
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", good_documents),
    ("line dedup", unshared_lines),
    ("SimHash near-dedup", distinct_documents),
    ("source mixing", mixed_sources),
    ("byte-level BPE", token_ids),
]

# Fingerprints need XXH64 and ids need BPE merges, which SQL has not.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
