"""Lines that many documents share, dropped from all but one of them (operator 10).

Only hashes, positions and document ids are shuffled to find the lines. The texts move once, to meet the positions that
they lose, and each is put together again in its own row. Everything is built from DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.quality import SPACE, _bind
from tallyframe.session import materialize

MIN_CHARS = 40
MIN_DOCUMENTS = 5

CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line without white space (space, U+0009 to U+000D) at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), CAPITALS, CAPITALS.lower())


def _without(lines: Column, dropped: Column) -> Column:
    """``lines`` without those at the ascending 0-based positions ``dropped``, in time linear in both."""

    def kept(before: Column) -> Column:
        # Runs between one dropped position and the next; -1 and the number of lines are the outer ends.
        starts = F.slice(before, 1, F.size(before) - 1)
        return F.flatten(F.transform(starts, lambda at, i: F.slice(lines, at + 2, F.get(before, i + 1) - at - 1)))

    return _bind(F.concat(F.array(F.lit(-1)), dropped, F.array(F.size(lines))), kept)


def drop_shared_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_documents: int = MIN_DOCUMENTS,
) -> DataFrame:
    r"""Replace each text by the lines it keeps; add ``n_lines`` (before) and ``n_dropped``.

    A line whose key (``line_key``) has at least ``min_chars`` code points and stands in at least ``min_documents``
    documents is dropped everywhere but in the document with the largest id among them, which keeps all of them. Texts
    are split and joined at \n; a null or empty text is one empty line. Rows with the same id are one document, each
    with its own text; a null id is a document like any other, and the smallest. Every row stays, with its other
    columns. Keys are compared by 128 bits of hashes.
    """
    doc, text_hash, size = "__llm_doc", "__llm_hash", "__llm_size"
    text = F.coalesce(F.col(text_col), F.lit(""))
    # A row's positions follow from its id and text, so repeated rows share them.
    identity = [F.col(id_col).alias(doc), F.xxhash64(text).alias(text_hash), F.octet_length(text).alias(size)]

    lines = docs.select(*identity, F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    # A key is no longer than its line.
    keys = lines.where(F.length("line") >= min_chars).withColumn("key", line_key(F.col("line")))
    hashed = materialize(
        keys.where(F.length("key") >= min_chars).select(
            doc, text_hash, size, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")
        ),
        "line-hashes",
    )
    shared = (
        hashed.groupBy("h1", "h2", doc)
        .agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2")
        .agg(F.count("*").alias("documents"), F.max(doc).alias("keeper"))
        .where(F.col("documents") >= min_documents)
        .select("h1", "h2", "keeper")
    )
    positions = (
        hashed.join(shared, ["h1", "h2"])
        .where(~F.col(doc).eqNullSafe(F.col("keeper")))
        .groupBy(doc, text_hash, size)
        .agg(F.sort_array(F.collect_set("pos")).alias("__llm_dropped"))
        .withColumnsRenamed({doc: "__llm_d", text_hash: "__llm_h", size: "__llm_s"})
    )
    rows = docs.withColumns({doc: F.col(id_col), text_hash: F.xxhash64(text), size: F.octet_length(text)})
    met = rows.join(
        positions,
        rows[doc].eqNullSafe(positions["__llm_d"])
        & (rows[text_hash] == positions["__llm_h"])
        & (rows[size] == positions["__llm_s"]),
        "left",
    )
    split = F.split(text, "\n", -1)
    rest = _bind(split, lambda listed: F.array_join(_without(listed, F.col("__llm_dropped")), "\n"))
    dropped = F.when(F.col("__llm_dropped").isNull(), 0).otherwise(F.size("__llm_dropped"))
    return met.withColumns(
        {
            "n_lines": (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint"),
            "n_dropped": dropped.cast("bigint"),
            text_col: F.when(F.col("__llm_dropped").isNull(), F.col(text_col)).otherwise(rest),
        }
    ).drop(doc, text_hash, size, "__llm_d", "__llm_h", "__llm_s", "__llm_dropped")
