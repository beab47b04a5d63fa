"""The rows of large JSON documents, each document read by many tasks.

A document is read as pieces between commas, wherever they stand. What a piece does to the state of a reader (inside a
text or not, how many brackets are open) depends on the state before it only through that one bit, so both cases are
summed inside each block of a file, then over the blocks. With the true state known, a piece that starts outside texts at
the depth of the row list begins an item; only the pieces of one item are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import broadcast_if_small, materialize

SEPARATOR = ","
_SPACE = " \t\r\n"
_MEMBER_HEAD = r'^\s*(?:\{\s*)?"([^"\\]*)"\s*:\s*\['
_LIST_HEAD = r"^\s*\["


def _opened(text: Column) -> Column:
    """Opening less closing brackets."""
    return F.length(F.translate(text, "]}", "")) - F.length(F.translate(text, "[{", ""))


def _walked(pieces: DataFrame) -> DataFrame:
    """Per piece and for both states at the start of its block: brackets open before it since then, and behind it."""
    plain = F.regexp_replace("value", r"\\.", "")
    text = r'"[^"]*("|$)'
    parts = pieces.select(
        "source",
        "block",
        "seq",
        "value",
        ((F.length(plain) - F.length(F.replace(plain, F.lit('"'), F.lit("")))) % 2).alias("flips"),
        _opened(F.regexp_replace(plain, text, "")).alias("outside"),
        _opened(F.regexp_replace(F.concat(F.lit('"'), plain), text, "")).alias("inside"),
    )
    earlier = Window.partitionBy("source", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("flipped", F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2)
    for start in (0, 1):
        turned = F.when((F.col("flipped") + start) % 2 == 0, F.col("outside")).otherwise(F.col("inside"))
        parts = parts.withColumn(f"own{start}", turned)
        parts = parts.withColumn(f"open{start}", F.coalesce(F.sum(f"own{start}").over(earlier), F.lit(0)))
    return parts.drop("outside", "inside")


def _block_starts(walked: DataFrame) -> DataFrame:
    """The true state at the start of each block, and what the block adds to it."""
    blocks = walked.groupBy("source", "block").agg(
        (F.sum("flips") % 2).alias("flips"), F.sum("own0").alias("own0"), F.sum("own1").alias("own1")
    )
    # One row per block of a file.
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("start", F.coalesce(F.sum("flips").over(earlier), F.lit(0)) % 2)
    blocks = blocks.withColumn("own", F.when(F.col("start") == 0, F.col("own0")).otherwise(F.col("own1")))
    return blocks.select(
        "source", "block", "start", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("base"), "flips", "own"
    )


def _documents(walked: DataFrame, starts: DataFrame) -> DataFrame:
    """``source, level`` of whole documents; ``level`` brackets are open between the items of the row list."""
    ends = starts.groupBy("source").agg((F.sum("flips") % 2).alias("flips"), F.sum("own").alias("open"))
    heads = walked.groupBy("source").agg(
        F.min_by("value", F.struct("block", "seq")).alias("head"), F.bool_and(F.is_valid_utf8("value")).alias("decoded")
    )
    whole = ends.join(heads, "source").where("flips = 0 AND open = 0 AND decoded")
    level = F.when(F.col("head").rlike(_LIST_HEAD), 1).when(F.col("head").rlike(r"^\s*\{"), 2)
    return whole.select("source", level.alias("level")).where("level IS NOT NULL")


def _row_lists(known: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``source, first, until``: where the row list of a document begins, and where the member behind it does."""
    members = known.where("NOT inside AND open < level").select("source", "level", "place", "value")
    key = F.regexp_extract("value", _MEMBER_HEAD, 1)
    rank = F.when(F.col("level") == 1, F.lit(1)).otherwise(
        F.when(F.col("value").rlike(_MEMBER_HEAD), F.nullif(F.array_position(F.array(*map(F.lit, keys)), key), F.lit(0)))
    )
    members = members.select("source", "place", rank.alias("rank"))
    chosen = members.where("rank IS NOT NULL").groupBy("source").agg(
        F.max_by("place", F.struct(-F.col("rank"), F.col("place"))).alias("first")
    )
    behind = members.join(chosen, "source").where(F.col("place") > F.col("first"))
    return chosen.join(behind.groupBy("source").agg(F.min("place").alias("until")), "source", "left")


def row_items(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``source, block, seq, item``: the JSON text of each row of the documents.

    ``pieces`` has ``source, block, seq, value``: the text between commas, in order inside a block of a file, blocks by
    their place in it. A document is a list of rows, or an object of which the first of ``keys`` that holds a list counts
    (keys as they are written, of equal ones the last). Documents with brackets or texts left open, or that can not be
    decoded, have no rows; whether an item is right by itself is left to its reader.
    """
    walked = materialize(_walked(pieces), "json-pieces")
    starts = materialize(_block_starts(walked), "json-blocks")
    documents = materialize(_documents(walked, starts), "json-documents")
    opened = F.when(F.col("start") == 0, F.col("open0")).otherwise(F.col("open1")) + F.col("base")
    own = F.when(F.col("start") == 0, F.col("own0")).otherwise(F.col("own1"))
    known = (
        walked.join(broadcast_if_small(starts.select("source", "block", "start", "base")), ["source", "block"])
        .join(broadcast_if_small(documents), "source")
        .select(
            "source",
            "level",
            "block",
            F.struct("block", "seq").alias("place"),
            "value",
            ((F.col("flipped") + F.col("start")) % 2 == 1).alias("inside"),
            opened.alias("open"),
            (opened + own).alias("left_open"),
        )
    )
    lists = materialize(_row_lists(known, keys), "json-lists")
    held = known.join(broadcast_if_small(lists), "source").where(
        (F.col("place") >= F.col("first")) & (F.col("until").isNull() | (F.col("place") < F.col("until")))
    )
    line = Window.partitionBy("source", "block").orderBy("place.seq").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.when(~F.col("inside") & (F.col("open") <= F.col("level")), F.col("place"))
    held = materialize(held.withColumn("own", F.last(begins, ignorenulls=True).over(line)), "json-held")

    # An item goes on over blocks: the last beginning before a block is one row.
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = held.groupBy("source", "block").agg(F.max("own").alias("last"))
    carried = last.select("source", "block", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    held = held.join(broadcast_if_small(carried), ["source", "block"])
    items = held.groupBy("source", F.coalesce("own", "carried").alias("item_place")).agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("place", "value"))), lambda part: part["value"]), SEPARATOR
        ).alias("item"),
        F.max_by("left_open", "place").alias("left_open"),
        F.first("level").alias("level"),
        F.first("first").alias("first"),
    )
    headless = F.when(
        F.col("item_place") == F.col("first"),
        F.when(F.col("level") == 1, F.regexp_replace("item", _LIST_HEAD, "")).otherwise(F.regexp_replace("item", _MEMBER_HEAD, "")),
    ).otherwise(F.col("item"))
    closed = F.when(F.col("left_open") < F.col("level"), F.regexp_replace(headless, r"\s*\]\s*\}?\s*$", "")).otherwise(headless)
    trimmed = F.btrim(closed, F.lit(_SPACE))
    return items.select(
        "source", F.col("item_place.block").alias("block"), F.col("item_place.seq").alias("seq"), trimmed.alias("item")
    ).where("item != ''")
