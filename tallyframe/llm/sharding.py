"""Shards of near equal size from sampled splitters (operator 7).

A sample weighted by size gives splitters that cut the key order into many narrow ranges. Ranges are then counted, and
those that are overfull are subdivided by further splitters drawn inside them, until none is. Sizes of the ranges are
known exactly, and shards end at the very row by running sums inside ranges. Keys start with a hash of the text, so equal
texts lie side by side; a text that fills more than a shard is cut by document. Everything is built from DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import broadcast_if_small, materialize

SHARDS = 16
# Rows of a range as aimed at; ranges that the first splitters make at most; parts that an overfull range is cut into at
# once; and so many times the rows aimed at are overfull.
RANGE_ROWS = 1024
MAX_RANGES = 4096
PARTS = 64
OVERFULL = 4
# Drawn keys per range.
DRAWS = 32
# The key space is looked up by the first bits of the hash.
CELL_BITS = 12

_KEY = ("__llm_hash", "__llm_id", "__llm_uid")


def _ranges(stored: DataFrame, size_col: str, rows: int, total: int, seed: int) -> DataFrame:
    """``stored`` with ``__llm_range``: how many of the splitters are at or before the row's key.

    Half of a row's weight in the sample is its share of the size, half its share of the rows, so that neither many
    small rows nor large ones meet in one range.
    """
    ranges = max(1, min(MAX_RANGES, -(-rows // RANGE_ROWS)))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *_KEY), 11) * F.lit(2.0**-53)
    weight = (F.col(size_col) / F.lit(float(max(total, 1))) + F.lit(1.0 / max(rows, 1))) / 2
    drawn = stored.where(chance < weight * (ranges * DRAWS)).select(F.struct(*_KEY).alias("key"))
    # At most MAX_RANGES * DRAWS keys, about, are put in order by one task.
    placed = drawn.withColumn("place", F.row_number().over(Window.orderBy("key")))
    splitters = placed.where(F.col("place") % DRAWS == 0).select(
        "key", F.shiftright(F.col("key")[_KEY[0]], 64 - CELL_BITS).alias("cell")
    )
    listed = splitters.groupBy("cell").agg(F.sort_array(F.collect_list("key")).alias("splitters"))
    half = 1 << (CELL_BITS - 1)
    cells = stored.sparkSession.range(-half, half, 1, 1).withColumnRenamed("id", "__llm_cell")
    known = cells.join(listed, F.col("__llm_cell") == F.col("cell"), "left")
    count = F.when(F.col("splitters").isNull(), 0).otherwise(F.size("splitters"))
    before = Window.orderBy("__llm_cell").rowsBetween(Window.unboundedPreceding, -1)
    known = known.select(
        "__llm_cell", "splitters", F.coalesce(F.sum(count).over(before), F.lit(0)).alias("__llm_before")
    )
    # One row per cell and MAX_RANGES splitters in all.
    found = stored.withColumn("__llm_cell", F.shiftright(_KEY[0], 64 - CELL_BITS).cast("bigint")).join(
        F.broadcast(known), "__llm_cell"
    )
    passed = F.when(F.col("splitters").isNull(), 0).otherwise(
        F.size(F.filter("splitters", lambda s: s <= F.struct(*_KEY)))
    )
    return found.withColumn("__llm_range", F.col("__llm_before") + passed).drop("__llm_cell", "splitters", "__llm_before")


def _range_stats(ranged: DataFrame, size_col: str) -> DataFrame:
    """One row per range: its rows and their size."""
    return materialize(ranged.groupBy("__llm_range").agg(F.count("*").alias("n"), F.sum(size_col).alias("s")), "shard-stats")


def _subdivide(ranged: DataFrame, size_col: str, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """Ranges of which none is overfull, their stats, and how many digits (of ``PARTS``) were put behind their numbers.

    In each round the overfull ranges get splitters from a sample of their own; a row is compared with those of its range
    alone. Rows with equal keys have different places in the table, so that every range can be cut.
    """
    stats, rounds = _range_stats(ranged, size_col), 0
    while True:
        overfull = stats.where(F.col("n") > OVERFULL * RANGE_ROWS)
        count = overfull.count()
        if not count:
            return ranged, stats, rounds
        rounds += 1
        cut = overfull.select(
            F.col("__llm_range").alias("__llm_r"),
            F.col("n").alias("__llm_n"),
            F.col("s").alias("__llm_s"),
            F.least(F.ceil(F.col("n") / RANGE_ROWS), F.lit(PARTS)).alias("__llm_parts"),
        )
        # Beyond MAX_RANGES of them ranges are small already, and meet their rows in a shuffle.
        few = F.broadcast if count <= MAX_RANGES else (lambda rows: rows)
        held = ranged.join(few(cut), ranged["__llm_range"] == cut["__llm_r"])
        weight = (F.col(size_col) / F.greatest(F.col("__llm_s"), F.lit(1)) + 1 / F.col("__llm_n")) / 2
        chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed + rounds), *_KEY), 11) * F.lit(2.0**-53)
        drawn = held.where(chance < weight * F.col("__llm_parts") * DRAWS)
        drawn = drawn.select(F.col("__llm_r").alias("r"), F.col("__llm_parts").alias("parts"), F.struct(*_KEY).alias("key"))
        # About PARTS * DRAWS keys of each range.
        order = Window.partitionBy("r").orderBy("key")
        placed = drawn.withColumn("place", F.row_number().over(order)).withColumn("all", F.count("*").over(Window.partitionBy("r")))
        step = F.greatest(F.floor(F.col("all") / F.col("parts")), F.lit(1))
        chosen = placed.where((F.col("place") % step == 0) & (F.col("place") < step * F.col("parts")))
        splitters = chosen.groupBy(F.col("r").alias("__llm_r")).agg(F.sort_array(F.collect_list("key")).alias("__llm_splitters"))
        splitters = materialize(splitters, "shard-splitters")
        met = ranged.join(few(splitters), ranged["__llm_range"] == splitters["__llm_r"], "left")
        passed = F.when(F.col("__llm_r").isNull(), 0).otherwise(
            F.size(F.filter("__llm_splitters", lambda s: s <= F.struct(*_KEY)))
        )
        number = F.col("__llm_range") * PARTS + passed
        ranged = materialize(met.withColumn("__llm_range", number).drop("__llm_r", "__llm_splitters"), "shard-ranges")
        stats = _range_stats(ranged, size_col)


def shard_by_size(
    rows: DataFrame, hash_col: str, id_col: str, size_col: str, shards: int = SHARDS, seed: int = 23
) -> DataFrame:
    """Add ``shard`` (0 to ``shards`` - 1) and ``slot`` (place in the shard, from 0 without gaps) to every row.

    Rows go by (``hash_col``, ``id_col``), nulls first; ``hash_col`` holds 64-bit hashes, of which null counts as 0. Every
    shard's size is within one row's size of an equal share. Rows equal in both columns are interchangeable. Null and
    negative sizes count as 0. The rows are written and moved: pass narrow ones, and join texts by (shard, slot) where
    needed.
    """
    size = "__llm_size"
    stored = materialize(
        rows.withColumns(
            {
                _KEY[0]: F.coalesce(F.col(hash_col), F.lit(0)).cast("bigint"),
                _KEY[1]: F.col(id_col),
                _KEY[2]: F.monotonically_increasing_id(),
                size: F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)),
            }
        ),
        "shard-rows",
    )
    sums = stored.agg(F.count("*").alias("rows"), F.sum(size).alias("total")).first()
    count, total = sums["rows"], sums["total"] or 0
    ranged = materialize(_ranges(stored, size, count, total, seed), "shard-ranges")
    ranged, stats, rounds = _subdivide(ranged, size, seed)

    # Ranges of the first splitters, MAX_RANGES and one at most, are put in order by one task, those inside each by another.
    first = F.floor(F.col("__llm_range") / PARTS**rounds).cast("bigint").alias("first")
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("first").orderBy("__llm_range").rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda name, window: F.coalesce(F.sum(name).over(window), F.lit(0))
    firsts = stats.groupBy(first).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    firsts = firsts.select("first", summed("n", before).alias("n0"), summed("s", before).alias("s0"))
    offsets = stats.withColumn("first", first).join(F.broadcast(firsts), "first").select(
        "__llm_range",
        (F.col("n0") + summed("n", within)).alias("__llm_rows"),
        (F.col("s0") + summed("s", within)).alias("__llm_sizes"),
    )
    inside = Window.partitionBy("__llm_range").orderBy(*_KEY)
    running = ranged.withColumns(
        {
            "__llm_rank": F.row_number().over(inside).cast("bigint"),
            "__llm_sum": F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).join(broadcast_if_small(materialize(offsets, "shard-offsets")), "__llm_range")
    # A row belongs where its middle lies.
    middle = F.col("__llm_sizes") + F.col("__llm_sum") - F.col(size) / 2
    shard = F.least(F.lit(shards - 1), F.floor(middle * shards / float(max(total, 1)))).cast("int")
    placed = materialize(
        running.select(
            *[c for c in rows.columns if c.lower() not in ("shard", "slot")],
            shard.alias("shard"),
            (F.col("__llm_rows") + F.col("__llm_rank")).alias("__llm_rank"),
        ),
        "shard-places",
    )
    firsts = placed.groupBy("shard").agg(F.min("__llm_rank").alias("__llm_first"))
    # One row per shard.
    out = placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("__llm_rank") - F.col("__llm_first"))
    return out.drop("__llm_rank", "__llm_first")
