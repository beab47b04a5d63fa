"""Ranks and top-k rows that never send a whole group, or the whole table, to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.session import BROADCAST_ROW_LIMIT, broadcast_if_small, materialize

# Up to this k Spark keeps only k rows per group before a shuffle (spark.sql.optimizer.windowGroupLimitThreshold).
GROUP_LIMIT = 1000
# Larger k: a sample with about SAMPLE_BELOW rows among the first k of a group shows where to cut, SAMPLE_RANK rows on.
SAMPLE_BELOW, SAMPLE_RANK = 400, 520
# First-stage pieces per group; the second stage then sees at most SALTS * k rows of any group.
SALTS = 64

_SLOT, _PART, _FIRST, _SIZE, _BEFORE = "__slot", "__part", "__first", "__size", "__before"


def _columns(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(name) if isinstance(name, str) else name for name in names]


def global_rank(
    df: DataFrame,
    order: Sequence[str | Column],
    group: Sequence[str] = (),
    rank_col: str = "rank",
) -> DataFrame:
    """Dense 1-based rank in the total order ``order`` inside each group (inside the table without ``group``).

    The rows are range-partitioned and sorted once on (group, order) and written with their position. Rank = position
    inside the group's run in the partition + rows of the group in earlier partitions. A group of any size is spread
    over as many partitions as it needs. ``order`` must be unique inside a group. Pass narrow rows.
    """
    group = list(group)
    keys = _columns(group) + _columns(order)
    placed = materialize(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(_SLOT, F.monotonically_increasing_id()),
        "ranked",
    ).withColumn(_PART, F.shiftright(_SLOT, 33))

    runs = placed.groupBy(_PART, *group).agg(F.count("*").alias(_SIZE), F.min(_SLOT).alias(_FIRST))
    earlier = Window.partitionBy(*group).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        _PART, *group, _FIRST, F.coalesce(F.sum(_SIZE).over(earlier), F.lit(0)).alias(_BEFORE)
    )
    # One row per partition and group met there: partitions + groups rows at most.
    runs = broadcast_if_small(runs, BROADCAST_ROW_LIMIT)
    side = runs.select(
        F.col(_PART).alias("__p"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], _FIRST, _BEFORE
    )
    match = placed[_PART] == side["__p"]
    for i, name in enumerate(group):
        match = match & placed[name].eqNullSafe(side[f"__g{i}"])
    ranked = placed.join(side, match, "inner")
    return ranked.select(
        *[placed[c] for c in df.columns],
        (F.col(_SLOT) - F.col(_FIRST) + F.col(_BEFORE) + 1).alias(rank_col),
    )


def _cut(df: DataFrame, order: Sequence[str | Column], group: Sequence[str], k: int) -> DataFrame:
    """The rows of ``df`` that can be among the first ``k`` of their group, and some more.

    Groups with too few sampled rows are kept whole. Should a cut leave fewer than ``k`` rows of a group, all rows are
    kept; so are they for descending orders.
    """
    keys = _columns(order)
    if any(" DESC" in str(key) or " ASC" in str(key) for key in keys):
        return df
    key = F.struct(*[column.alias(f"k{i}") for i, column in enumerate(keys)])
    share = int(SAMPLE_BELOW / k * (1 << 30))
    drawn = df.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < share)
    names = [f"__g{i}" for i in range(len(group))]
    drawn = drawn.select(*[F.col(g).alias(n) for g, n in zip(group, names)], key.alias("__cut"))
    last = smallest_per_group(drawn, ["__cut"], names, SAMPLE_RANK, "__rank").where(F.col("__rank") == SAMPLE_RANK)
    # One row per group that is cut.
    cuts = broadcast_if_small(materialize(last.select(*names, "__cut"), "cuts"))
    same = F.lit(True)
    for g, n in zip(group, names):
        same = same & df[g].eqNullSafe(cuts[n])
    near = materialize(df.join(cuts, same, "left").where(F.col("__cut").isNull() | (key <= F.col("__cut"))), "near")
    short = near.where(F.col("__cut").isNotNull()).groupBy(*names).count().where(F.col("count") < k)
    return near.select(*df.columns) if short.isEmpty() else df


def smallest_per_group(
    df: DataFrame, order: Sequence[str | Column], group: Sequence[str], k: int, rank_col: str = "rank"
) -> DataFrame:
    """The first ``k`` rows of each group with their 1-based rank; ``order`` must be unique inside a group.

    Small k: each task keeps k rows per group, pieces of a group are reduced in parallel, then merged. Large k: a cut
    taken from a sample leaves little more than k rows of each group, and these are ranked.
    """
    if k > GROUP_LIMIT:
        return global_rank(_cut(df, order, group, k), order, group, rank_col).where(F.col(rank_col) <= k)
    keys = _columns(order)
    salted = df.withColumn("__salt", F.spark_partition_id() % SALTS)
    first = Window.partitionBy(*group, "__salt").orderBy(*keys)
    final = Window.partitionBy(*group).orderBy(*keys)
    return (
        salted.withColumn(rank_col, F.row_number().over(first))
        .where(F.col(rank_col) <= k)
        .drop("__salt")
        .withColumn(rank_col, F.row_number().over(final).cast("bigint"))
        .where(F.col(rank_col) <= k)
    )


def smallest(df: DataFrame, order: Sequence[str | Column], k: int, rank_col: str = "rank") -> DataFrame:
    """The first ``k`` rows of the table with their 1-based rank."""
    whole = df.withColumn("__all", F.lit(0))
    return smallest_per_group(whole, order, ["__all"], k, rank_col).drop("__all")
