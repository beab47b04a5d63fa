"""Deterministic samples: the same rows, seed and parameters give the same result on any cluster."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe import defaults
from tallyframe.operators.ranking import GROUP_LIMIT, global_rank, smallest, smallest_per_group
from tallyframe.session import BROADCAST_ROW_LIMIT, broadcast_if_small, materialize, small_table


def class_order(column: str, classes: Sequence[str]) -> Column:
    """Position of a class in the ordered class list; null for other values."""
    return F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(column)) - 1


def hash_order(key: str | Column, seed: int) -> Column:
    """Seeded pseudo-random sort key; equal in every engine that has MD5."""
    column = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), column.cast("string")).cast("binary"))


def uniform(key: Column, seed: str) -> Column:
    """Uniform number in [0, 1) from a key and a seed: the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def reindex(df: DataFrame, order: Sequence[str | Column], index_col: str = "index") -> DataFrame:
    """Dense 0-based index in a total order, for tables of any size."""
    ranked = global_rank(df.drop(index_col) if index_col in df.columns else df, order, (), "__rank")
    return ranked.withColumn(index_col, F.col("__rank") - 1).drop("__rank")


def batches(df: DataFrame, batch_size: int, index_col: str = "index") -> DataFrame:
    """Number of the consecutive batch each indexed row falls into; the last batch may be short."""
    if batch_size <= 0:
        raise ValueError("The batch size must be positive.")
    return df.withColumn("batch", F.floor(F.col(index_col) / batch_size).cast("bigint"))


def first_rows(df: DataFrame, limit: int | None, order: Sequence[str | Column]) -> DataFrame:
    """The first ``limit`` rows in an explicit order; all rows when there is no limit."""
    return df if limit is None else smallest(df, order, limit, "__rank").drop("__rank")


def round_robin(df: DataFrame, class_col: str, order: Sequence[str | Column], limit: int) -> DataFrame:
    """Take turns over the classes in alphabetical order, inside a class by ``order``; exhausted classes are skipped.

    The result carries its 0-based ``position``.
    """
    picked = smallest_per_group(df, order, [class_col], limit, "__turn")
    return _positions(picked, [F.col("__turn"), F.col(class_col)], limit).drop("__turn")


def _positions(picked: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """Number the first ``limit`` of at most classes * limit rows."""
    if limit > GROUP_LIMIT:
        ranked = smallest(picked, order, limit, "__rank")
    else:
        # Planned as a top-k: every task keeps its first rows, one merges them.
        rank = F.row_number().over(Window.orderBy(*order)).cast("bigint")
        ranked = picked.withColumn("__rank", rank).where(F.col("__rank") <= limit)
    return ranked.withColumn("position", F.col("__rank") - 1).drop("__rank")


def seeded_sample(df: DataFrame, key: str, count: int, seed: int = 42, split: tuple[str, str] | None = None) -> DataFrame:
    """Exactly ``count`` rows without replacement, or all rows when there are fewer; optionally of one split.

    The sample is the ``count`` smallest hashes. Hashes are uniform, so a threshold on the hash keeps little more than
    ``count`` rows before anything is shuffled; should it keep too few, all rows are ranked.
    """
    rows = df if split is None else df.where(F.col(split[0]) == split[1])
    total = rows.count()
    if total <= count:
        return rows
    order = [hash_order(key, seed), F.col(key)]
    share = (count + 8 * count**0.5 + 64) / total
    if share < 0.5:
        threshold = f"{int(share * (1 << 52)):013x}"
        near = materialize(rows.where(order[0] < threshold), "sample")
        if near.count() >= count:
            rows = near
    return smallest(rows, order, count, "__rank").drop("__rank")


def quota_table(spark, quotas: Mapping[str, Mapping[str, int]], class_col: str = "category") -> DataFrame:
    """Rank interval of every split and class: splits follow each other in the order given."""
    rows = []
    taken: dict[str, int] = {}
    for split, per_class in quotas.items():
        for order, (category, count) in enumerate(per_class.items()):
            start = taken.get(category, 0)
            rows.append((split, category, order, start, start + count))
            taken[category] = start + count
    return small_table(
        spark, rows, f"split string, {class_col} string, class_order bigint, start bigint, stop bigint"
    )


def quota_split(
    df: DataFrame,
    class_col: str,
    order: Sequence[str | Column],
    quotas: Mapping[str, Mapping[str, int]] = defaults.SPLIT_QUOTAS,
) -> DataFrame:
    """Assign splits by rank inside each class: the first quota to the first split, the next one to the next split."""
    spark = df.sparkSession
    table = quota_table(spark, quotas, class_col)
    needed = max(sum(per_class.get(c, 0) for per_class in quotas.values()) for c in _quota_classes(quotas))
    wanted = df.where(F.col(class_col).isin(*_quota_classes(quotas)))
    ranked = smallest_per_group(wanted, order, [class_col], needed, "class_rank")
    placed = ranked.join(F.broadcast(table), class_col).where(
        (F.col("class_rank") > F.col("start")) & (F.col("class_rank") <= F.col("stop"))
    )
    return placed.drop("start", "stop")


def _quota_classes(quotas: Mapping[str, Mapping[str, int]]) -> list[str]:
    return list(dict.fromkeys(c for per_class in quotas.values() for c in per_class))


def quota_shortfall(
    df: DataFrame, class_col: str, quotas: Mapping[str, Mapping[str, int]] = defaults.SPLIT_QUOTAS
) -> DataFrame:
    """Splits and classes for which the rows do not suffice, with the number wanted and available."""
    counts = df.groupBy(class_col).agg(F.count("*").alias("n"))
    counts = counts.where(F.col(class_col).isin(*_quota_classes(quotas)))
    joined = quota_table(df.sparkSession, quotas, class_col).join(counts, class_col, "left")
    available = F.greatest(F.least(F.coalesce("n", F.lit(0)), F.col("stop")) - F.col("start"), F.lit(0))
    return joined.select(
        "split", class_col, (F.col("stop") - F.col("start")).alias("expected"), available.alias("available")
    ).where(F.col("available") < F.col("expected"))


def require_none(problems: DataFrame, what: str) -> None:
    """Raise when a table of problems is not empty; the message lists the first ones."""
    rows = problems.limit(21).collect()
    if rows:
        listed = "; ".join(", ".join(f"{k}={v}" for k, v in row.asDict().items()) for row in rows[:20])
        raise ValueError(f"{what}: {listed}{' ...' if len(rows) > 20 else ''}")


def class_shortfall(df: DataFrame, class_col: str, classes: Sequence[str], wanted: int) -> DataFrame:
    """Classes with fewer than ``wanted`` rows, with the number missing."""
    counts = df.where(F.col(class_col).isin(*classes)).groupBy(class_col).agg(F.count("*").alias("n"))
    table = small_table(df.sparkSession, [(c, i) for i, c in enumerate(classes)], f"{class_col} string, __order bigint")
    missing = F.lit(wanted) - F.coalesce("n", F.lit(0))
    return table.join(counts, class_col, "left").select(class_col, missing.alias("missing")).where("missing > 0")


def stratified_limit(
    df: DataFrame,
    class_col: str,
    order: Sequence[str | Column],
    per_class: int,
    classes: Sequence[str] = defaults.CLASS_LABELS,
    strict: bool = False,
) -> DataFrame:
    """The first ``per_class`` rows of every listed class, class by class, with a dense new ``index``.

    ``strict`` raises when a class is short; otherwise see ``class_shortfall``.
    """
    if per_class <= 0:
        raise ValueError("The limit per class must be positive.")
    if strict:
        require_none(class_shortfall(df, class_col, classes, per_class), "Not enough rows")
    rows = df.where(F.col(class_col).isin(*classes))
    picked = smallest_per_group(rows, order, [class_col], per_class, "__turn")
    picked = picked.withColumn("__class", class_order(class_col, classes))
    if strict:
        index = F.col("__class") * per_class + F.col("__turn") - 1
        return picked.withColumn("index", index).drop("__class", "__turn")
    sizes = picked.groupBy("__class").agg(F.count("*").alias("n"))
    # At most one row per listed class.
    starts = F.map_from_entries(
        F.transform(
            F.sequence(F.lit(0), F.lit(len(classes) - 1)),
            lambda c: F.struct(
                c.cast("bigint").alias("key"),
                F.aggregate(
                    F.filter(F.col("sizes"), lambda s: s["__class"] < c),
                    F.lit(0).cast("bigint"),
                    lambda total, s: total + s["n"],
                ).alias("value"),
            ),
        )
    )
    offsets = sizes.agg(F.collect_list(F.struct("__class", "n")).alias("sizes")).select(starts.alias("starts"))
    index = F.element_at(offsets.scalar(), F.col("__class")) + F.col("__turn") - 1
    return picked.withColumn("index", index).drop("__class", "__turn")


def calibration_sample(
    df: DataFrame,
    class_col: str,
    order: Sequence[str | Column],
    total: int = defaults.CALIBRATION_SIZE,
    classes: Sequence[str] = defaults.CLASS_LABELS,
    strict: bool = False,
) -> DataFrame:
    """Take turns over the listed classes; when they are exhausted, fill up with the other rows in their order.

    The rows that fill up form one more group behind the listed classes, so one sort key expresses both steps.
    ``strict`` raises when a listed class has no rows.
    """
    if total <= 0:
        raise ValueError("The sample size must be positive.")
    if strict:
        require_none(class_shortfall(df, class_col, classes, 1), "Missing classes")
    listed = class_order(class_col, classes)
    known = F.coalesce(F.col(class_col).isin(*classes), F.lit(False))
    rows = df.withColumn("__class", F.when(known, listed).otherwise(len(classes)))
    picked = smallest_per_group(rows, order, ["__class"], total, "__turn")
    sort = [F.col("__class") == len(classes), F.col("__turn"), F.col("__class")]
    return _positions(picked, sort, total).drop("__class", "__turn")


def pick_per_class(
    df: DataFrame, class_col: str, path_col: str, split_col: str | None = None, split: str | None = None
) -> DataFrame:
    """Row with the smallest path per class, from ``split`` when the class has rows there, else from anywhere."""
    outside = F.lit(False) if split is None else ~F.col(split_col).eqNullSafe(F.lit(split))
    others = [c for c in df.columns if c != class_col]
    best = F.min_by(F.struct(*others), F.struct(outside.alias("outside"), F.col(path_col).alias("path")))
    return df.groupBy(class_col).agg(best.alias("__best")).select(class_col, "__best.*")


def first_index_per_label(df: DataFrame, label_col: str, index_col: str, wanted: Sequence[str]) -> DataFrame:
    """First index of every wanted label; null for a label that does not occur."""
    firsts = df.where(F.col(label_col).isin(*wanted)).groupBy(label_col).agg(F.min(index_col).alias("first_index"))
    table = small_table(df.sparkSession, [(w,) for w in wanted], f"{label_col} string")
    return table.join(firsts, label_col, "left")


def first_row(df: DataFrame, value_col: str, order_col: str) -> DataFrame:
    """``value_col`` of the first row in the order of ``order_col``; no rows when the input has none."""
    return df.agg(F.min_by(value_col, order_col).alias(value_col)).where(F.col(value_col).isNotNull())


def calibration_counts(df: DataFrame, class_col: str) -> DataFrame:
    return df.groupBy(class_col).agg(F.count("*").alias("n")).orderBy(class_col)


# ---- class weights and weighted draws -------------------------------------------------------------------------------


def require_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """The label column as text; an error when the table has none."""
    if label_col not in df.columns:
        raise ValueError(f"Balanced sampling needs the column {label_col}.")
    return df.withColumn(label_col, F.col(label_col).cast("string"))


def weight_exponent(explicit: float | None, strategy: str = "balanced") -> float:
    return explicit if explicit is not None else defaults.SAMPLER_EXPONENTS.get(strategy, 1.0)


def class_weights(
    df: DataFrame,
    label_col: str = "label",
    boost_class: str | None = None,
    boost: float = 1.0,
    exponent: float = 1.0,
) -> DataFrame:
    """Rows and weight of one row per class: ``(1 / rows) ** exponent``, times ``boost`` for one class."""
    if boost <= 0 or exponent <= 0:
        raise ValueError("Boost and exponent must be positive.")
    counts = df.groupBy(label_col).agg(F.count("*").alias("n"))
    factor = F.when(F.col(label_col) == boost_class, F.lit(float(boost))).otherwise(1.0) if boost_class else F.lit(1.0)
    return counts.withColumn("weight", F.pow(F.lit(1.0) / F.col("n"), F.lit(float(exponent))) * factor)


def attach_weights(df: DataFrame, weights: DataFrame, label_col: str = "label") -> DataFrame:
    """Every row with the weight of its class; a null label is a class. Classes are counted before they are broadcast."""
    side = weights.select(F.col(label_col).alias("__class"), "weight")
    return df.join(broadcast_if_small(side), df[label_col].eqNullSafe(side["__class"])).drop("__class")


def weighted_draws(
    df: DataFrame,
    label_col: str,
    order: Sequence[str | Column],
    seed: int = 42,
    draws: int | None = None,
    boost_class: str | None = None,
    boost: float = 1.0,
    exponent: float = 1.0,
    rows_per_salt: int = 1000,
) -> DataFrame:
    """Draws with replacement, as many as there are rows unless said otherwise, weighted per class.

    Weights are constant inside a class, so a draw picks the class by its cumulative mass and then a uniform rank in
    the class. A rank of a small, heavy class is drawn very often: such ranks are repeated under salt numbers and the
    draws spread over them, so that no join key gets more than about ``rows_per_salt`` draws. The repeats add at most
    draws / rows_per_salt rows in total. Class, rank and salt are one dense number, which sorts and hashes faster than
    three. The result has one row per draw with its number in ``draw``. Classes may be many: they stay a table of one
    row each, which one task puts in order. A null label is a class.
    """
    total = draws if draws is not None else df.count()
    if total <= 0:
        raise ValueError("Balanced sampling needs at least one row.")
    classes = class_weights(df, label_col, boost_class, boost, exponent)
    table = materialize(_draw_table(classes, label_col, total, rows_per_salt), "class-bounds")
    count = table.count()
    few = F.broadcast if count <= BROADCAST_ROW_LIMIT else (lambda rows: rows)

    # Draws find their class by cells of the unit interval; a class lies in as many cells as its mass covers.
    cells = max(1024, min(count, 1 << 20))
    covered = table.select(
        F.explode(F.sequence(F.floor(F.col("__lower") * cells), F.least(F.lit(cells - 1), F.floor(F.col("__upper") * cells)))).alias("__cell"),
        "__lower", "__upper", "__size", "__salts", "__start", "__last",
    )
    # The hash is bound to a column of its own, so that it is computed once.
    placed = (
        df.sparkSession.range(total)
        .withColumnRenamed("id", "draw")
        .withColumn("__u", uniform(F.col("draw"), f"{seed}:class"))
        .withColumn("__cell", F.floor(F.col("__u") * cells))
    )
    found = placed.join(few(covered), "__cell").where(
        (F.col("__u") >= F.col("__lower")) & (F.col("__last") | (F.col("__u") < F.col("__upper")))
    )
    place = F.floor(uniform(F.col("draw"), f"{seed}:row") * F.col("__size")).cast("bigint")
    number = F.col("__start") + place * F.col("__salts") + F.pmod(F.col("draw"), F.col("__salts"))
    drawn = found.select("draw", number.alias("__number"))

    known = few(table.select(F.col(label_col).alias("__class"), "__salts", "__start"))
    ranked = global_rank(df, order, [label_col], "__rank")
    ranked = ranked.join(known, ranked[label_col].eqNullSafe(known["__class"]))
    first = F.col("__start") + (F.col("__rank") - 1) * F.col("__salts")
    # Two steps, so that a row with many repeats needs no long array.
    runs = ranked.select(
        *df.columns, first.alias("__first"), "__salts", F.explode(F.sequence(F.lit(0), F.floor((F.col("__salts") - 1) / _RUN))).alias("__run")
    )
    begin = F.col("__first") + F.col("__run") * _RUN
    end = F.least(begin + _RUN, F.col("__first") + F.col("__salts")) - 1
    spread = runs.select(*df.columns, F.explode(F.sequence(begin, end)).alias("__number"))
    return drawn.join(spread, "__number").select("draw", *df.columns)


# Repeats of a row that are made at once.
_RUN = 4096
# Weights that are no whole numbers are rounded to this part of the largest one, or a coarser part where the masses of all
# rows together would pass FINEST_MASS.
FINEST_WEIGHT, FINEST_MASS = 1 << 31, 1 << 62


def _masses(df: DataFrame, weight: Column) -> DataFrame:
    """Rows with a positive weight as ``row`` and ``mass``, a whole number, so that sums are exact in any order."""
    kind = df.select(weight.alias("w")).schema["w"].dataType
    weighed = df.select(F.struct("*").alias("row"), weight.alias("w")).where("w IS NOT NULL")
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        facts = weighed.agg(F.min("w")).first()
        mass = F.col("w").cast("bigint")
    else:
        weighed = weighed.withColumn("w", F.col("w").cast("double"))
        facts = weighed.agg(F.min("w"), F.max("w"), F.count("*")).first()
        if facts[2] and not math.isfinite(facts[1]):
            raise ValueError("Weights must be finite.")
        parts = min(FINEST_WEIGHT, FINEST_MASS // max(facts[2], 1))
        mass = F.round(F.col("w") / F.lit(facts[1] or 1.0) * F.lit(float(parts))).cast("bigint")
    if facts[0] is not None and facts[0] < 0:
        raise ValueError("Weights must not be negative.")
    return weighed.select("row", mass.alias("mass")).where("mass > 0")


def weighted_row_draws(
    df: DataFrame, weight: Column, order: Sequence[str], seed: int = 42, draws: int | None = None
) -> DataFrame:
    """Draws with replacement, as many as there are rows unless said otherwise, by a weight of each row.

    Rows lie one after the other, in the order of ``order`` (unique), on a line, each as long as its weight; a draw is a
    point on the line and takes the row that it hits. Rows with a null or zero weight are never drawn. Starts of rows and
    points are range-partitioned together, so that neither a heavy row with most of the draws nor a crowd of light rows
    fills one task, and every point takes the last start before it, if need be from an earlier partition. The result has
    one row per draw with its number in ``draw``.
    """
    total_draws = draws if draws is not None else df.count()
    weighed = _masses(df, weight)
    keys = [F.col(f"row.{name}") for name in order]
    slot, part = F.monotonically_increasing_id(), F.shiftright("__slot", 33)
    sorted_rows = weighed.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__slot", slot)
    placed = materialize(sorted_rows, "weighted-rows").withColumn("__part", part)
    # One row per partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(placed.groupBy("__part").agg(F.sum("mass").alias("sum")), "weighted-parts")
    total = sums.agg(F.sum("sum")).first()[0]
    if total_draws <= 0 or not total:
        raise ValueError("Balanced sampling needs at least one row.")
    offsets = sums.select("__part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("__part").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.join(broadcast_if_small(offsets), "__part").select(
        (F.col("offset") + F.coalesce(F.sum("mass").over(inside), F.lit(0))).alias("at"), F.lit(None).cast("bigint").alias("draw"), "row"
    )
    point = F.floor(uniform(F.col("id"), f"{seed}:row") * F.lit(float(total))).cast("bigint")
    # Rounding must not carry a point past the end.
    points = df.sparkSession.range(total_draws).select(
        F.least(point, F.lit(total - 1)).alias("at"), F.col("id").alias("draw"), F.lit(None).cast(starts.schema["row"].dataType).alias("row")
    )
    # A start comes before the points at the same place, since its draw is null.
    both = starts.unionByName(points).repartitionByRange("at", "draw").sortWithinPartitions("at", "draw").withColumn("__slot", slot)
    both = materialize(both, "weighted-line").withColumn("__part", part)
    last = both.where("row IS NOT NULL").groupBy("__part").agg(F.max_by("row", "__slot").alias("last"))
    # A partition of points alone takes the last row of the nearest partition before it that has one.
    carried = both.select("__part").distinct().join(last, "__part", "left").select(
        "__part", F.last("last", ignorenulls=True).over(before).alias("carried")
    )
    so_far = Window.partitionBy("__part").orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)
    hit = both.join(broadcast_if_small(carried), "__part").withColumn(
        "hit", F.coalesce(F.last("row", ignorenulls=True).over(so_far), F.col("carried"))
    )
    return hit.where("draw IS NOT NULL").select("draw", "hit.*")


def _draw_table(classes: DataFrame, label_col: str, total: int, rows_per_salt: int) -> DataFrame:
    """Interval, size, repeats and first number of each class, in the order of the labels; one row per class."""
    order = Window.orderBy(label_col)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    mass = F.col("n") * F.col("weight")
    summed = classes.select(
        label_col,
        F.col("n").alias("__size"),
        F.col("weight").alias("__weight"),
        F.sum(mass).over(so_far).alias("__reached"),
        F.sum(mass).over(whole).alias("__mass"),
        F.lead("n").over(order).isNull().alias("__last"),
    )
    per_row = F.lit(total) * F.col("__size") * F.col("__weight") / F.col("__mass") / F.col("__size")
    salted = summed.withColumn("__salts", F.floor(per_row / rows_per_salt) + 1)
    upper = F.col("__reached") / F.col("__mass")
    return salted.select(
        label_col,
        "__size",
        "__salts",
        "__last",
        F.coalesce(F.lag(upper).over(order), F.lit(0.0)).alias("__lower"),
        upper.alias("__upper"),
        F.coalesce(F.sum(F.col("__size") * F.col("__salts")).over(before), F.lit(0)).alias("__start"),
    )
