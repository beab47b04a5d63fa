"""Mixing sources to target weights by pivotal rounding in a distributed reduction tree (operator 4).

Every document of a source has the same expected number of copies, target over source size. Its whole part is taken as
it is; the fractions are rounded by pairs: mass moves at random from one document to the other until one of them is 0 or
1, and the other carries the rest on. Blocks of documents of like size do so in parallel and each hands one carrier up;
carriers meet in blocks again, then across the sizes of a source. The number of copies so comes out within one of its
expectation, and words near theirs, since mass moves between documents of like size. Everything is built from DataFrame
functions; chance comes from hashes, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.quality import _bind
from tallyframe.operators.ranking import global_rank
from tallyframe.session import broadcast_if_small, materialize

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
# Documents, or carriers, of one block.
BLOCK_ROWS = 128
# Size classes per doubling of the size.
CLASSES = 4
# The last carriers of a source, at most 64 * CLASSES, are rounded under so many seeds; the one whose words come nearest
# to the target stays.
TRIALS = 64

_UNIT = "struct<size bigint, key bigint, uid bigint, p double>"
_DONE = "array<struct<__llm_unit: bigint, extra: int, words: bigint>>"


def source_targets(
    sized: DataFrame, source_col: str, size_col: str, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_COPIES
) -> DataFrame:
    """One row per source: ``source``, ``source_size`` and ``target``.

    Sources by code point, null last, weigh ``weights`` in turn and share the sum of all sizes; a target stops at
    ``most`` times its source's size and the excess goes to the others by weight until none is above. That is
    min(most * size, level * weight) for one level. Sorts one row per source, which must fit one task.
    """
    sums = sized.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights))
    cap = most * F.col("source_size").cast("double")
    weighed = sums.withColumn("weight", weight).withColumn("full", cap / F.col("weight"))
    order = Window.orderBy("full", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = weighed.withColumn(
        "level",
        (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0.0)))
        / F.sum("weight").over(after),
    )
    # The first source, by cap per weight, that the level does not fill; those before it are full.
    first = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "level"))).over(everything)["level"]
    return leveled.withColumn("first", first).select(
        "source", "source_size", F.least(cap, F.col("first") * F.col("weight")).alias("target")
    )


def _chance(seed: Column, *keys: Column) -> Column:
    """A number in [0, 1) from the hash of ``keys``."""
    return F.shiftrightunsigned(F.xxhash64(seed, *keys), 11) * F.lit(2.0**-53)


def _settled(unit: Column, extra: Column) -> Column:
    return F.array(
        F.struct(
            unit["uid"].alias("__llm_unit"), extra.cast("int").alias("extra"), (extra * unit["size"]).alias("words")
        )
    ).cast(_DONE)


def _round_block(units: Column, seed: Column) -> Column:
    """Pair the units of an array in order: a struct of the last carrier and of the units that came out as 0 or 1."""

    def step(state: Column, unit: Column) -> Column:
        carrier = state["carrier"]
        total = carrier["p"] + unit["p"]
        below = total < 1
        # Below one the winner gets all mass, else one unit is filled and the other keeps the rest.
        share = F.when(below, unit["p"] / F.nullif(total, F.lit(0.0))).otherwise((1 - unit["p"]) / (2 - total))
        unit_goes_on = _chance(seed, carrier["key"], unit["key"]) < share
        kept = F.when(unit_goes_on, F.struct(unit["size"], unit["key"], unit["uid"])).otherwise(
            F.struct(carrier["size"], carrier["key"], carrier["uid"])
        )
        gone = F.when(unit_goes_on, carrier).otherwise(unit)
        return F.struct(
            F.struct(
                kept["size"].alias("size"),
                kept["key"].alias("key"),
                kept["uid"].alias("uid"),
                F.when(below, total).otherwise(total - 1).alias("p"),
            ).cast(_UNIT).alias("carrier"),
            F.concat(state["done"], _settled(gone, F.when(below, 0).otherwise(1))).cast(_DONE).alias("done"),
        )

    start = F.struct(units[0].cast(_UNIT).alias("carrier"), F.array().cast(_DONE).alias("done"))
    return F.aggregate(F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0))), start, step)


def mix(
    docs: DataFrame,
    size_col: str = "size",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MAX_COPIES,
    seed: int = 17,
) -> DataFrame:
    """Add ``source_size``, ``target`` (see ``source_targets``), ``copies`` and ``taken`` (copies x size) to every row.

    Null and negative sizes count as 0. ``copies`` is 0 to ``most``; over a source the copies sum up to their
    expectation within one, and the taken sizes come near the target. Chance depends on ``seed`` and on the rows'
    content only; equal rows are interchangeable. A source whose sizes are all 0 has target 0 and no copies. A null
    source is a source. Pass the columns that are needed afterwards: the rows are written once, narrow rows move.
    """
    stored = materialize(
        docs.withColumns(
            {
                "__llm_uid": F.monotonically_increasing_id(),
                "__llm_key": F.xxhash64(F.lit(seed), *[F.col(c) for c in docs.columns]),
                "__llm_size": F.greatest(F.coalesce(F.col(size_col), F.lit(0)), F.lit(0)).cast("bigint"),
            }
        ),
        "mix",
    )
    targets = materialize(source_targets(stored, source_col, "__llm_size", weights, most), "mix-targets")
    targets = targets.select(
        F.col("source").alias("__llm_source"),
        "source_size",
        "target",
        F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)).alias("__llm_x"),
    )
    known = stored.drop("source_size", "target", "copies", "taken")
    aimed = known.join(targets, known[source_col].eqNullSafe(targets["__llm_source"]))
    extra = F.col("__llm_x") - F.floor("__llm_x")
    units = aimed.where(extra > 0).select(
        F.col("__llm_source").alias("source"),
        F.floor(F.log2(F.col("__llm_size") + 1.0) * CLASSES).cast("int").alias("class"),
        F.struct(
            F.col("__llm_size").alias("size"),
            F.col("__llm_key").alias("key"),
            F.col("__llm_uid").alias("uid"),
            extra.alias("p"),
        ).alias("unit"),
    )
    goals = targets.select(
        F.col("__llm_source").alias("__s"), (F.col("target") - F.floor("__llm_x") * F.col("source_size")).alias("goal")
    )
    decided = _round_all(units, goals, seed)
    copies = (F.floor("__llm_x") + F.coalesce("__llm_extra", F.lit(0))).cast("int")
    whole = aimed.join(decided, aimed["__llm_uid"] == decided["__llm_unit"], "left").withColumn("copies", copies)
    return whole.withColumn("taken", F.col("copies").cast("bigint") * F.col("__llm_size")).select(
        *[c for c in docs.columns if c.lower() not in ("source_size", "target", "copies", "taken")],
        "source_size",
        "target",
        "copies",
        "taken",
    )


def _with_turns(units: DataFrame) -> DataFrame:
    """``units`` with ``turn``: 0, but where more equal rows than fill a block share a key, their place in blocks of it.

    Such rows are interchangeable, so that any order of them gives the same mix.
    """
    keyed = units.withColumn("key", F.col("unit.key"))
    crowded = materialize(keyed.groupBy("key").count().where(F.col("count") > BLOCK_ROWS).select("key"), "mix-crowds")
    if crowded.isEmpty():
        return units.withColumn("turn", F.lit(0).cast("bigint"))
    crowded = broadcast_if_small(crowded)
    crowds = keyed.join(crowded, "key", "left_semi").select(*units.columns, "key")
    ranked = global_rank(crowds, [F.col("unit.uid")], ["key"])
    turns = ranked.select(*units.columns, F.floor((F.col("rank") - 1) / BLOCK_ROWS).cast("bigint").alias("turn"))
    alone = keyed.join(crowded, "key", "left_anti").select(*units.columns, F.lit(0).cast("bigint").alias("turn"))
    return alone.unionByName(turns)


def _round_all(units: DataFrame, goals: DataFrame, seed: int) -> DataFrame:
    """``__llm_unit`` and ``__llm_extra`` (0 or 1) of every unit, from the tree over source, class and block.

    ``goals`` has the words (``goal``) that each source (``__s``) should take from its units.
    """
    counts = units.groupBy("source", "class").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    counts = materialize(counts, "mix-blocks")
    most = counts.agg(F.max("blocks")).first()[0] or 1
    sizes = counts.withColumnsRenamed({"source": "__s", "class": "__c"})
    turned = _with_turns(units)
    spread = F.when(F.col("turn") == 0, F.xxhash64(F.lit(seed + 1), "unit.key")).otherwise(
        F.xxhash64(F.lit(seed + 1), "unit.key", "turn")
    )
    level = turned.join(sizes, turned["source"].eqNullSafe(sizes["__s"]) & (turned["class"] == sizes["__c"])).select(
        "source", "class", F.pmod(spread, "blocks").alias("block"), "unit"
    )
    over = ["source", "class", "block"]
    done: DataFrame | None = None
    for number in range(2, 100):
        gathered = level.groupBy(*over).agg(F.sort_array(F.collect_list("unit")).alias("units"))
        rounded = materialize(gathered.select(*over, _round_block(F.col("units"), F.lit(seed + number)).alias("r")), "mix-level")
        settled = rounded.select("source", F.inline("r.done"))
        done = settled if done is None else done.unionByName(settled)
        if most == 1:
            break
        level = rounded.select("source", "class", F.floor(F.col("block") / BLOCK_ROWS).alias("block"), F.col("r.carrier").alias("unit"))
        most = -(-most // BLOCK_ROWS)

    # One carrier per class is left. Those of a source meet in one row.
    below = done.groupBy("source").agg(F.sum("words").alias("below")).withColumnRenamed("source", "__b")
    last = rounded.groupBy("source").agg(F.sort_array(F.collect_list("r.carrier")).alias("units"))
    last = last.join(goals, last["source"].eqNullSafe(goals["__s"]))
    last = last.join(below, last["source"].eqNullSafe(below["__b"]), "left")
    open_words = F.col("goal") - F.coalesce("below", F.lit(0))

    def trial(number: Column) -> Column:
        def end(result: Column) -> Column:
            carrier = result["carrier"]
            filled = (_chance(number - 1, carrier["key"]) < carrier["p"]).cast("int")
            settled = F.concat(result["done"], _settled(carrier, filled))
            return _bind(
                settled,
                lambda units: F.struct(
                    F.abs(open_words - F.aggregate(units, F.lit(0).cast("bigint"), lambda n, u: n + u["words"])).alias("miss"),
                    number.alias("number"),
                    units.alias("done"),
                ),
            )

        return _bind(_round_block(F.col("units"), number), end)

    trials = F.transform(F.sequence(F.lit(1), F.lit(TRIALS)), lambda n: trial(n.cast("int") * 1000 + seed))
    ended = last.select("source", F.inline(F.array_min(trials)["done"]))
    return done.unionByName(ended).select("__llm_unit", F.col("extra").alias("__llm_extra"))


def repeat_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """Each row of ``mix`` as often as it was taken, with ``columns``."""
    taken = mixed.where(F.col("copies") > 0).select(*columns, F.explode(F.sequence(F.lit(1), "copies")).alias("__llm_copy"))
    return taken.select(*columns)
