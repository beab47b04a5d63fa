"""A Merkle manifest of a table: a leaf per row, a tree per group, a tree over the groups, and a proof per leaf (operator 11).

Leaves of a group are ranked and cut into aligned blocks of FANOUT ** BLOCK_LEVELS. A block hashes its own part of the tree;
the rest is a butterfly: in round r every block asks one block of each sibling subtree of FANOUT ** r blocks for that
subtree's root and hashes the parent itself. All blocks of a subtree so know its root and their siblings on the way, and no
pass leads downward again. A round is a join and a grouping of one row per block, whatever the size of a group.
Everything is built from DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.ranking import global_rank
from tallyframe.session import broadcast_if_small, materialize

FANOUT = 8
BLOCK_LEVELS = 3
# FANOUT ** 20 is the largest power in a long.
MOST_LEVELS = 20

STEPS = "array<struct<before:string,after:string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the joined parts."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_digest(*values: Column) -> Column:
    """The digest of a row: each value as ``-`` if null, else as its number of UTF-8 bytes, a colon and the value."""

    def part(value: Column) -> Column:
        text = value.cast("string")
        return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return digest(*[part(value) for value in values])


def levels(nodes: Column) -> Column:
    """How often FANOUT nodes become one until a single node remains."""
    return sum(((nodes > FANOUT**power).cast("int") for power in range(MOST_LEVELS + 1)), F.lit(0))


def _parents(hashes: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.size(hashes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda run: digest(F.array_join(F.slice(hashes, run * FANOUT + 1, FANOUT), "")))


def _step(hashes: Column, node: Column) -> Column:
    """The hashes beside ``node`` (0-based) in its run, joined: those before it and those behind it."""
    first = (node - node % FANOUT).cast("int")
    at = (node % FANOUT).cast("int")
    return F.struct(
        F.array_join(F.slice(hashes, first + 1, at), "").alias("before"),
        F.array_join(F.slice(hashes, first + at + 2, FANOUT - 1 - at), "").alias("after"),
    )


def fold(leaf: Column, proof: Column) -> Column:
    """The root that follows from ``leaf`` and the steps of its proof."""
    return F.aggregate(proof, leaf, lambda node, step: digest(step["before"], node, step["after"]))


def siblings(proof: Column) -> Column:
    """All sibling hashes of a proof joined, level by level from the leaf, left to right."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


def _exchange(states: DataFrame, span: int) -> DataFrame:
    """One round: every block learns the roots of the sibling subtrees of ``span`` blocks and hashes their parent.

    In a subtree cut short by the end of the table, the blocks that are there serve all that ask, each as many rows
    (copies with a salt) as keep the askers of one row few.
    """
    own = F.floor(F.col("block") / span).cast("bigint")
    low = F.col("block") % span
    blocks_of = lambda subtree: F.least(F.lit(span).cast("bigint"), F.col("blocks") - subtree * span)
    copies_of = lambda held: F.greatest(F.lit(1).cast("bigint"), F.ceil(span / (FANOUT * held)))

    first = own - own % FANOUT
    last = F.least(first + FANOUT - 1, F.floor((F.col("blocks") - 1) / span).cast("bigint"))
    others = F.filter(F.sequence(first, last), lambda subtree: subtree != own)
    asked = states.where(F.ceil(F.col("blocks") / span) > 1).withColumn("subtree", F.explode_outer(others))
    held = blocks_of(F.col("subtree"))
    asked = asked.select(
        "*",
        (F.col("subtree") * span + low % held).alias("partner"),
        (F.floor(low / held).cast("bigint") % copies_of(held)).alias("salt"),
    )
    serving = states.select(
        F.col("group").alias("g"),
        F.col("block").alias("b"),
        F.col("hash").alias("theirs"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), copies_of(blocks_of(own)) - 1)).alias("s"),
    )
    met = asked.join(
        serving,
        asked["group"].eqNullSafe(serving["g"]) & (asked["partner"] == serving["b"]) & (asked["salt"] == serving["s"]),
        "left",
    )
    joined = lambda side: F.array_join(F.transform(F.filter("found", side), lambda x: x["theirs"]), "")
    gathered = (
        met.groupBy("group", "block")
        .agg(
            *[F.first(name).alias(name) for name in ("blocks", "hash", "steps")],
            F.sort_array(
                F.collect_list(F.when(F.col("theirs").isNotNull(), F.struct("subtree", "theirs")))
            ).alias("found"),
        )
        .withColumn("before", joined(lambda x: x["subtree"] < own))
        .withColumn("after", joined(lambda x: x["subtree"] > own))
    )
    grown = gathered.select(
        "group",
        "block",
        "blocks",
        digest(F.col("before"), F.col("hash"), F.col("after")).alias("hash"),
        F.concat("steps", F.array(F.struct("before", "after"))).alias("steps"),
    )
    return grown.unionByName(states.where(F.ceil(F.col("blocks") / span) <= 1))


def _blocks(rows: DataFrame, order: Sequence[Column], block_levels: int) -> DataFrame:
    """The ranked ``rows`` (group, hash, row) as aligned blocks, written: group, total, blocks, block, leaves."""
    width = FANOUT**block_levels
    ranked = global_rank(rows, [*order, F.col("hash")], ["group"])
    by_rank = lambda a, b: (a["rank"] - b["rank"]).cast("int")
    blocks = materialize(
        ranked.groupBy("group", F.floor((F.col("rank") - 1) / width).cast("bigint").alias("block")).agg(
            F.array_sort(F.collect_list(F.struct("rank", "hash", "row")), by_rank).alias("leaves")
        ),
        "merkle-blocks",
    )
    totals = blocks.groupBy("group").agg(F.sum(F.size("leaves")).alias("total"), F.count("*").alias("blocks"))
    totals = broadcast_if_small(totals.withColumnRenamed("group", "g"))
    return blocks.join(totals, blocks["group"].eqNullSafe(totals["g"])).drop("g")


def _levels_of(blocks: DataFrame, block_levels: int) -> DataFrame:
    """The hashes of the levels inside each block, ``level0`` to ``level<block_levels>``; the last holds its root."""
    height = F.least(F.lit(block_levels), levels(F.col("total")))
    levelled = blocks.withColumn("height", height).withColumn("level0", F.col("leaves.hash"))
    for level in range(block_levels):
        below = F.col(f"level{level}")
        levelled = levelled.withColumn(
            f"level{level + 1}", F.when(F.col("height") > level, _parents(below)).otherwise(below)
        )
    return levelled


def _climb(blocks: DataFrame, block_levels: int) -> DataFrame:
    """The root of each block's group, and the steps from the block's own root to it, by rounds of exchange."""
    states = _levels_of(blocks, block_levels).select(
        "group",
        "block",
        "blocks",
        F.get(f"level{block_levels}", F.lit(0)).alias("hash"),
        F.array().cast(STEPS).alias("steps"),
    )
    states = materialize(states, "merkle-roots")
    most = states.agg(F.max("blocks")).first()[0] or 0
    span = 1
    while span < most:
        states = materialize(_exchange(states, span), "merkle-round")
        span *= FANOUT
    return states


def _proven(blocks: DataFrame, states: DataFrame, block_levels: int) -> DataFrame:
    """Each leaf's row with the steps inside its block before the steps of the block."""
    ends = states.select(
        F.col("group").alias("g"), F.col("block").alias("b"), *[c for c in states.columns if c not in ("group", "block", "blocks")]
    )
    met = _levels_of(
        blocks.join(ends, blocks["group"].eqNullSafe(ends["g"]) & (blocks["block"] == ends["b"])), block_levels
    )

    def proven(leaf: Column, at: Column) -> Column:
        inside = [_step(F.col(f"level{level}"), F.floor(at / FANOUT**level)) for level in range(block_levels)]
        return F.struct(
            leaf["row"].alias("row"),
            F.concat(F.slice(F.array(*inside), F.lit(1), F.col("height")), F.col("steps")).alias("proof"),
        )

    carried = [c for c in states.columns if c not in ("group", "block", "blocks", "steps")]
    return met.select(*carried, F.explode(F.transform("leaves", proven)).alias("leaf")).select(*carried, "leaf.*")


def prove(
    leaves: DataFrame, hash_col: str, order: Sequence[str], group_col: str, block_levels: int = BLOCK_LEVELS
) -> DataFrame:
    """Add ``subroot`` (of the row's group), ``root`` (of all groups) and ``proof`` to rows that carry a leaf hash.

    ``proof`` lists the steps from the leaf via the subroot to the root: the sibling hashes before and behind, joined.
    Rows of a group ascend by ``order``, nulls first; rows equal in it ascend by their hash. Groups ascend likewise; null
    is a group of its own, the first. A lone node is not hashed again. Every row stays, repeated rows included, with its
    other columns; an empty table gives no row. Pass narrow rows: they move with their hashes.
    """
    names = [name for name in leaves.columns if name not in ("subroot", "root", "proof")]
    rows = leaves.select(
        F.col(group_col).alias("group"),
        F.col(hash_col).alias("hash"),
        F.struct(*[F.col(f"`{name}`") for name in names]).alias("row"),
    )
    # Ranking reads its rows twice; hashes are made once.
    rows = materialize(rows, "merkle-leaves")
    blocks = _blocks(rows, [F.col(f"row.`{name}`") for name in order], block_levels)
    states = _climb(blocks, block_levels)

    # The subroots, one row per group, are the leaves of the tree above.
    tops = states.where(F.col("block") == 0).select(
        F.lit(0).alias("group"), "hash", F.struct(F.col("group").alias("name")).alias("row")
    )
    upper = _blocks(tops, [F.col("row.name")], block_levels)
    roots = _proven(upper, _climb(upper, block_levels), block_levels).select(
        F.col("row.name").alias("name"), F.col("hash").alias("root"), F.col("proof").alias("above")
    )
    roots = broadcast_if_small(materialize(roots, "merkle-tops"))
    ended = states.join(roots, states["group"].eqNullSafe(roots["name"])).select(
        "group",
        "block",
        "blocks",
        F.col("hash").alias("subroot"),
        "root",
        F.concat("steps", "above").alias("steps"),
    )
    return _proven(blocks, ended, block_levels).select("row.*", "subroot", "root", "proof")
