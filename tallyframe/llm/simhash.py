"""Near duplicates by fingerprints that differ in few bits (operator 9).

Ball hashing that meets in the middle: if two fingerprints differ in at most 2r bits, some value differs from either in
at most r. Every fingerprint hands out all values within r of itself, equal values meet, and pairs that meet are
checked. All 64 bits at once and r = 2 are 2,081 values for a fingerprint, too many to shuffle for each. But of four
differing bits one half of the fingerprint has at most two, so balls of r = 1 over each half, 66 values, let every link
meet as well. Values where more than CROWD fingerprints meet are not paired: their fingerprints hand out the full balls,
where all that meet at one value are linked without a check (2 + 2 bits), as a star. No link is lost either way, and no
group is ever expanded into its pairs beyond CROWD.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tallyframe.llm.batches import bound_batches
from tallyframe.llm.components import connected_components
from tallyframe.session import materialize

SHINGLE = 4
MAX_BITS = 4
SEED = 42
# Most fingerprints of one value that are compared with each other.
CROWD = 256
# Shingles whose hashes are counted bit by bit at once.
_SLICE = 1 << 16


def fingerprint_of(raw: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text as a signed 64-bit integer."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxh64_intdigest(text, SEED)], "<u8")
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
        spans = zip(starts, ends[shingle - 1 :].tolist())
        hashes = np.array([xxh64_intdigest(text[start:end], SEED) for start, end in spans], "<u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _SLICE):
        part = hashes[at : at + _SLICE].view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<i8")[0])


@F.arrow_udf(LongType())
def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint_of(text) for text in texts.to_pylist()], pa.int64())


def fingerprint(text: Column) -> Column:
    """SimHash of a text column: bits set in over half the XXH64 of its 4-word shingles, A-Z in lower case.

    Shingles count as often as they occur; fewer words are one shingle. A null text and one without words have 0.
    """
    return _fingerprints(F.coalesce(text, F.lit("")).cast("binary"))


def _half_ball(value: Column) -> Column:
    """Values within one bit of either half: the half's number in bit 32, the half itself below."""
    low = F.lit(0xFFFFFFFF).cast("bigint")
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(1 << bit).cast("bigint") for bit in range(32)])
    halves = (value.bitwiseAND(low), F.shiftrightunsigned(value, 32).bitwiseOR(F.lit(1 << 32).cast("bigint")))
    return F.concat(*[F.transform(flips, half.bitwiseXOR) for half in halves])


def _full_ball(value: Column) -> Column:
    """Values within two bits."""
    one = F.sequence(F.lit(0), F.lit(63))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i)
    singles = F.transform(one, lambda i: value.bitwiseXOR(bit(i)))
    pairs = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(63)),
            lambda i: F.transform(
                F.sequence(F.lit(0), i - 1), lambda j: value.bitwiseXOR(bit(i)).bitwiseXOR(bit(j))
            ),
        )
    )
    return F.concat(F.array(value), singles, pairs)


def _met(crowd: int, bits: int):
    """Links among the fingerprints of equal values, from rows sorted by value; crowded fingerprints as links to null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        # The end of the last batch: the rows of its last value, ``crowd`` at most.
        held_values, held_prints = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            values = np.concatenate([held_values, batch.column(0).to_numpy(zero_copy_only=False)])
            prints = np.concatenate([held_prints, batch.column(1).to_numpy(zero_copy_only=False)])
            if not len(values):
                continue
            firsts = np.searchsorted(values, values, side="left")
            sizes = np.searchsorted(values, values, side="right") - firsts
            crowded = sizes > crowd
            left, right = [], []
            at = np.flatnonzero((sizes > 1) & ~crowded)
            step = 1
            while len(at):
                at = at[at + step < firsts[at] + sizes[at]]
                close = np.bitwise_count((prints[at] ^ prints[at + step]).view(np.uint64)) <= bits
                left.append(at[close])
                right.append(at[close] + step)
                step += 1
            a, b = np.concatenate([[], *left]).astype(np.int64), np.concatenate([[], *right]).astype(np.int64)
            # One link for each row that is not the first of its own, instead of all pairs.
            label = np.arange(len(values))
            while len(a):
                before = label.copy()
                least = np.minimum(label[a], label[b])
                np.minimum.at(label, a, least)
                np.minimum.at(label, b, least)
                label = label[label]
                if (label == before).all():
                    break
            linked = np.flatnonzero(label != np.arange(len(values)))
            out_a = np.concatenate([prints[linked], prints[crowded]])
            out_b = np.concatenate([prints[label[linked]], np.zeros(crowded.sum(), np.int64)])
            full = np.concatenate([np.zeros(len(linked), bool), np.ones(crowded.sum(), bool)])
            yield pa.record_batch([pa.array(out_a), pa.array(out_b, mask=full)], ["a", "b"])
            # A run that goes on keeps enough of its rows to be seen as crowded again.
            start = max(int(firsts[-1]), len(values) - crowd - 1)
            held_values, held_prints = values[start:], prints[start:]

    return run


def link(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``a`` and ``b``: links that connect all of the distinct fingerprints in ``fingerprint`` that differ in <= 4 bits.

    Fingerprints linked by more than one path need not have a link of their own.
    """
    values = prints.select(F.explode(_half_ball(F.col("fingerprint"))).alias("value"), "fingerprint")
    met = values.repartition("value").sortWithinPartitions("value").mapInArrow(_met(crowd, MAX_BITS), "a bigint, b bigint")
    met = materialize(met, "simhash-met")
    crowded = met.where(F.col("b").isNull()).select(F.col("a").alias("fingerprint")).distinct()
    balls = crowded.select(F.explode(_full_ball(F.col("fingerprint"))).alias("value"), "fingerprint")
    # At most 2,081 fingerprints lie around a value; all of them are within four bits of each other.
    centers = balls.groupBy("value").agg(F.min("fingerprint").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = balls.join(centers.select("value", "b"), "value").where(F.col("fingerprint") != F.col("b"))
    return met.where(F.col("b").isNotNull()).unionByName(stars.select(F.col("fingerprint").alias("a"), "b").distinct())


def components(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """``fingerprint`` and ``root`` for every fingerprint that occurs in ``prints`` and is linked to another."""
    return connected_components(link(prints.select("fingerprint").distinct(), crowd)).select(
        F.col("node").alias("fingerprint"), "root"
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Add ``fingerprint`` (16 lowercase hex digits) and ``component_id`` to every row; the input's rows are written once.

    ``component_id`` is the smallest id (null ids aside) that is reached over links of fingerprints differing in at most
    four bits; copies share a fingerprint, and so do texts without words. It is null only where all ids are.
    """
    bound_batches(docs.sparkSession)
    bits = "__llm_bits"
    stored = materialize(docs.withColumn(bits, fingerprint(F.col(text_col))).drop("fingerprint", "component_id"), "simhash-rows")
    prints = materialize(
        stored.groupBy(F.col(bits).alias("fingerprint")).agg(F.min(id_col).alias("first")), "simhash-prints"
    )
    roots = materialize(components(prints, crowd), "simhash-roots")
    rooted = prints.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    ids = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    # One row per fingerprint.
    known = rooted.join(ids, "root").select(F.col("fingerprint").alias(bits), "component_id")
    out = stored.join(known, bits)
    return out.withColumn("fingerprint", F.lower(F.lpad(F.hex(bits), 16, "0"))).select(
        *[c for c in stored.columns if c != bits], "fingerprint", "component_id"
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, that with the smallest id (null first, any one of equal ids), columns unchanged."""
    bound_batches(docs.sparkSession)
    uid = "__llm_uid"
    stored = materialize(
        docs.withColumns({"__llm_bits": fingerprint(F.col(text_col)), uid: F.monotonically_increasing_id()}), "keep-one"
    )
    prints = stored.groupBy(F.col("__llm_bits").alias("fingerprint")).agg(F.min(F.struct(id_col, uid)).alias("first"))
    prints = materialize(prints, "keep-one-prints")
    rooted = prints.join(components(prints), "fingerprint", "left")
    best = rooted.groupBy(F.coalesce("root", "fingerprint")).agg(F.min("first").alias("first"))
    return stored.join(best.select(F.col(f"first.{uid}").alias(uid)), uid, "left_semi").select(*docs.columns)
