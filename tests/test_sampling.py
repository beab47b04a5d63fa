import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import ranking, sampling


def frame(spark, rows, schema="key int, label string"):
    return spark.createDataFrame(rows, schema).repartition(5)


def labelled(seed, n, labels):
    rng = random.Random(seed)
    return [(i, rng.choice(labels)) for i in range(n)]


def take_turns(buckets):
    for turn in itertools.zip_longest(*buckets):
        yield from (x for x in turn if x is not None)


@pytest.mark.parametrize("seed", range(3))
def test_global_rank(spark, many_partitions, seed):
    # One label holds most of the rows and spans several partitions.
    rows = labelled(seed, 700, ["a"] * 8 + ["b", "c", None])
    found = ranking.global_rank(frame(spark, rows), [F.col("key").desc()], ["label"]).collect()
    expected = {}
    for label in ("a", "b", "c", None):
        keys = sorted((k for k, lab in rows if lab == label), reverse=True)
        expected |= {k: i + 1 for i, k in enumerate(keys)}
    assert {r["key"]: r["rank"] for r in found} == expected
    plain = ranking.global_rank(frame(spark, rows), ["key"]).collect()
    assert {r["key"]: r["rank"] for r in plain} == {k: k + 1 for k, _ in rows}
    assert spark.range(0).withColumn("x", F.lit(1)).transform(lambda d: ranking.global_rank(d, ["id"])).count() == 0


@pytest.mark.parametrize("limit", [1, 7, 30, 2000])
def test_round_robin(spark, many_partitions, limit):
    rows = labelled(4, 60, ["c", "a", "a", "a", "b"])
    buckets = [[k for k, lab in rows if lab == label] for label in "abc"]
    expected = list(take_turns(buckets))[:limit]
    found = sampling.round_robin(frame(spark, rows), "label", ["key"], limit).orderBy("position").collect()
    assert [r["key"] for r in found] == expected
    assert [r["position"] for r in found] == list(range(len(expected)))


@pytest.mark.parametrize("seed", range(6))
def test_calibration_sample(spark, seed):
    rng = random.Random(seed)
    rows = labelled(seed, rng.randint(5, 60), ["a", "b", "x", "b", None, "b"])
    total = rng.randint(1, 70)
    base = list(take_turns([[k for k, lab in rows if lab == c] for c in ("b", "a")]))
    others = [k for k, lab in rows if lab not in ("a", "b")]
    found = sampling.calibration_sample(frame(spark, rows), "label", ["key"], total, ("b", "a")).orderBy("position").collect()
    assert [r["key"] for r in found] == (base + others)[:total]


def test_calibration_balance_and_errors(spark):
    rows = [(i, label) for i, label in enumerate(["active_tb", "healthy", "sick_but_non_tb"] * 50)]
    found = sampling.calibration_sample(frame(spark, rows), "label", ["key"], 128, strict=True).groupBy("label").count().collect()
    assert sum(r["count"] for r in found) == 128 and min(r["count"] for r in found) >= 42
    with pytest.raises(ValueError, match="Missing classes.*active_tb"):
        sampling.calibration_sample(frame(spark, [(1, "healthy")]), "label", ["key"], 3, strict=True)
    with pytest.raises(ValueError):
        sampling.calibration_sample(frame(spark, rows), "label", ["key"], 0)


def test_stratified_limit(spark):
    rows = [(i, label) for i, label in enumerate(["healthy", "active_tb", "sick_but_non_tb", "other"] * 3)]
    found = sampling.stratified_limit(frame(spark, rows), "label", ["key"], 2, strict=True).orderBy("index").collect()
    assert [(r["index"], r["key"], r["label"]) for r in found] == [
        (0, 1, "active_tb"), (1, 5, "active_tb"), (2, 0, "healthy"), (3, 4, "healthy"), (4, 2, "sick_but_non_tb"), (5, 6, "sick_but_non_tb")]
    with pytest.raises(ValueError, match="missing=1"):
        sampling.stratified_limit(frame(spark, rows), "label", ["key"], 4, strict=True)
    loose = sampling.stratified_limit(frame(spark, rows[:5]), "label", ["key"], 2).orderBy("index").collect()
    assert [(r["index"], r["key"]) for r in loose] == [(0, 1), (1, 0), (2, 4), (3, 2)]


def test_quota_split(spark):
    names = ["tb0002", "h0001", "s0002", "tb0001", "h0002", "s0001", "h0003"]
    rows = spark.createDataFrame([(n, {"t": "active_tb", "h": "healthy", "s": "sick_but_non_tb"}[n[0]]) for n in names], "name string, category string")
    quotas = {s: {"active_tb": 1, "healthy": 1, "sick_but_non_tb": 1} for s in ("train", "val")}
    found = sampling.quota_split(rows, "category", ["name"], quotas).orderBy("split", "class_order").collect()
    assert [(r["split"], r["name"]) for r in found] == [
        ("train", "tb0001"), ("train", "h0001"), ("train", "s0001"), ("val", "tb0002"), ("val", "h0002"), ("val", "s0002")]
    assert sampling.quota_shortfall(rows, "category", quotas).count() == 0
    short = sampling.quota_shortfall(rows, "category", {"train": {"healthy": 2}, "val": {"healthy": 5, "active_tb": 1}}).collect()
    assert [tuple(r) for r in short] == [("val", "healthy", 5, 1)]


def test_pick_per_class(spark):
    rows = spark.createDataFrame([("b", "x", "val"), ("a", "x", "train"), ("c", "x", "val"), ("z", "y", None), ("q", "y", "train")],
                                 "path string, category string, split string")
    found = sampling.pick_per_class(rows, "category", "path", "split", "val").orderBy("category").collect()
    assert [(r["category"], r["path"]) for r in found] == [("x", "b"), ("y", "q")]


def test_seeded_sample(spark):
    rows = frame(spark, [(i, "x") for i in range(50)])
    one = {r["key"] for r in sampling.seeded_sample(rows, "key", 10, 1).collect()}
    again = {r["key"] for r in sampling.seeded_sample(rows.repartition(9), "key", 10, 1).collect()}
    other = {r["key"] for r in sampling.seeded_sample(rows, "key", 10, 2).collect()}
    assert len(one) == 10 and one == again and one != other
    assert sampling.seeded_sample(rows, "key", 99).count() == 50


def test_class_weights(spark):
    rows = frame(spark, [(i, label) for i, label in enumerate("a" * 2 + "b" * 6 + "c" * 6)])
    mass = {r["label"]: r["n"] * r["weight"] for r in sampling.class_weights(rows, "label", "c", 2.0).collect()}
    assert mass == pytest.approx({"a": 1, "b": 1, "c": 2})
    soft = {r["label"]: r["weight"] for r in sampling.class_weights(rows, "label", exponent=0.5).collect()}
    assert soft["a"] / soft["b"] == pytest.approx(3**0.5)
    assert sampling.weight_exponent(None) == 1.0 and sampling.weight_exponent(None, "soft-balanced") == 0.5
    assert sampling.weight_exponent(0.7, "soft-balanced") == 0.7
    for bad in ({"boost": 0.0}, {"exponent": 0.0}):
        with pytest.raises(ValueError):
            sampling.class_weights(rows, "label", **bad)
    with pytest.raises(ValueError, match="needs the column label"):
        sampling.require_labels(rows.drop("label"))


def test_weighted_draws(spark, many_partitions):
    rows = frame(spark, [(i, "rare" if i < 3 else "common") for i in range(300)])
    drawn = sampling.weighted_draws(rows, "label", ["key"], seed=3, draws=4000, rows_per_salt=50).collect()
    assert sorted(r["draw"] for r in drawn) == list(range(4000))
    shares = Counter(r["label"] for r in drawn)
    assert abs(shares["rare"] - 2000) < 150
    assert {r["key"] for r in drawn if r["label"] == "rare"} == {0, 1, 2}
    # The spread over salts does not change what is drawn.
    plain = sampling.weighted_draws(rows, "label", ["key"], seed=3, draws=4000).collect()
    assert {(r["draw"], r["key"]) for r in plain} == {(r["draw"], r["key"]) for r in drawn}
    with pytest.raises(ValueError):
        sampling.weighted_draws(rows.limit(0), "label", ["key"])


def test_batches(spark):
    rows = sampling.reindex(frame(spark, [(i, "x") for i in range(10, 17)]), ["key"])
    found = sampling.batches(rows, 3).orderBy("key").collect()
    assert [(r["index"], r["batch"]) for r in found] == [(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1), (6, 2)]


def test_first_index(spark):
    rows = frame(spark, [(5, "a"), (2, "b"), (3, "a")])
    found = {r["label"]: r["first_index"] for r in sampling.first_index_per_label(rows, "label", "key", ("a", "z")).collect()}
    assert found == {"a": 3, "z": None}


def test_weighted_draws_over_many_classes(spark):
    rows = spark.range(6000).select(F.col("id").alias("key"), F.concat(F.lit("c"), F.col("id") % 1500).alias("label"))
    drawn = sampling.weighted_draws(rows, "label", ["key"], seed=3, draws=30_000).collect()
    assert sorted(r["draw"] for r in drawn) == list(range(30_000))
    counts = {}
    for row in drawn:
        assert row["label"] == f"c{row['key'] % 1500}"
        counts[row["label"]] = counts.get(row["label"], 0) + 1
    assert len(counts) == 1500 and max(counts.values()) < 60
    # One row that takes all draws is repeated in steps.
    one = spark.createDataFrame([(1, "a")], "key bigint, label string")
    assert sampling.weighted_draws(one, "label", ["key"], draws=20_000, rows_per_salt=2).count() == 20_000


def test_null_labels_are_a_class_of_their_own(spark):
    rows = spark.createDataFrame([(1, None), (2, None), (3, "a")], "key bigint, label string")
    weighted = sampling.attach_weights(rows, sampling.class_weights(rows))
    assert sorted((r["key"], r["weight"]) for r in weighted.collect()) == [(1, 0.5), (2, 0.5), (3, 1.0)]
    drawn = sampling.weighted_draws(rows, "label", ["key"], draws=2000, rows_per_salt=10).collect()
    shares = Counter((r["label"], r["key"]) for r in drawn)
    assert len(drawn) == 2000 and set(shares) == {(None, 1), (None, 2), ("a", 3)}
    assert abs(shares["a", 3] - 1000) < 120 and abs(shares[None, 1] - 500) < 120


def hit_rows(masses, seed, draws):
    """Draw and key by the definition: points on the line of the keys in their order."""
    import hashlib

    total, out = sum(masses.values()), []
    for draw in range(draws):
        unit = int(hashlib.md5(f"{seed}:row:{draw}".encode()).hexdigest()[:13], 16) / (1 << 52)
        place = min(int(unit * total), total - 1)
        for key in sorted(masses):
            place -= masses[key]
            if place < 0:
                out.append((draw, key))
                break
    return out


def test_draws_by_row_weights(spark, many_partitions):
    """A heavy row, a crowd of light ones, rows without a weight, and names that the operator uses itself."""
    rows = [(i, 100_000 if i == 70 else None if i == 3 else 0 if i < 3 else 1 + i % 5, "w") for i in range(400)]
    df = spark.createDataFrame(rows, "key bigint, mass int, row string").repartition(7)
    masses = {key: mass or 0 for key, mass, _ in rows}
    got = sampling.weighted_row_draws(df, F.col("mass"), ["key"], seed=9, draws=3000).collect()
    assert sorted((r["draw"], r["key"]) for r in got) == hit_rows(masses, 9, 3000)
    assert len({r["key"] for r in got}) > 10 and all(r["row"] == "w" for r in got)
    # The same weights as fractions, as many draws as rows, and one row alone.
    halves = sampling.weighted_row_draws(df, F.col("mass") / 2, ["key"], seed=9).collect()
    assert len(halves) == 400 and sum(r["key"] == 70 for r in halves) > 380
    one = sampling.weighted_row_draws(df.where("key = 9"), F.lit(0.3), ["key"], draws=50).collect()
    assert {(r["draw"], r["key"]) for r in one} == {(n, 9) for n in range(50)}


@pytest.mark.parametrize("weight", ["-1", "0", "cast(null as double)", "double('Infinity')"])
def test_draws_need_good_weights(spark, weight):
    with pytest.raises(ValueError):
        sampling.weighted_row_draws(frame(spark, [(1, "a"), (2, "b")]), F.expr(weight), ["key"])


@pytest.mark.parametrize("k", [1001, 3000, 20_000])
def test_large_k_is_cut_before_it_is_ranked(spark, k):
    rows = spark.range(40_000).select(
        F.xxhash64("id").alias("key"), F.when(F.col("id") % 3 != 0, F.col("id") % 2).alias("group"), F.lit("text").alias("t"))
    ranked = ranking.smallest_per_group(rows, ["key"], ["group"], k).collect()
    wanted = {}
    for row in sorted(rows.collect(), key=lambda r: r["key"]):
        listed = wanted.setdefault(row["group"], [])
        if len(listed) < k:
            listed.append(row["key"])
    found = {}
    for row in sorted(ranked, key=lambda r: r["rank"]):
        found.setdefault(row["group"], []).append(row["key"])
        assert len(found[row["group"]]) == row["rank"]
    assert found == wanted
    if k < 20_000:
        assert ranking._cut(rows, ["key"], ["group"], k).count() < 3 * 1.6 * k
    assert [r["key"] for r in ranking.smallest(rows, ["key"], k).orderBy("rank").collect()] == sorted(r["key"] for r in rows.collect())[:k]
