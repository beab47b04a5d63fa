import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(leaves):
    """The root over ``leaves`` and the (before, after) steps of each, by the definition."""
    steps = [[] for _ in leaves]
    above, places = list(leaves), list(range(len(leaves)))
    while len(above) > 1:
        for leaf, place in enumerate(places):
            run = above[place // 8 * 8 : place // 8 * 8 + 8]
            steps[leaf].append(("".join(run[: place % 8]), "".join(run[place % 8 + 1 :])))
        above = [h(*above[i : i + 8]) for i in range(0, len(above), 8)]
        places = [place // 8 for place in places]
    return (above[0] if above else None), steps


def brute(rows):
    """Rows (group, order, hash) to a sorted list of (group, order, hash, subroot, root, proof)."""
    groups = {}
    for group, order, leaf in rows:
        groups.setdefault(group, []).append((order is not None, order or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain([leaf for _, _, leaf in sorted(groups[g])]) for g in names}
    root, above = plain([trees[g][0] for g in names])
    out = []
    for top, g in zip(above, names):
        for (known, order, leaf), proof in zip(sorted(groups[g]), trees[g][1]):
            out.append((g, order if known else None, leaf, trees[g][0], root, proof + top))
    return sorted(out, key=repr)


def proven(df, block_levels):
    made = manifest.prove(df, "leaf", ["id"], "lang", block_levels).collect()
    out = [(r.lang, r.id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof]) for r in made]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_levels", [1, 3])
def test_trees_of_all_shapes(spark, many_partitions, block_levels):
    """Lone leaves, full runs, runs of one, and with blocks of 8 up to two rounds with short subtrees."""
    rows = []
    for group, size in [(None, 1), ("a", 8), ("b", 9), ("c", 64), ("d", 65), ("é", 521), ("Z", 600), ("", 2)]:
        rows += [(group, order, h(repr((group, order)))) for order in range(size)]
    rows += [("a", None, h("none")), ("a", 3, h("tie")), ("a", 3, h("tie")), (None, None, h("null"))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "lang string, id bigint, leaf string").repartition(5)
    assert proven(df, block_levels) == brute(rows)


def test_three_rounds_and_more_groups_than_a_run(spark):
    rows = [("x", order, h(str(order))) for order in range(4200)] + [(f"g{n}", 0, h(f"g{n}")) for n in range(70)]
    df = spark.createDataFrame(rows, "lang string, id bigint, leaf string")
    assert proven(df, 1) == brute(rows)


def test_folding_finds_tampering(spark):
    rows = [("x", order, h(str(order))) for order in range(100)]
    df = spark.createDataFrame(rows, "lang string, id bigint, leaf string").withColumn(
        "now", F.when(F.col("id") % 3 == 0, F.sha2("leaf", 256)).otherwise(F.col("leaf"))
    )
    made = manifest.prove(df, "leaf", ["id"], "lang").withColumn("end", manifest.fold(F.col("now"), F.col("proof")))
    assert {(r.id % 3 == 0, r.end == r.root) for r in made.collect()} == {(True, False), (False, True)}


def test_leaf_digest_keeps_nulls_and_borders_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("", "a"), ("1:a", None), ("é", "b")], "x string, y string")
    got = [r[0] for r in df.select(manifest.leaf_digest(F.col("x"), F.col("y"))).collect()]
    assert got == [h("-", "1:a"), h("0:", "1:a"), h("3:1:a", "-"), h("2:é", "1:b")]


def test_empty_table_and_clashing_names(spark):
    schema = "lang string, id bigint, leaf string, root string, proof int, subroot int, `group` string, block int, hash int"
    assert manifest.prove(spark.createDataFrame([], schema), "leaf", ["id"], "lang").count() == 0
    rows = [("x", n, h(str(n)), "old", 1, 2, "kept", 7, n) for n in range(10)]
    made = manifest.prove(spark.createDataFrame(rows, schema), "leaf", ["id"], "lang").collect()
    assert len(made) == 10 and all(r.root != "old" and r.group == "kept" and r.block == 7 and r.hash == r.id for r in made)


def test_awkward_documents(awkward):
    columns = [F.col(c) for c in ("doc_id", "source", "extra", "text")]
    leaves = awkward.withColumn("leaf", manifest.leaf_digest(*columns)).drop("text")
    made = manifest.prove(leaves, "leaf", ["doc_id"], "source").select("doc_id", "source", "leaf", "root", "size",
        manifest.fold(F.col("leaf"), F.col("proof")).alias("end"))
    rows = made.collect()
    assert len(rows) == awkward.count() and all(r.end == r.root and r.size == "kept" for r in rows)
