import random
import time

import pytest
from pyspark.sql import functions as F

from tallyframe import defaults
from tallyframe.functions import tokens
from tallyframe.operators import aliases

ALIASES = "category string, alias string, position int"


def as_table(spark, names):
    rows = [(category, alias, n) for n, (category, listed) in enumerate(names.items()) for alias in listed]
    return spark.createDataFrame(rows, ALIASES)


def test_a_table_names_what_the_list_names(spark):
    draw = random.Random(3)
    words = ["active", "TB", "tb", "latent", "healthy", "normal", "sick", "but", "non", "x", "Normal-case", "not", "é", "--"]
    texts = [" ".join(draw.choices(words, k=draw.randrange(7))) for _ in range(500)] + [None, "", "activetb", "normal " * 3000]
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "i int, text string, alias string")
    listed = df.select("i", tokens.canonical_category(F.col("text")).alias("category")).collect()
    found = aliases.categories_by_alias(df, "text", as_table(spark, defaults.CATEGORY_ALIASES))
    assert found.columns == ["i", "text", "alias", "category"]
    assert sorted(tuple(r) for r in found.select("i", "category").collect()) == sorted(tuple(r) for r in listed)
    assert len({r.category for r in listed}) > 3


def test_fifty_thousand_aliases(spark):
    draw = random.Random(4)
    table = {" ".join(f"w{draw.randrange(900)}" for _ in range(draw.randint(1, 4))): draw.randrange(300) for _ in range(50_000)}
    rows = [(f"class {n}", alias, n) for alias, n in table.items()]
    texts = [" ".join(f"W{draw.randrange(950)}" for _ in range(draw.randint(1, 30))) for _ in range(2000)]
    ranked = {alias.replace(" ", "_"): (-alias.count(" "), n) for alias, n in table.items()}
    ranked |= {f"class_{n}": (-1, n) for n in range(300)}

    def wanted(text):
        parts = text.lower().split()
        runs = {"_".join(parts[i:j]) for i in range(len(parts)) for j in range(i + 1, min(i + 4, len(parts)) + 1)}
        found = min((ranked[run] for run in runs if run in ranked), default=None)
        return found and f"class {found[1]}"

    began = time.time()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.category for r in aliases.categories_by_alias(df, "text", spark.createDataFrame(rows, ALIASES)).collect()}
    assert got == {i: wanted(text) for i, text in enumerate(texts)}
    assert time.time() - began < 60


def test_ties_nulls_and_empty_tables(spark):
    rows = [("b", "same", 1), ("a", "Same!", 1), ("z", "same", None), (None, "none", 0), ("c", None, 5), ("d", "--", 2), ("d", "x y", 2), ("d", "x y", 9)]
    texts = ["a same thing", "z", "none", "c", "d", "x", "y x y", None]
    df = spark.createDataFrame([(t, "old") for t in texts], "text string, category string")
    got = {r.text: r.category for r in aliases.categories_by_alias(df, "text", spark.createDataFrame(rows, ALIASES)).collect()}
    assert got == {"a same thing": "a", "z": "z", "none": None, "c": "c", "d": "d", "x": None, "y x y": "d", None: None}
    none = spark.createDataFrame([], ALIASES)
    assert [r.category for r in aliases.categories_by_alias(df, "text", none).collect()] == [None] * len(texts)
    assert aliases.categories_by_alias(df.limit(0), "text", none).count() == 0


@pytest.mark.parametrize("limit", [None, 0])
def test_aliases_of_many_lengths(spark, monkeypatch, limit):
    """Broadcast and shuffled tables name the same, whatever the lengths of aliases and gaps between them."""
    if limit is not None:
        monkeypatch.setattr(aliases, "BROADCAST_ROW_LIMIT", limit)
    words = {n: " ".join(f"a{n}w{i}" for i in range(n)) for n in (1, 2, 3, 5, 7, 11, 40, 300)}
    rows = [(f"class {n}", text, n) for n, text in words.items()]
    texts = {f"{n}{way}": change(text) for n, text in words.items() for way, change in (
        ("whole", lambda t: t), ("within", lambda t: f"Before, {t.upper()}! behind"), ("twice", lambda t: f"{t} {t}"),
        ("cut", lambda t: t[:-1] + "x"), ("glued", lambda t: f"x{t}x"))}
    texts |= {"longest": f"{words[5]} {words[1]} {words[7]} {words[2]}", "copy": f"{words[5]} {words[1]} {words[7]} {words[2]}", "none": None}
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    got = {r.name: r.category for r in aliases.categories_by_alias(df, "text", spark.createDataFrame(rows, ALIASES)).select("name", "category").collect()}
    right = {f"{n}{way}": f"class {n}" for n in words for way in ("whole", "within", "twice")}
    assert got == {name: right.get(name) for name in texts} | {"longest": "class 7", "copy": "class 7"}


def test_texts_do_not_move_with_their_matches(spark):
    df = spark.createDataFrame([("a b c " * 500,)], "text string")
    plan = aliases.categories_by_alias(df, "text", spark.createDataFrame([("x", "a", 0), ("y", "b c", 1)], ALIASES))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "hashpartitioning(__key" in physical and "hashpartitioning(__token" not in physical
