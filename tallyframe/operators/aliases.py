"""Classes named by free texts, by a table of aliases of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.tokens import normalize_token
from tallyframe.session import BROADCAST_ROW_LIMIT, materialize

_PART = "_"


def ranked_aliases(aliases: DataFrame) -> DataFrame:
    """``alias, words, position, category``: one row per alias after normalisation.

    ``aliases`` has ``category, alias, position``, the position being that of the class; every class is an alias of itself.
    Of classes with the same alias the one with the least position counts, then the first by name. A null position comes
    last; rows without a class and aliases without letters or digits are left out.
    """
    known = aliases.where("category IS NOT NULL").select("category", "alias", F.coalesce(F.col("position").cast("bigint"), F.lit((1 << 63) - 1)).alias("position"))
    own = known.groupBy("category").agg(F.min("position").alias("position")).withColumn("alias", F.col("category"))
    token = normalize_token(F.col("alias"))
    named = known.unionByName(own).select(token.alias("alias"), "position", "category").where("alias != ''")
    best = named.groupBy("alias").agg(F.min(F.struct("position", "category")).alias("best"))
    return best.select("alias", F.size(F.split("alias", _PART)).alias("words"), "best.position", "best.category")


def _with_runs(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Add ``__run<n>`` per length: hashes of the run of n words that begins at each of ``__parts``, null where it ends before.

    Runs are put together from runs of 1, 2, 4, ... words, so a length costs as many steps as it has binary digits.
    """

    def followed(run: Column, by: str, after: int) -> Column:
        behind = F.slice(by, after + 1, F.size(by))
        return F.zip_with(run, behind, lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.xxhash64(a, b)))

    df = df.withColumn("__run1", F.transform("__parts", lambda word: F.xxhash64(word)))
    powers = [1]
    while 2 * powers[-1] <= max(lengths, default=1):
        powers.append(2 * powers[-1])
        df = df.withColumn(f"__run{powers[-1]}", followed(F.col(f"__run{powers[-2]}"), f"__run{powers[-2]}", powers[-2]))
    for n in lengths:
        if n not in powers:
            run, covered = None, 0
            for power in reversed(powers):
                if n & power:
                    run = F.col(f"__run{power}") if run is None else followed(run, f"__run{power}", covered)
                    covered += power
            df = df.withColumn(f"__run{n}", run)
    return df


def categories_by_alias(df: DataFrame, value_col: str, aliases: DataFrame, out_col: str = "category") -> DataFrame:
    """Add the class that the text in ``value_col`` names by an alias of the table, or null.

    As ``tokens.canonical_category`` does for a list: the alias with most words wins, then the first class; parts of words
    never match. Hashes of the runs of words of each text, as long as aliases are, meet those of the aliases, and what
    meets is looked up in the text, so the work does not grow with texts times aliases. From there on a digest stands for
    the text. Null and empty texts have no class. A column named like ``out_col`` is replaced.
    """
    ranked = materialize(ranked_aliases(aliases), "aliases")
    # As many numbers as there are lengths of aliases, in words.
    lengths = sorted(row.words for row in ranked.select("words").distinct().collect())
    alias = _with_runs(ranked.withColumn("__parts", F.split("alias", _PART)), lengths)
    whole = F.coalesce(*[F.when(F.col("words") == n, F.get(f"__run{n}", F.lit(0))) for n in lengths], F.lit(None).cast("bigint"))
    hashed = alias.select(whole.alias("__run"), "alias", "words", "position", "category")

    token = normalize_token(F.col(value_col))
    keyed = df.drop(out_col).withColumn("__token", token).withColumn("__key", F.when(F.col("__token") != "", F.sha2("__token", 256)))
    texts = keyed.select("__key", "__token").where("__key IS NOT NULL")
    split = _with_runs(texts.withColumn("__parts", F.split("__token", _PART)), lengths)
    every = F.array_distinct(F.concat(F.array().cast("array<bigint>"), *[F.col(f"__run{n}") for n in lengths]))
    if ranked.limit(BROADCAST_ROW_LIMIT + 1).count() <= BROADCAST_ROW_LIMIT:
        met = split.select("__key", "__token", F.explode(every).alias("__run")).join(F.broadcast(hashed), "__run")
    else:
        # Texts do not move with each of their runs.
        met = split.select("__key", F.explode(every).alias("__run")).distinct().join(hashed, "__run")
        met = met.join(texts.dropDuplicates(["__key"]), "__key")
    padded = [F.concat(F.lit(_PART), F.col(name), F.lit(_PART)) for name in ("__token", "alias")]
    found = met.where(F.contains(*padded)).select("__key", "words", "position", "category")
    named = found.groupBy("__key").agg(F.min_by("category", F.struct(-F.col("words"), "position", "category")).alias(out_col))
    return keyed.join(named, "__key", "left").drop("__token", "__key")
