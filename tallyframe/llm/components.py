"""Connected components of a graph that is given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialize


def _signature(links: DataFrame) -> tuple[int, int]:
    row = links.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    ).first()
    return row["n"], row["s"] or 0


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of ``links`` (columns ``a`` and ``b``).

    Alternates two rounds until nothing changes: every node links its larger neighbours to the smallest node that it
    sees, then its smaller ones. Each round is an aggregate and a join on nodes, so a node of any degree is pre-aggregated
    and its join split; the tables are written between rounds. Links may repeat, point either way or to the node
    itself; the order of rounds grows with the logarithm of the number of nodes.
    """
    start = links.where(F.col("a") != F.col("b"))
    edges = materialize(
        start.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "component-links"
    )
    before = None
    while (now := _signature(edges)) != before:
        before = now
        # Larger neighbours: (v, smallest of u and its neighbours) for v > u.
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(smallest, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), "component-large")
        # Smaller neighbours: all of them, and u, link to the smallest.
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(smallest.select("a", F.col("m").alias("b")))
        edges = materialize(small.distinct(), "component-small")
    # Stars are left: every node but the roots has one link, to its root.
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
