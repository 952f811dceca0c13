"""Connected components of a graph given as a table of links, without gathering any part of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import store


def _star(edges: DataFrame) -> DataFrame:
    """One round: link every neighbour of a node to the least of them, first upwards, then downwards.

    The least neighbour is an aggregate that tasks combine before the shuffle, and the join back is between two
    plain tables, so a node with very many links can be split over tasks."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = store.keep(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    large = store.keep(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "links")
    least = store.keep(large.groupBy("a").agg(F.min("b").alias("m")), "least")
    small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return store.keep(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a long, b long): root is the least node that it reaches, itself included.

    Rounds double the reach of every node, so their number grows with the logarithm of the longest path.  Loops
    (a = b), nulls and repeated links change nothing; no links give no rows.
    """
    edges = store.keep(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    have = _sum(edges)
    while have[0]:
        edges = _star(edges)
        now = _sum(edges)
        if now == have:
            break
        have = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
