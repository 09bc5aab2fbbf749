"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripwise.sources.shared import written


def _both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    return edges.select("a", "b").unionByName(turned)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node on the smallest one: the larger ones, or the smaller ones and itself.

    The smallest neighbour is an aggregate and joined back, so a node with very many
    neighbours is combined before the shuffle and split by the skew join.
    """
    around = _both_ways(edges) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = written(around.groupBy("a").agg(F.least("a", F.min("b")).alias("least")), "least")
    joined = around.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
    return written(out.filter("a <> b").distinct(), "star")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of every node that has an edge ``a, b`` to another."""
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before, now = None, state(edges)
    while now != before:
        edges = _star(_star(edges, large=True), large=False)
        before, now = now, state(edges)
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return written(stars.unionByName(roots).distinct(), "components")
