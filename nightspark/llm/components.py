"""Connected components of a table of links, without collecting any of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightspark.llm.common import cut, drop


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the node's smallest neighbour (or itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        F.col("a").alias("_a"), F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, F.col("a") == F.col("_a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of them; rows are (larger, smaller)."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_a"), "m")
    moved = edges.join(least, F.col("a") == F.col("_a")).filter("b <> m").select(
        F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("_a", "m")).distinct()


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Columns node and component (its smallest node), for every node of a link.

    Alternating large and small stars: a logarithmic number of rounds, each a
    few shuffles of the links; a node with very many links is a minimum that is
    combined before the shuffle, and a join that Spark splits.  Links to itself
    and null ends are left out; no links give no rows.
    """
    a, b = F.col(left), F.col(right)
    edges = cut(links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    before = _state(edges)
    while before[0]:
        last, edges = edges, cut(_small_star(_large_star(edges)), "links")
        drop(last)
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
