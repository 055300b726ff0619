"""Connected components of a link table by alternating star contractions (distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import cut, discard


def _large_star(links: DataFrame) -> DataFrame:
    """Every node links its larger neighbours to the smallest of itself and its neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link, from links (a, b) of longs; component: its smallest node.

    Each round halves paths on both sides, so the rounds grow as the logarithm of the longest path.  A round
    is written before the next one reads it; the last is the one after which no link ends where another starts.
    Links from a node to itself make no node; an empty table gives an empty result.
    """
    held = cut(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b"), "links")
    stars = held.isEmpty()
    while not stars:
        after = cut(_small_star(_large_star(held)), "links")
        discard(held)
        held = after
        stars = held.select("b").join(held.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
    roots = held.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return held.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
