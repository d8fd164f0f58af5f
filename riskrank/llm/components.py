"""Connected components by alternating large and small stars.

Each round hooks every node to the smallest node it knows of; the number of
rounds grows with the logarithm of the longest path. Every round is one pass of
equi-joins and map-side combined aggregates over (long, long) rows, written to
the shared scratch folder, so no group of links meets in one task or on the
driver, and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskrank.session import materialise, release

LINKS_A_TASK = 50_000


def _tasks(links: int) -> int:
    """Tasks that read a round's links: a small table in hundreds of files costs more than what it holds."""
    return max(1, -(-links // LINKS_A_TASK))


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("hi", "lo"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect the larger neighbours of each node to the smallest of its neighbourhood."""
    both = edges.select("hi", "lo").union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = both.groupBy("hi").agg(F.least(F.min("lo"), F.col("hi")).alias("least"))
    return (both.join(least, "hi").where(F.col("lo") > F.col("hi"))
            .select(F.col("lo").alias("hi"), F.col("least").alias("lo")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect each node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("least"))
    linked = edges.join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return (linked.where(F.col("hi") != F.col("lo"))
            .union(least.select("hi", F.col("least").alias("lo"))).distinct())


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of a link, component being the smallest node reachable.

    Links with a null end and links from a node to itself are left out; repeated
    links count once. No links give no rows.
    """
    known = links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
    edges = materialise(known.select(F.greatest(left, right).cast("long").alias("hi"),
                                     F.least(left, right).cast("long").alias("lo")).distinct(), "links")
    before = _signature(edges)
    while True:
        few = _tasks(before[0])
        after_large = _large_star(edges.coalesce(few)).coalesce(few)
        stars = materialise(_small_star(after_large).coalesce(few), "stars")
        after = _signature(stars)
        release(edges)
        edges = stars
        if after == before:
            break
        before = after
    return (edges.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
            .union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct())
