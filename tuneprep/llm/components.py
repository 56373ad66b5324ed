"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneprep.session import materialise

# Rounds halve the distance to the smallest node; no graph that fits a cluster needs more.
MOST_ROUNDS = 64


def _with_smallest(links: DataFrame) -> DataFrame:
    """Each link (a, b) with the smallest node m among a and all its b. The minima are combined before the shuffle."""
    smallest = links.groupBy("a").agg(F.min("b").alias("m"))
    return links.join(smallest.select("a", F.least("a", "m").alias("m")), "a")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (
        _with_smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    joined = _with_smallest(down)
    return (
        joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(joined.select("a", F.col("m").alias("b")))
        .where("a <> b")
        .distinct()
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """For each linked node, (node, component): the smallest node reachable, itself included.

    links: two columns of one type that can be ordered, no nulls; loops and
    repeated links do no harm. Nodes without a link to another are left out. Each
    round is written to the shared folder, so that a lost executor costs one round.
    The rounds end when every node is linked with the smallest of its component
    only, found by comparing the order-free fingerprint of two rounds.
    """
    links = materialise(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    mark = None
    for _ in range(MOST_ROUNDS):
        found = links.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == mark or not found[0]:
            break
        mark = found
        links = materialise(_small_star(_large_star(links)), "links")
    else:
        raise RuntimeError("the components did not settle")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
