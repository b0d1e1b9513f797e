"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm.common import checkpointed


def connected_components(edges: DataFrame) -> DataFrame:
    """(``node``, ``component``) for every node of ``edges`` (``a``, ``b``, long, no nulls); the component is its smallest node.

    Alternates two star steps until the edges stay the same: link every larger
    neighbour to the smallest one, then every smaller neighbour. Each step is a
    minimum per node (combined before the shuffle) joined back to the edges.
    """
    edges = checkpointed(_ordered(edges))
    before = None
    while True:
        edges = checkpointed(_small_star(_large_star(edges)))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, from its larger node ``a`` to its smaller node ``b``."""
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return pairs.where(F.col("a") != F.col("b")).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of the node and its neighbours."""
    # With a > b, the larger neighbours of b are its a; the smallest of all is the smallest below b, or b.
    least = edges.groupBy("a").agg(F.min("b").alias("low")).withColumnRenamed("a", "b")
    moved = edges.join(least, "b", "left")
    return moved.select("a", F.coalesce("low", "b").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a")
    others = moved.where(F.col("b") > F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return others.union(least.select("a", F.col("low").alias("b"))).distinct()
