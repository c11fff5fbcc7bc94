"""Connected components by alternating large-star and small-star steps, as joins on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, materialise

ROUNDS = 40


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to its smallest neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    handed = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour and that has none: each star is a component then."""
    if not edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, component) for every node that an edge (u, v) of longs touches; the component is its smallest node.

    Steps repeat until the edges are stars; each step's edges are written, so lineage stays short. Only whether they are
    stars comes to the driver.
    """
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(ROUNDS):
        if _settled(now):
            break
        after = materialise(_small_star(_large_star(now)), "edges")
        drop(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    return now.select("u", F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("u"), F.col("v").alias("component")).distinct())
