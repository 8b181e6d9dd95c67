"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeweave.session import stage

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least node of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of ``edges`` (u, v); each round is written.

    Loops and repeated edges do no harm; an edge with a null end is left out.
    """
    now = stage(edges.where("u <> v").select("u", "v").distinct(), "edges")
    mark = None
    for _ in range(MAX_ROUNDS):
        now = stage(_small_star(_large_star(now).distinct()).distinct(), "edges")
        after = now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if after == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = after
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
