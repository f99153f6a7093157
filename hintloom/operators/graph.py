"""Connected components of large, skewed graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hintloom.lineage import cut


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Per node ``u`` the least of itself and its neighbours; partial sums make hub nodes cheap."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least_neighbour(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least_neighbour(down)
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star.

    ``edges`` holds two bigint columns. The result has ``node`` and ``component``, the least node of its component, one row per node that
    has an edge to another node. Self-loops, repeated edges, edges with a null end and extra columns do not matter; an empty table gives
    an empty result. Neighbourhoods are never gathered: each star is an aggregate and a join, which adaptive execution splits at hubs.
    Only the number and a checksum of the edges reach the driver.
    """
    now = cut(edges.select(F.col(a).cast("bigint").alias("u"), F.col(b).cast("bigint").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        now = cut(_small_star(_large_star(now)))
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
