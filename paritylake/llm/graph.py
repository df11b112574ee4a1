"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, written


def _settled(e: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has just that one, and it has none itself."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, root) for every node of (u, v) rows; the root is the smallest node.

    Every round is written to the shared folder. Minima are written before they are joined,
    so that adaptive execution can split a node with very many neighbours.
    """
    e = written(gathered(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), "edges")
    rounds = 0
    while not _settled(e):
        if rounds == limit:
            raise RuntimeError("the components did not settle")
        rounds += 1
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(gathered(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(gathered(large), "large")
        low = written(gathered(large.groupBy("u").agg(F.min("v").alias("m"))), "low")
        near = large.join(low, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        e = written(gathered(small.where("u <> v").distinct()), "small")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
