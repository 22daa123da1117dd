"""Connected components of an undirected edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.runtime import cut


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, v, m): the edges with the smallest node of u's neighbourhood, u included."""
    least = edges.groupBy("u").agg(F.min("v").alias("_v"))
    return edges.join(least, "u").withColumn("m", F.least("u", "_v"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _smallest(down)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Alternating large-star and small-star steps; every round ends in a reliable checkpoint, and the rounds, of which there are about as
    many as the logarithm of the nodes, end when the edge set no longer changes. Edges with a null end and loops are left out;
    repeated edges count once; no edges give no rows.
    """
    edges = cut(pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct())
    seen = None
    while True:
        edges = cut(_small_star(_large_star(edges)))
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
