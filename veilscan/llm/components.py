"""Connected components of an edge table, on the cluster: large-star and small-star rounds until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.common import settle


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands itself and its smaller neighbours to the least of them. Edges run from larger to smaller here."""
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(least.select("a", F.col("low").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least node reachable) of every node on an edge; edges: two columns of one type, in any direction.

    Nulls and loops are no edges. Each round is written to the shared folder. A node with very many neighbours costs
    partial minima, and a join that Spark splits where it is skewed; after the first rounds only stars are left."""
    x, y = edges.columns
    now = settle(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).where((F.col(x) != F.col(y))).distinct(), "edges")
    before = None
    while (state := _state(now)) != before and state[0]:
        before = state
        now = settle(_small_star(_large_star(now)), "edges")
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
