"""Distributed connected components by alternating large and small stars (Kiveris et al. 2014), DataFrame operations only.

Every round is an aggregate to the smallest neighbour and a join back, so a node with very many neighbours is pre-aggregated
before the shuffle and split by the adaptive skew join after it. Rounds are written to the shared folder: lineage stays
short and a lost executor costs one round. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.select(F.col("child").alias("n"), F.col("parent").alias("m")).unionByName(
        pairs.select(F.col("parent").alias("n"), F.col("child").alias("m")))
    low = both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low"))
    return both.join(low, "n").where("m > n").select(F.col("m").alias("child"), F.col("low").alias("parent"))


def _small_star(pairs: DataFrame) -> DataFrame:
    low = pairs.groupBy("child").agg(F.min("parent").alias("low"))
    down = pairs.join(low, "child").where("parent <> low").select(F.col("parent").alias("child"), F.col("low").alias("parent"))
    return down.unionByName(low.select("child", F.col("low").alias("parent"))).distinct()


def _all_stars(pairs: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child."""
    ends = pairs.select(F.col("child").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        pairs.select(F.col("parent").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node that can be reached.

    Null ends and loops are no edges; repeated edges count once; no edges give no rows.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("child"), F.least("a", "b").alias("parent")).distinct()
    pairs = materialize(pairs, f"{name}-edges")
    while not _all_stars(pairs):
        pairs = materialize(_small_star(_large_star(pairs)), f"{name}-stars")
    roots = pairs.select("parent").distinct()
    return pairs.select(F.col("child").alias("node"), F.col("parent").alias("root")).unionByName(
        roots.select(F.col("parent").alias("node"), F.col("parent").alias("root")))
