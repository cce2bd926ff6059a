"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeep.llm.storage import materialize


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for each node ``a`` that isn't the smallest of its component.

    ``edges`` has long columns a and b in any direction, repeats and loops allowed. In each
    round every node hands its larger neighbours, then its smaller ones, to its smallest
    neighbour; what is left in the end are stars around the smallest nodes. The number of
    rounds grows with the logarithm of the longest path. Neighbours are never gathered:
    a round is a minimum by node, combined before the shuffle, and a join.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    digest = _digest(now)
    while digest[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(least, F.col("a") == F.col("k"))
        handed = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = least.select(F.col("k").alias("a"), F.col("m").alias("b"))
        now = materialize(handed.unionByName(kept).distinct())
        before, digest = digest, _digest(now)
        if digest == before:
            break
    return now.select("a", F.col("b").alias("root"))
