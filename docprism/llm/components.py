"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docprism.llm.store import drop_materialized, materialize


def _attach_min(pairs: DataFrame) -> DataFrame:
    """``x, y`` plus ``m``, the least ``y`` of each ``x``: partial minima, then a join whose hot keys can be split."""
    least = pairs.groupBy("x").agg(F.min("y").alias("m"))
    return pairs.join(least, "x")


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``, longs): root is its component's least node.

    Alternating large-star and small-star rounds; each ends in a table in the
    shared folder.  Rows never exceed the number of edges, nothing is collected
    but a count and a checksum.
    """
    spark = edges.sparkSession
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("y").alias("x"), F.col("x").alias("y")))
        large = _attach_min(both).where("y > x").select(F.col("y").alias("x"), F.least("m", "x").alias("y")).distinct()
        small = _attach_min(large)
        after = small.select("x", F.col("m").alias("y")).unionByName(small.where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))).distinct()
        after = materialize(after, "stars")
        mark = tuple(after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(20,0)")), F.lit(0)).cast("string")).first())
        drop_materialized(spark, now)
        now = after
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots.unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
