"""Connected components by alternating large-star and small-star rounds on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import written


def _smallest(e: DataFrame) -> DataFrame:
    """For each u: the smallest of its neighbours and itself."""
    return e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str, b: str, name: str = "components") -> DataFrame:
    """node, component (the smallest node that can be reached), for every node of an edge.

    Nodes of any ordered type. Both star rounds reduce neighbours to their minimum before
    they are joined back, so a hub is a key of a split join, never a list. Each pair of
    rounds is written to the shared folder; the number of rounds grows with the logarithm of
    the longest path. Loops and nulls are left out; no edge gives an empty table.
    """
    e = (edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
         .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v"))).distinct())
    e = written(e, name)
    before = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (both.join(_smallest(both), "u").filter("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct())
        low = _smallest(large)
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v")))
                 .filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        e = written(small, name)
        # A round that changes nothing has stars only; the sum of hashes tells a changed edge set.
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
