"""Connected components by alternating stars, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import stored


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes that have an edge to another node; a component's name is its smallest node.

    In each round every node hands its larger neighbours to its smallest one, then its smaller ones. Edges never grow in number, and the
    rounds are few (about the logarithm of the longest path). Each round is written to the shared folder, which ends its lineage. Nulls
    and loops are ignored; repeated edges count once.
    """
    u, v = F.col("u"), F.col("v")
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = stored(now, "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where(v > u).join(least, "u").select(v.alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(v == F.col("m"), u).otherwise(v).alias("u"), F.col("m").alias("v")).distinct()
        now = stored(small, "edges")
        got = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == mark:
            return now.select(u.alias("node"), v.alias("component")).unionByName(now.select(v.alias("node"), v.alias("component")).distinct())
        mark = got
