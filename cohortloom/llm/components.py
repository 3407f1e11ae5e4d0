"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.runtime import settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node reachable) of every node that has an edge.

    Rounds of two star steps: each node's larger neighbours are joined to its least neighbour, then its smaller
    neighbours are. A round keeps the components and makes paths shorter; it ends when every node hangs on its root.
    No step collects a node's neighbours: minima are aggregated before the shuffle and joined back. The number of rounds
    grows with the logarithm of the longest path. Null ends and loops are left out.
    """
    now = settle(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
                 .filter("u <> v").distinct())
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = settle(large)
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(floor.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        now = settle(small)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = tuple(state)
