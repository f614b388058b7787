"""Connected components of an edge table by alternating star contraction.

Large-star then small-star hooks every node to the smallest neighbour it can see; a
component collapses in a number of rounds that grows with the logarithm of its size, where
plain label propagation needs as many rounds as the longest chain has links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmaforge.session import cut, discard


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    # Larger neighbours are hooked to the smallest one. The minimum is one row per node, so a
    # node with very many neighbours is a skewed join that AQE splits, not a collected group.
    return both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    hooked = down.join(low, "u")
    return (
        hooked.select(F.col("v").alias("u"), F.col("m").alias("v"))
        .union(low.select("u", F.col("m").alias("v")))
        .filter("u <> v")
    )


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Columns ``node``, ``component`` (the smallest node of it) for every node with an edge."""
    now = cut(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    )
    state = None
    while True:
        last, now = now, cut(_small_star(_large_star(now).distinct()).distinct())
        discard(last)
        # Fixed point: the edge set is unchanged. Two sums stand for the set; nothing else
        # leaves the executors.
        seen = now.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if state == tuple(seen):
            break
        state = tuple(seen)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
