"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, release


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, comp) for every node of the edges (a, b); comp is the component's smallest node.

    Each step links nodes to the smallest neighbour only, which takes about log n rounds; every round is written to the shared folder.
    Edges and labels stay distributed: the driver reads a count and a checksum of each round.
    """
    now = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    seen = None
    for _ in range(most):
        # large star: neighbours that are larger than u go to the smallest of u and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v"))
        # small star: u and its smaller neighbours go to the smallest of them
        large = cut(large.where("u != v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).union(least.select("u", F.col("w").alias("v")))
        before, now = now, cut(small.where("u != v").distinct(), "edges")
        release(before, large)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or seen == tuple(state):
            break
        seen = tuple(state)
    else:
        raise RuntimeError("components did not settle")
    out = now.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(now.select(F.col("v").alias("node"), F.col("v").alias("comp"))).distinct()
    out._scratch = now._scratch
    return out
