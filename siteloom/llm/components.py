"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join, so that no node's neighbours are gathered in one task: the minimum combines
before the shuffle, and the join's skewed side can be split by adaptive execution. The number of rounds grows with the
logarithm of the graph's size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import Stage


def components(edges: DataFrame, stage: Stage, max_rounds: int = 60) -> DataFrame:
    """From edges (u, v) of longs, rows (node, root) for every node but the roots; root is the smallest node reachable."""
    edge = F.when(F.col("u") > F.col("v"), F.struct("u", "v")).otherwise(F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    now = stage.put(edges.filter("u <> v").select(edge.alias("e")).select("e.u", "e.v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).head()
        if tuple(state) == before or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(state)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        rest = large.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stage.put(rest.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "round")
        stage.drop(now)
        now = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
