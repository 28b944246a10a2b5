"""Connected components by alternating large-star and small-star rounds, each one a pair of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import release, settle


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long), in any direction -> (node, root) for each node that has an edge, root its component's least.

    The number of rounds grows with the logarithm of the longest path; each round's edges are written to the shared
    folder, so lineage stays short. Raises if max_rounds isn't enough, and never returns partial components. Repeated edges
    count once; edges to itself, and edges with a null at either end, are left out; no edges give no rows.
    """
    live = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        both = live.union(live.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        under = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(under, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
        live, before = settle(small, "edges"), live
        release(before)
        now = live.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return live.select(F.col("a").alias("node"), F.col("b").alias("root")).union(live.select("b", "b").distinct())
        seen = now
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
