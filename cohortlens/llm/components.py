"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouping and a join; nothing is collected. Edges shrink to one star per
component in a number of rounds that grows with the logarithm of the longest path. A hot
node's edges are pre-aggregated to one minimum and its join partition is split by AQE. The
edges of each round are a written table, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.sources.sinks import materialize, release


def _state(edges: DataFrame) -> tuple:
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count(F.lit(1)), digest).first())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) from undirected edges (a, b): the smallest node reachable, for every node of
    an edge that is not itself the root. Loops, repeated edges and null ends are ignored."""
    e = (edges.filter(F.col("a") != F.col("b"))
         .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = materialize(e, "edges")
    state = _state(e)
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u hang on the smallest node around u
        large = (both.filter(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # small star: u and its smaller neighbours hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(F.col("u") != F.col("v"))
        before, e = e, materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(before)
        after = _state(e)
        if after == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = after
    raise RuntimeError("components did not settle")
