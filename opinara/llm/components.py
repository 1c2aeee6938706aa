"""Connected components of a large graph by alternating star steps, as DataFrame joins.

Each round links every node's larger neighbours to its smallest neighbour (large star),
then its smaller neighbours to the smallest of them (small star). Edges of the next round
are at most as many as before, and rounds are about the logarithm of the longest path. Each
round is checkpointed, so no lineage grows and lost executors only repeat a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import checkpoint


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    met = both.join(least, both["u"] == least["k"])
    if large:
        out = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of edges (u, v), but for the smallest ones themselves, which name their components."""
    edges = checkpoint(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == seen or not now["n"]:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        seen = now
        edges = checkpoint(_star(_star(edges, True), False))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
