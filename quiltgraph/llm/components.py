"""Connected components of edges held in a DataFrame, by alternating large-star and small-star rounds.

Up to ``ONE_TASK`` edges a star takes one shuffle, and a node's edges fit one task whatever they are. Beyond, the smallest
neighbour of a node is an aggregate combined before its shuffle and joined back with salts, so that a node with a third of
all edges is split over tasks. Every round's edges are written to the checkpoint folder: a lost executor costs one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.functions.sizes import cut_lineage, salted_join

SALTS = 16
MOST_ROUNDS = 60
ONE_TASK = 4_000_000


def _star(pairs: DataFrame, few: bool) -> DataFrame:
    """``pairs`` (u, v) with the smallest of u and its v beside each."""
    if few:
        return pairs.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u"))))
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return salted_join(pairs, least, ["u"], SALTS)


def connected(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node with an edge to another.

    Rows with a null end and loops are no edges; direction and repetition do not matter. No edges: no rows.
    """
    pairs = cut_lineage(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct())
    before = None
    for _ in range(MOST_ROUNDS):
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            break
        before, few = state, state[0] <= one_task
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, few).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _star(large, few)
        small = small.select("v", "m").filter("v != m").unionByName(small.select(F.col("u").alias("v"), "m"))
        pairs = cut_lineage(small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = pairs.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
