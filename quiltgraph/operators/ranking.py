"""Ranks, top-k and reciprocal-rank fusion. Every order ends in a key, so ties are settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.functions.vectors import rrf_term


def top_k(df: DataFrame, group: str | list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group with a one-based rank.

    Spark keeps at most ``k`` rows per group and task before the shuffle, so a
    hot group costs no more than any other.
    """
    group = [group] if isinstance(group, str) else group
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def first_by(df: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """First row per key, rows without an order after all others. Aggregated before the shuffle, so a hot key is no bottleneck."""
    return df.groupBy(key).agg(F.min_by(F.struct(*columns), F.struct(order.isNull(), order)).alias("_r")).select(key, "_r.*")


def last_by(df: DataFrame, key: str | list[str], order: Column, columns: list[str]) -> DataFrame:
    """Last row per key, rows without an order before all others; aggregated the same way."""
    key = [key] if isinstance(key, str) else key
    return df.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(order.isNotNull(), order)).alias("_r")).select(*key, "_r.*")


def fuse_rankings(ranked: DataFrame, group: str, item: str, k: int = 60, keep: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of rows ``group, item, list_no, rank``.

    Output ``group, item, score, rank``; equal scores keep the order of first
    appearance: lower list, then lower rank.
    """
    place = F.col("list_no").cast("long") * F.lit(1 << 32) + F.col("rank")
    scored = ranked.filter(F.col(item).isNotNull()).groupBy(group, item).agg(
        F.sum(rrf_term(F.col("rank"), k)).alias("score"), F.min(place).alias("_first")
    )
    order = [F.desc(F.round("score", 12)), F.asc("_first"), F.asc(item)]
    if keep is None:
        w = Window.partitionBy(group).orderBy(*order)
        return scored.withColumn("rank", F.row_number().over(w)).drop("_first")
    return top_k(scored, group, order, keep).drop("_first")
