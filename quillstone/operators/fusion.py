"""Fusion of retrieval channels: min-max weighted sums, reciprocal ranks, and the candidate pool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = {"structured": 0.35, "dense": 0.40, "bm25": 0.25}


def min_max(score: Column, keys: list[str]) -> Column:
    """Scores of a channel on 0 to 1; a channel of equal scores becomes 1 where they are positive, else 0."""
    w = Window.partitionBy(*keys)
    low, high = F.min(score).over(w), F.max(score).over(w)
    return F.when(high == low, F.when(high > 0, 1.0).otherwise(0.0)).otherwise((score - low) / (high - low))


def hybrid(hits: DataFrame, weights: dict[str, float] = WEIGHTS, top_k: int = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """hits: keys, channel, id, score -> id, score, n_channels, rank. Weights are not rescaled where a channel is missing."""
    keys = list(keys)
    best = hits.groupBy(*keys, "channel", "id").agg(F.max("score").alias("score"))
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("channel"))
    normed = best.withColumn("part", min_max(F.col("score"), [*keys, "channel"]) * F.coalesce(weight, F.lit(1.0)))
    total = normed.groupBy(*keys, "id").agg(F.sum("part").alias("score"), F.count("*").alias("n_channels"))
    return _top(total, top_k, keys)


def reciprocal_ranks(hits: DataFrame, k: float = 60.0, top_k: int = 20, keys: tuple[str, ...] = ()) -> DataFrame:
    """hits: keys, channel, id, rank -> id, score = sum of 1 / (k + rank), n_channels, rank."""
    total = hits.groupBy(*keys, "id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"), F.count("*").alias("n_channels"))
    return _top(total, top_k, list(keys))


def candidate_pool(hits: DataFrame, channels: tuple[str, ...], detail: str, reserve: int = 3, details: int = 5, size: int = 16, k: float = 60.0, keys: tuple[str, ...] = ()) -> DataFrame:
    """id, pool_pos: the first `reserve` of each channel in the order of channels, then the best fused hits of the detail
    channel, then the other fused hits, cut at `size`."""
    keys = list(keys)
    fused = hits.groupBy(*keys, "id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("rrf"), F.min(F.when(F.col("rank") <= reserve, F.nullif(F.array_position(F.array(*map(F.lit, channels)), F.col("channel")), F.lit(0)) * 100 + F.col("rank"))).alias("kept"), F.max((F.col("channel") == detail).cast("int")).alias("is_detail"))
    nth = F.row_number().over(Window.partitionBy(*keys, "lane").orderBy(F.round("rrf", 12).desc(), "id"))
    fused = fused.withColumn("lane", F.when(F.col("kept").isNotNull(), 0).when(F.col("is_detail") == 1, 1).otherwise(2)).withColumn("n", nth)
    fused = fused.withColumn("lane", F.when((F.col("lane") == 1) & (F.col("n") > details), 2).otherwise(F.col("lane")))
    order = Window.partitionBy(*keys).orderBy("lane", F.col("kept").asc_nulls_last(), F.round("rrf", 12).desc(), "id") if keys else Window.orderBy("lane", F.col("kept").asc_nulls_last(), F.round("rrf", 12).desc(), "id")
    return fused.withColumn("pool_pos", F.row_number().over(order)).where(F.col("pool_pos") <= size).select(*keys, "id", "pool_pos", "lane")


def dedupe_hits(hits: DataFrame) -> DataFrame:
    """Per id the hit of largest score and the longest text."""
    return hits.groupBy("id").agg(F.max("score").alias("score"), F.max_by("source", F.struct("score", "source")).alias("source"), F.max_by("text", F.struct(F.length("text"), "text")).alias("text"))


def _top(total: DataFrame, top_k: int, keys: list[str]) -> DataFrame:
    order = [F.round("score", 12).desc(), F.col("id")]
    if keys:
        return total.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top_k)
    best = total.orderBy(*order).limit(top_k)  # few rows; their rank needs one task
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
