"""Combining ranked lists (query_id, list_id, rank, doc_id, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

K = 60


def lists(**ranked: DataFrame) -> DataFrame:
    """Ranked lists, one below the other, named by list_id."""
    named = [df.select("query_id", F.lit(n).alias("list_id"), "rank", "doc_id", "score") for n, df in ranked.items()]
    return reduce(DataFrame.unionByName, named)


def rrf(ranked: DataFrame, k: int = K, zero_based: bool = False) -> DataFrame:
    """Reciprocal rank fusion: query_id, doc_id, score."""
    place = F.col("rank") - 1 if zero_based else F.col("rank")
    return ranked.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + place)).alias("score"))


def rrf_normalized(ranked: DataFrame, n_lists: int, k: int = K) -> DataFrame:
    """Divided by the score of a document that every list has first."""
    return rrf(ranked, k).withColumn("score", F.col("score") / (n_lists / (k + 1.0)))


def with_ranks(ranked: DataFrame, names: list[str], k: int = K) -> DataFrame:
    """The fused score and the rank in each list, null where a list lacks the document."""
    ranks = [F.min(F.when(F.col("list_id") == n, F.col("rank"))).alias(f"rank_{n}") for n in names]
    return ranked.groupBy("query_id", "doc_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), *ranks)


def minmax(score: Column, *by: str) -> Column:
    """Scaled to 0..1 within a group; 0 where all are equal."""
    w = W.partitionBy(*by)
    span = F.max(score).over(w) - F.min(score).over(w)
    return (score - F.min(score).over(w)) / F.when(span == 0, F.lit(1.0)).otherwise(span)


def ensemble(ranked: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted sum of scores that are scaled within each list; a list that lacks a document gives it 0."""
    scaled = ranked.withColumn("s", minmax(F.col("score"), "query_id", "list_id"))
    weight = reduce(lambda c, n: c.when(F.col("list_id") == n, F.lit(weights[n])), weights, F)
    return scaled.groupBy("query_id", "doc_id").agg(F.sum(F.col("s") * weight).alias("score"))
