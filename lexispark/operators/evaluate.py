"""Measures of rankings: precision at k, mean reciprocal rank, agreement of two result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def precision_at_k(found: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision) of ranked rows (query_id, doc_key, rank); `relevant` has query_id, doc_key or doc_key alone."""
    keys = ["query_id", "doc_key"] if "query_id" in relevant.columns else ["doc_key"]
    marked = found.where(F.col("rank") <= k).join(relevant.select(*keys).distinct().withColumn("hit", F.lit(1)), keys, "left")
    return marked.groupBy("query_id").agg((F.count("hit") / F.lit(float(k))).alias("precision"))


def reciprocal_rank(found: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rr): one over the first relevant rank, 0 without one."""
    keys = ["query_id", "doc_key"] if "query_id" in relevant.columns else ["doc_key"]
    hits = found.where(F.col("rank") <= k).join(relevant.select(*keys).distinct(), keys, "left_semi")
    best = hits.groupBy("query_id").agg((F.lit(1.0) / F.min("rank")).alias("rr"))
    return found.select("query_id").distinct().join(best, "query_id", "left").select("query_id", F.coalesce("rr", F.lit(0.0)).alias("rr"))


def compare_ranks(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two lists (query_id, rank, score) side by side; `gap` is null where one list is shorter."""
    right = b.select("query_id", "rank", F.col("score").alias("score_b"))
    both = a.select("query_id", "rank", F.col("score").alias("score_a")).join(right, ["query_id", "rank"], "full_outer")
    return both.withColumn("gap", F.abs(F.col("score_a") - F.col("score_b")))
