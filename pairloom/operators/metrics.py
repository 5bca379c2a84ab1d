"""Judging vectors and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def triplet_metrics(scored: DataFrame, weight: str | None = None) -> DataFrame:
    """Accuracy (strict), mean similarities and margin from (positive_sim, negative_sim) rows, each
    counted ``weight`` times; no rows give zeros."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    mean_or_zero = lambda c: F.coalesce(F.sum(c * w) / F.sum(w), F.lit(0.0))
    win = F.when(F.col("positive_sim") > F.col("negative_sim"), 1.0).otherwise(0.0)
    means = scored.agg(
        mean_or_zero(win).alias("triplet_accuracy"),
        mean_or_zero(F.col("positive_sim")).alias("mean_positive_similarity"),
        mean_or_zero(F.col("negative_sim")).alias("mean_negative_similarity"),
    )
    margin = F.col("mean_positive_similarity") - F.col("mean_negative_similarity")
    return means.withColumn("mean_margin", margin)


def score_triplets(vectors: DataFrame, *keep: str) -> DataFrame:
    """Similarities of (anchor, positive, negative) vector columns."""
    return vectors.select(
        *keep,
        V.dot(F.col("anchor"), F.col("positive")).alias("positive_sim"),
        V.dot(F.col("anchor"), F.col("negative")).alias("negative_sim"),
    )


def _log2(c: Column) -> Column:
    return F.log2(c.cast("double"))


def ir_metrics_per_query(ranked: DataFrame, totals: DataFrame, query: str, k: int = 10) -> DataFrame:
    """ndcg, map, recall and mrr at k per query.

    ``ranked`` has (query, rank, relevant 0/1); ``totals`` has (query, total_relevant). Queries
    without a relevant row are left out.
    """
    top = ranked.where(F.col("rank") <= k)
    so_far = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = top.withColumn("hits", F.sum("relevant").over(so_far))
    found = hits.groupBy(query).agg(
        F.sum(F.col("relevant") / _log2(F.col("rank") + 1)).alias("dcg"),
        F.sum(F.col("relevant") * F.col("hits") / F.col("rank")).alias("precision_sum"),
        F.sum("relevant").alias("found"),
        F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first"),
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(k).cast("bigint"), F.col("total_relevant"))),
        F.lit(0.0),
        lambda acc, i: acc + F.lit(1.0) / _log2(i + 1),
    )
    joined = totals.where(F.col("total_relevant") > 0).join(found, query, "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        query,
        zero(F.col("dcg") / ideal).alias(f"ndcg_at_{k}"),
        zero(F.col("precision_sum") / F.col("total_relevant")).alias(f"map_at_{k}"),
        zero(F.col("found") / F.col("total_relevant")).alias(f"recall_at_{k}"),
        zero(F.lit(1.0) / F.col("first")).alias(f"mrr_at_{k}"),
    )


def ir_metrics(per_query: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    names = [c for c in per_query.columns if "_at_" in c]
    return per_query.groupBy(*by).agg(F.count("*").alias("queries"), *[F.avg(c).alias(c) for c in names])


def leaderboard(scores: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Runs x tasks with the mean over the tasks a run has; ``tasks`` fixes the columns."""
    wide = scores.groupBy("run").pivot("task", list(tasks)).agg(F.first("main_score"))
    present = [F.when(F.col(f"`{t}`").isNull(), 0.0).otherwise(1.0) for t in tasks]
    total = sum((F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) for t in tasks), F.lit(0.0))
    return wide.withColumn("mean_score", total / sum(present, F.lit(0.0)))
