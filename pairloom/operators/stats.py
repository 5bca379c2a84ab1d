"""Latency, throughput and repeat statistics over measured samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .ordering import order_statistics
from .resample import median_positions, values_at

PERCENTS = (50, 95, 99)
# Guards against division by zero; the double machine epsilon.
EPSILON = 2.220446049250313e-16


def latency_nearest_rank(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Mean, min, max and percentiles at rank round((n - 1) p), half away from zero."""
    ranks = {f"p{p}_us": F.floor((F.col("n") - 1) * F.lit(p / 100.0) + 0.5) for p in PERCENTS}
    picked = order_statistics(df, groups, value, ranks)
    simple = df.groupBy(*groups).agg(
        F.avg(value).alias("mean_us"), F.min(value).alias("min_us"), F.max(value).alias("max_us")
    )
    return picked.join(simple, list(groups))


def _interpolated(name: str, fraction: float) -> tuple[dict[str, Column], Column]:
    """Ranks to fetch for one linear percentile, and the value from them."""
    spot = (F.col("n") - 1) * F.lit(fraction)
    low, high = F.floor(spot), F.ceil(spot)
    ranks = {f"_{name}_lo": low, f"_{name}_hi": high}
    lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
    return ranks, (lo + (hi - lo) * (spot - low)).alias(name)


def linear_percentiles(
    df: DataFrame, groups: Sequence[str], value: str, fractions: dict[str, float]
) -> DataFrame:
    """Exact percentiles with linear interpolation between neighbouring ranks."""
    ranks, columns = {}, []
    for name, fraction in fractions.items():
        pair, column = _interpolated(name, fraction)
        ranks |= pair
        columns.append(column)
    return order_statistics(df, groups, value, ranks).select(*groups, "n", *columns)


def latency_linear(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    picked = linear_percentiles(df, groups, value, {f"p{p}_us": p / 100.0 for p in PERCENTS})
    simple = df.groupBy(*groups).agg(F.avg(value).alias("mean_us"), F.max(value).alias("max_us"))
    return picked.join(simple, list(groups))


def throughput(batches: DataFrame, groups: Sequence[str], items: str, elapsed_s: str) -> DataFrame:
    """Items per second and, with each batch's time spread evenly over its items, mean and maximum
    time per item."""
    per_item = F.col(elapsed_s) / F.col(items) * 1e6
    return batches.groupBy(*groups).agg(
        F.sum(items).alias("items"),
        F.sum(elapsed_s).alias("elapsed_s"),
        (F.sum(items) / F.greatest(F.sum(elapsed_s), F.lit(EPSILON))).alias("per_second"),
        (F.sum(F.col(elapsed_s)) * 1e6 / F.sum(items)).alias("mean_item_us"),
        F.max(per_item).alias("max_item_us"),
    )


def repeat_summary(repeats: DataFrame, groups: Sequence[str], repeat: str, metrics: Sequence[str]) -> DataFrame:
    """Median of each metric over the repeats and the list of its values in repeat order.

    ``repeats`` has one row per (group, repeat), so the lists are as long as there are repeats.
    """
    names = list(metrics)
    long = repeats.select(
        *groups,
        repeat,
        F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in names])).alias("_m"),
    ).select(*groups, repeat, "_m.metric", "_m.value")
    keys = [*groups, "metric"]
    medians = linear_percentiles(long, keys, "value", {"median": 0.5})
    lists = long.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(repeat, "value"))).alias("_l"))
    return medians.join(lists, keys).select(
        *keys, F.col("n").alias("repeats"), "median", F.transform("_l", lambda r: r["value"]).alias("all_repeats")
    )


def bootstrap_median_ci(rows: DataFrame, groups: Sequence[str], value: str, samples: int = 3000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """Confidence interval of the median of each group's values from keyed resamples with replacement.

    The resamples are never formed: ``resample`` splits their draws over the sorted values by keyed binomial numbers down to the median. Nulls are
    no values; one value gives (v, v).
    """
    groups = list(groups)
    cells = written(rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_c")), "cells")
    sizes = cells.groupBy(*groups).agg(F.sum("_c").alias("_n"))
    wanted = written(median_positions(sizes, groups, "_n", samples, seed, "bootstrap"), "positions")
    medians = values_at(cells, groups, value, "_c", wanted, "position").groupBy(*groups, "sample_no").agg(F.avg(value).alias("_median"))
    tail = (1.0 - confidence) / 2.0
    bounds = linear_percentiles(medians, groups, "_median", {"ci_low": tail, "ci_high": 1.0 - tail})
    return bounds.withColumnRenamed("n", "samples")


def length_stats(df: DataFrame, groups: Sequence[str], n_words: Column) -> DataFrame:
    return df.groupBy(*groups).agg(
        F.avg(n_words).alias("mean_words"),
        F.min(n_words).cast("bigint").alias("min_words"),
        F.max(n_words).cast("bigint").alias("max_words"),
    )
