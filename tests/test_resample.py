"""Medians of resamples by splitting draws, against draws counted one by one and against real resamples."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from pairloom.operators import resample, stats


def quantile_plain(c, left, size, u):
    total, p = Fraction(0), Fraction(left, size)
    for k in range(c + 1):
        total += math.comb(c, k) * p**k * (1 - p) ** (c - k)
        if total > Fraction(u):
            return k
    return c


def uniform_plain(key):
    return int(hashlib.md5(key.encode()).hexdigest()[:15], 16) / float(1 << 60)


def sorted_draws(prefix, n, sample):
    """All draws of a sample, split down to single positions."""
    out = []

    def split(low, high, draws):
        if high - low == 1:
            out.extend([low] * draws)
        elif draws:
            middle = (low + high) // 2
            first = quantile_plain(draws, middle - low, high - low, uniform_plain(f"{prefix}|{sample}|{low}|{high}"))
            split(low, middle, first)
            split(middle, high, draws - first)

    split(0, n, n)
    return out


def test_quantiles_of_binomials():
    rng = np.random.default_rng(1)
    rows = [(int(c), int(a), int(a + b), float(u)) for c, a, b, u in zip(rng.integers(1, 60, 300), rng.integers(1, 9, 300), rng.integers(1, 9, 300), rng.random(300))]
    got = resample.binomial_quantiles(*[np.array(x) for x in zip(*rows)])
    assert got.tolist() == [quantile_plain(*r) for r in rows]
    ends = resample.binomial_quantiles(np.array([5, 5]), np.array([1, 1]), np.array([2, 2]), np.array([0.0, 1 - 2**-53]))
    assert ends.tolist() == [0, 5]
    many = resample.binomial_quantiles(np.full(4000, 10**7), np.full(4000, 1), np.full(4000, 2), (np.arange(4000) + 0.5) / 4000)
    assert (np.diff(many) >= 0).all() and abs(many.mean() - 5e6) < 1 and abs(many.std() - math.sqrt(10**7) / 2) < 2


def test_positions_are_those_of_the_drawn_ranks():
    for n in (1, 2, 3, 4, 7, 20, 33):
        for rank in {0, (n - 1) // 2, n // 2, n - 1}:
            got = resample.drawn_positions("9|x|g", n, np.arange(25), rank)
            assert got.tolist() == [sorted_draws("9|x|g", n, s)[rank] for s in range(25)]


def test_interval_equals_the_split_draws(spark):
    values = {"a": [1.0, 5.0, 5.0, 7.0, 2.0, 2.5], "b": [3.0], "c": [float(i % 5) for i in range(40)]}
    rows = [(g, v, "x") for g, vs in values.items() for v in vs] + [("b", None, "x")]
    got = {r.g: r for r in stats.bootstrap_median_ci(spark.createDataFrame(rows, "g string, v double, position string"), ["g"], "v", 300, 0.9, 3).collect()}
    for g, vs in values.items():
        ordered = np.sort(vs)
        medians = [np.median(ordered[sorted_draws(f"3|bootstrap|{g}", len(vs), s)]) for s in range(300)]
        want = np.quantile(medians, [0.05, 0.95])
        assert got[g].samples == 300 and np.allclose([got[g].ci_low, got[g].ci_high], want, atol=1e-9), g


def test_interval_agrees_with_real_resamples(spark):
    rng = np.random.default_rng(7)
    values = rng.gamma(2.0, 10.0, 601)
    got = stats.bootstrap_median_ci(spark.createDataFrame([("g", float(v)) for v in values], "g string, v double"), ["g"], "v", 3000).first()
    real = np.quantile(np.median(rng.choice(values, (4000, 601)), axis=1), [0.025, 0.975])
    assert abs(got.ci_low - real[0]) < 0.5 and abs(got.ci_high - real[1]) < 0.5
    assert stats.bootstrap_median_ci(spark.createDataFrame([], "g string, v double"), ["g"], "v", 50).count() == 0


def test_ten_million_values(spark):
    big = spark.range(10_000_000).select(F.lit("g").alias("g"), F.pmod(F.col("id") * 48271, F.lit(10_000_000)).cast("double").alias("v"))
    got = stats.bootstrap_median_ci(big, ["g"], "v", 300).first()
    # The median of n uniform draws has a standard deviation of half a root of n.
    assert abs((got.ci_low + got.ci_high) / 2 - 5e6) < 600 and 4000 < got.ci_high - got.ci_low < 8500
