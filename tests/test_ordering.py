from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions.hashing import draw60
from pairloom.operators import negatives, ordering, pairs, passages, stats


def test_hash_index_is_dense_and_in_hash_order(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    rows = ordering.hash_index(df, 7, "p", ["k"]).withColumn("h", draw60(7, "p", F.col("k"))).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(1000))
    assert [r["h"] for r in rows] == sorted(r["h"] for r in rows)


@pytest.mark.parametrize("n", [1, 3, 500, 999, 1000, 1500])
def test_both_sampling_ways_agree(spark, n):
    df = spark.range(1000).withColumnRenamed("id", "k")
    small = {r["k"] for r in ordering.sample_capped(df, n, 5, "s", ["k"]).collect()}
    large = {r["k"] for r in ordering._sample_by_threshold(df, n, 5, "s", ["k"]).collect()}
    assert small == large and len(small) == min(n, 1000)


def test_sample_is_reproducible_and_zero_means_all(spark):
    df = spark.range(8).withColumnRenamed("id", "k")
    first, second = ([r["k"] for r in ordering.sample_capped(df, 3, 42, "s", ["k"]).collect()] for _ in range(2))
    assert first == second and len(set(first)) == 3
    assert ordering.sample_capped(df, 0, 42, "s", ["k"]).count() == 8


def test_prefix_offsets_match_cumulative_sums(spark):
    rng = np.random.default_rng(1)
    keys, weights = rng.permutation(500) * 3, rng.integers(0, 9, 500)
    df = spark.createDataFrame([(int(k), int(w)) for k, w in zip(keys, weights)], "k long, w long")
    got = {r["k"]: r["offset"] for r in ordering.prefix_offsets(df, "k", "w").collect()}
    order = np.argsort(keys)
    want = dict(zip(keys[order].tolist(), (np.cumsum(weights[order]) - weights[order]).tolist()))
    assert got == want


@pytest.mark.parametrize("spread", ["unique", "ties", "one value"])
def test_percentiles_match_numpy_with_a_hot_group(spark, spread):
    rng = np.random.default_rng(3)
    make = {"unique": lambda n: rng.normal(size=n), "ties": lambda n: rng.integers(0, 5, n).astype(float), "one value": lambda n: np.full(n, 2.5)}[spread]
    groups = {"hot": make(2000), "cold": make(7), "single": make(1)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    linear = {r["g"]: r for r in stats.latency_linear(df, ["g"], "v").collect()}
    nearest = {r["g"]: r for r in stats.latency_nearest_rank(df, ["g"], "v").collect()}
    for g, values in groups.items():
        ordered = np.sort(values)
        for p in (50, 95, 99):
            assert linear[g][f"p{p}_us"] == pytest.approx(np.percentile(values, p), abs=1e-12)
            assert nearest[g][f"p{p}_us"] == ordered[int(np.floor((len(ordered) - 1) * (p / 100) + 0.5))]
        assert linear[g]["n"] == len(values)


def test_nearest_rank_is_not_interpolated(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4)], "g string, v double")
    assert stats.latency_nearest_rank(df, ["g"], "v").first()["p95_us"] == 4.0


def test_bootstrap_of_one_value_and_of_many(spark):
    df = spark.createDataFrame([("one", 0, 5.0)] + [("many", i, float(i)) for i in range(9)], "g string, i long, v double")
    got = {r["g"]: r for r in stats.bootstrap_median_ci(df, ["g"], "v", samples=200, seed=4).collect()}
    assert (got["one"]["ci_low"], got["one"]["ci_high"]) == (5.0, 5.0)
    assert 0 <= got["many"]["ci_low"] <= 4 <= got["many"]["ci_high"] <= 8


def test_duplicates_count_minus_one_also_in_slices(spark, monkeypatch):
    monkeypatch.setattr(pairs, "COPY_SLICE", 4)
    texts = ["a"] * 14 + ["b"] * 5 + ["c"] * 2 + ["d"]
    df = spark.createDataFrame([(t,) for t in texts], "clean string")
    got = pairs.duplicate_pairs(df).collect()
    assert sorted((r["anchor"], r["copy"]) for r in got) == [("a", i) for i in range(1, 14)] + [("b", i) for i in range(1, 5)] + [("c", 1)]
    assert sorted(r["anchor"] for r in pairs.duplicate_pairs_distinct(df).collect()) == ["a", "b", "c"]


def test_rejection_redraws_and_drops(spark):
    found = spark.createDataFrame([(str(i), f"t{i % 3}", f"t{(i + 1) % 3}") for i in range(60)], "pkey string, anchor string, positive string")
    pool = negatives.index_pool(spark.createDataFrame([("t0",), ("t1",), ("t2",)], "negative string"), 1)
    redrawn = negatives.draw_rejecting(found, pool, 9, ["pkey"]).collect()
    assert len(redrawn) == 60
    assert all(r["negative"] not in (r["anchor"], r["positive"]) for r in redrawn)
    assert 0 < negatives.draw_single(found, pool, 9, ["pkey"]).count() < 60
    hopeless = negatives.index_pool(spark.createDataFrame([("t0",), ("t1",)], "negative string"), 1)
    assert negatives.draw_rejecting(found.where("anchor = 't0'"), hopeless, 9, ["pkey"]).count() == 0


def test_cycle_and_chunks(spark):
    df = spark.createDataFrame([(i, f"p{i}") for i in range(7)], "idx long, text string")
    got = {r["position"]: r["text"] for r in passages.cycle_texts(df, "idx", 7, 17).collect()}
    assert got == {i: f"p{i % 7}" for i in range(17)}
    assert {r["position"] for r in passages.cycle_texts(df, "idx", 7, 3).collect()} == {0, 1, 2}
    batches = passages.chunk_rows(df, "idx", 3).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in batches] == [3, 3, 1]
