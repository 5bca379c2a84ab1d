"""Positions, samples and exact order statistics without a global single-task sort.

All of them work in two levels: rows fall into buckets of bounded share, the small per-bucket
counts give each bucket its offset, and only rows of one bucket are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import HASH_BITS, draw60
from ..session import materialize

# 65,536 hash buckets: the offset table stays near one megabyte at any data size.
_HASH_BUCKET_BITS = 16
_MAX_VALUE_BUCKETS = 4096
# Up to this many rows a per-task top-n is cheaper than a counting pass.
TAKE_LIMIT = 10_000


def _running(column: str, order: str) -> Column:
    """Sum over all earlier buckets; only ever used on the bounded bucket table."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(column).over(w), F.lit(0))


def _hashed(df: DataFrame, seed: int, purpose: str, keys: Sequence[str]) -> DataFrame:
    h = draw60(seed, purpose, *[F.col(k) for k in keys])
    return df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", HASH_BITS - _HASH_BUCKET_BITS))


def hash_index(df: DataFrame, seed: int, purpose: str, keys: Sequence[str], name: str = "idx") -> DataFrame:
    """Dense zero-based position of each row in keyed-hash order.

    ``keys`` must identify a row, so the hash spreads rows evenly and no bucket can be hot.
    """
    return index_hashed(df.withColumn("_h", draw60(seed, purpose, *[F.col(k) for k in keys])), keys, name)


def index_hashed(df: DataFrame, ties: Sequence[str], name: str = "idx") -> DataFrame:
    """``hash_index`` of rows that bring their hash along as ``_h``; ``ties`` order rows of one hash."""
    hashed = df.withColumn("_b", F.shiftright("_h", HASH_BITS - _HASH_BUCKET_BITS))
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_b", _running("_n", "_b").alias("_before"))
    within = Window.partitionBy("_b").orderBy("_h", *ties)
    return (
        hashed.join(F.broadcast(offsets), "_b")
        .withColumn(name, F.col("_before") + F.row_number().over(within) - 1)
        .drop("_b", "_h", "_before")
    )


def sample_capped(df: DataFrame, n: int, seed: int, purpose: str, keys: Sequence[str]) -> DataFrame:
    """Uniform sample of at most n rows without replacement; n <= 0 keeps all rows.

    The sample is the n smallest keyed hashes. A small n uses the per-task top-n operator; a large
    one finds the bucket that holds the n-th hash and ranks only that bucket.
    """
    if n <= 0:
        return df
    if n <= TAKE_LIMIT:
        hashed = df.withColumn("_h", draw60(seed, purpose, *[F.col(k) for k in keys]))
        return hashed.orderBy("_h", *keys).limit(n).drop("_h")
    return _sample_by_threshold(df, n, seed, purpose, keys)


def _sample_by_threshold(df: DataFrame, n: int, seed: int, purpose: str, keys: Sequence[str]) -> DataFrame:
    hashed = _hashed(df, seed, purpose, keys)
    sizes = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    edge = (
        sizes.select("_b", "_n", _running("_n", "_b").alias("_before"))
        .where((F.col("_before") < n) & (F.col("_before") + F.col("_n") >= n))
        .select("_b", (n - F.col("_before")).alias("_room"))
    )
    edge_bucket, room = edge.select("_b").scalar(), edge.select("_room").scalar()
    sure = hashed.where(F.coalesce(F.col("_b") < edge_bucket, F.lit(True)))
    within = Window.partitionBy("_b").orderBy("_h", *keys)
    rim = (
        hashed.where(F.col("_b") == edge_bucket)
        .withColumn("_r", F.row_number().over(within))
        .where(F.col("_r") <= room)
        .drop("_r")
    )
    return sure.unionByName(rim).drop("_h", "_b")


def value_bucket(df: DataFrame, column: str, name: str = "_b") -> DataFrame:
    """Add a bucket number that rises with ``column`` and holds a bounded share of the rows.

    The bounds are approximate quantiles, but they only decide the split of the work; everything
    computed on top is exact. At most 4,096 bounds reach the driver.
    """
    spark = df.sparkSession
    wanted = min(_MAX_VALUE_BUCKETS, max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    probs = [i / wanted for i in range(1, wanted)]
    numeric = df.withColumn("_v", F.col(column).cast("double"))
    bounds = sorted(set(numeric.approxQuantile("_v", probs, 1.0 / (4 * wanted))))
    splits = [float("-inf"), *bounds, float("inf")]
    if len(splits) < 3:
        return df.withColumn(name, F.lit(0))
    cut = Bucketizer(splits=splits, inputCol="_v", outputCol="_f", handleInvalid="keep").transform(numeric)
    return cut.withColumn(name, F.col("_f").cast("int")).drop("_v", "_f")


def prefix_offsets(df: DataFrame, key: str, weight: str | None = None, name: str = "offset") -> DataFrame:
    """Add the total weight of all rows with a smaller ``key``; a unique numeric key and weight 1
    make it the dense zero-based position."""
    weighted = df.withColumn("_w", F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint"))
    cut = value_bucket(weighted, key)
    sizes = cut.groupBy("_b").agg(F.sum("_w").alias("_n"))
    offsets = sizes.select("_b", _running("_n", "_b").alias("_before"))
    within = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.join(F.broadcast(offsets), "_b")
        .withColumn(name, F.col("_before") + F.coalesce(F.sum("_w").over(within), F.lit(0)))
        .drop("_b", "_w", "_before")
    )


def bucket_offsets(cut: DataFrame, groups: Sequence[str], count: str) -> DataFrame:
    """(groups, _b, _bc, _before, n): rows in each bucket, before it and in the whole group; at most 4,096 buckets a group."""
    sizes = cut.groupBy(*groups, "_b").agg(F.sum(count).alias("_bc"))
    by_group = Window.partitionBy(*groups)
    earlier = by_group.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(*groups, "_b", "_bc", F.coalesce(F.sum("_bc").over(earlier), F.lit(0)).alias("_before"), F.sum("_bc").over(by_group).alias("n"))


def order_statistics(
    df: DataFrame, groups: Sequence[str], value: str, ranks: dict[str, Column]
) -> DataFrame:
    """Exact values at given zero-based ranks per group.

    ``ranks`` maps an output column to a rank expression over the group size column ``n``. Equal
    values are counted together first; then per-bucket counts tell which bucket holds each rank and
    only those buckets are sorted. A group with a third of all rows still spreads over the buckets.
    """
    groups = list(groups)
    # Read three times below (bounds, counts, chosen buckets), so it is written once.
    cells = materialize(df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count("*").alias("_c")))
    cut = value_bucket(cells, value)
    placed = bucket_offsets(cut, groups, "_c")
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("_name"), r.cast("bigint").alias("_rank")) for k, r in ranks.items()]))
    hits = (
        placed.withColumn("_pick", wanted)
        .select("*", "_pick._name", "_pick._rank")
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_bc")))
        .groupBy(*groups, "_b", "_before", "n")
        .agg(F.collect_list(F.struct("_name", "_rank")).alias("_picks"))
    )
    in_bucket = Window.partitionBy(*groups, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    found = (
        cut.join(hits, [*groups, "_b"])
        .withColumn("_lo", F.col("_before") + F.coalesce(F.sum("_c").over(in_bucket), F.lit(0)))
        .select(*groups, "n", value, F.explode(F.expr("filter(_picks, p -> p._rank >= _lo and p._rank < _lo + _c)")).alias("_p"))
    )
    return found.groupBy(*groups, "n").agg(
        *[F.max(F.when(F.col("_p._name") == k, F.col(value))).alias(k) for k in ranks]
    )
