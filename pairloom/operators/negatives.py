"""Drawing a negative text per pair from a pool, by keyed index draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import draw60
from .ordering import hash_index


def index_pool(pool: DataFrame, seed: int, column: str = "negative") -> DataFrame:
    """Distinct pool texts with a dense index in keyed-hash order."""
    return hash_index(pool.select(column).distinct(), seed, "pool", [column], "pool_idx")


def pool_hash(text: Column, seed: int) -> Column:
    """The hash that orders a pool's texts."""
    return draw60(seed, "pool", text)


def _draw_index(size, seed: int, keys: Sequence[str], attempt):
    return F.pmod(draw60(seed, "draw", *[F.col(k) for k in keys], attempt), size)


def _collides():
    return (F.col("negative") == F.col("anchor")) | (F.col("negative") == F.col("positive"))


def draw_single(pairs: DataFrame, indexed_pool: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """One draw per pair; colliding rows are lost."""
    size = indexed_pool.select(F.count("*")).scalar()
    drawn = pairs.withColumn("pool_idx", _draw_index(size, seed, keys, F.lit(0)))
    return drawn.join(indexed_pool, "pool_idx").where(~_collides()).drop("pool_idx")


def draw_rejecting(pairs: DataFrame, indexed_pool: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """A uniform draw that is neither anchor nor positive; a row is dropped only if the pool holds nothing else.

    Nearly all rows are done after one equi-join on a uniform index. Only those that collide look up which
    entries are forbidden to them, at most two, and draw among the others by stepping over those.
    """
    size = indexed_pool.select(F.count("*")).scalar()
    first = pairs.withColumn("pool_idx", _draw_index(size, seed, keys, F.lit(0))).join(indexed_pool, "pool_idx")
    kept = first.where(~_collides()).drop("pool_idx")
    again = first.where(_collides()).drop("pool_idx", "negative")
    for role in ("anchor", "positive"):
        at = indexed_pool.select(F.col("negative").alias(role), F.col("pool_idx").alias(f"_at_{role}"))
        again = again.join(at, role, "left")
    same = F.col("_at_anchor") == F.col("_at_positive")
    low = F.least("_at_anchor", "_at_positive")
    high = F.when(F.col("_at_anchor").isNotNull() & F.col("_at_positive").isNotNull() & ~same, F.greatest("_at_anchor", "_at_positive"))
    room = size - F.when(high.isNotNull(), 2).otherwise(1)
    drawn = again.select("*", low.alias("_low"), high.alias("_high"), room.alias("_room")).where(F.col("_room") > 0)
    step = drawn.withColumn("pool_idx", _draw_index(F.col("_room"), seed, keys, F.lit(1)))
    step = step.withColumn("pool_idx", F.col("pool_idx") + F.when(F.col("pool_idx") >= F.col("_low"), 1).otherwise(0))
    step = step.withColumn("pool_idx", F.col("pool_idx") + F.when(F.col("pool_idx") >= F.col("_high"), 1).otherwise(0))
    redrawn = step.join(indexed_pool, "pool_idx").select(*pairs.columns, "negative")
    return kept.select(*pairs.columns, "negative").unionByName(redrawn)
