"""Keyed hashes: the one source of randomness, reproducible on any cluster layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS = 60


def hash60(text: Column) -> Column:
    """First 15 hex digits of md5 as a non-negative bigint."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def keyed(seed: int, purpose: str, *keys: Column) -> Column:
    """Text ``seed|purpose|key|...``; the keys must not be null."""
    parts = [F.lit(str(seed)), F.lit(purpose), *[k.cast("string") for k in keys]]
    return F.concat_ws("|", *parts)


def draw60(seed: int, purpose: str, *keys: Column) -> Column:
    return hash60(keyed(seed, purpose, *keys))


def unit_draw(seed: int, purpose: str, *keys: Column) -> Column:
    """Keyed uniform number in [0, 1)."""
    return draw60(seed, purpose, *keys).cast("double") / F.lit(float(1 << HASH_BITS))
