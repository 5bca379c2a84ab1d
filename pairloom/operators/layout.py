"""Helpers that shape partitions and keep costly expressions single."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_LIMIT_BYTES = 128 << 20


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a small input over the free cores before CPU-heavy work.

    A table of few files gives fewer tasks than cores; a large one already has many splits and
    passes through without any shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # Counted in the JVM: a large table's file names must not travel to Python.
    files = len(df._jdf.inputFiles())
    return df.repartition(cores) if 0 < files < cores else df


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that later filters cannot copy.

    The optimizer moves a filter below a projection by repeating the projected expression, which
    would run a regex chain several times per row; it does not do so through a generator.
    """
    packed = F.struct(*[c.alias(n) for n, c in columns.items()])
    rest = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(packed)))


def broadcast_within(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint only where rows x row_bytes is known to be small; else the planner decides."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT_BYTES else df
