"""Medians of bootstrap resamples without drawing the resamples.

A resample of n values is n uniform draws of positions in their order. Its median needs no draw by itself: halve the range of positions; how many of the c draws in a
range fall into its first half is binomial; go on in the half that holds the wanted rank. That is one binomial number per
halving, keyed by sample and range, so about samples x log n numbers instead of samples x n draws, and any two ranks of a sample agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import HASH_BITS
from ..session import ship_package
from .ordering import bucket_offsets, value_bucket

# Probabilities held at a time: 1M doubles are 8 MB, a few such arrays are in use.
_CELLS = 1 << 20
# Samples of one task row; samples of a group spread over tasks.
_SAMPLES = 100
# Beyond so many standard deviations a binomial has less mass than the spacing of the uniform numbers.
_REACH = 10


def binomial_quantiles(trials: np.ndarray, left: np.ndarray, size: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """For each entry the smallest k whose P(Binomial(trials, left / size) <= k) is above ``uniform``, which is below 1."""
    out = np.empty(len(trials), dtype=np.int64)
    share = left / size
    spread = np.sqrt(trials * share * (1 - share))
    low = np.maximum(0, np.floor(trials * share - _REACH * spread - _REACH)).astype(np.int64)
    top = np.minimum(trials, np.ceil(trials * share + _REACH * spread + _REACH)).astype(np.int64)
    order = np.argsort(top - low, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * (top[order[stop]] - low[order[stop]] + 1) <= _CELLS:
            stop += 1
        mine = order[start:stop]
        start = stop
        k = low[mine, None] + np.arange(int((top - low)[mine].max()) + 1)
        c, p = trials[mine, None], share[mine, None]
        inside = k <= top[mine, None]
        # Each mass from the one before; the first is free since all are divided by their sum.
        with np.errstate(divide="ignore"):
            step = np.log(np.maximum(c - k + 1, 1)) - np.log(np.maximum(k, 1)) + np.log(p) - np.log1p(-p)
        step[:, 0] = 0.0
        logs = np.where(inside, np.cumsum(step, axis=1), -np.inf)
        mass = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
        out[mine] = np.minimum(low[mine] + (mass / mass[:, -1:] <= uniform[mine, None]).sum(axis=1), top[mine])
    return out


def _uniform(keys: list[str]) -> np.ndarray:
    """The keyed uniform numbers that ``functions.hashing`` gives for these texts."""
    digests = b"".join([hashlib.md5(k.encode()).digest()[:8] for k in keys])
    return (np.frombuffer(digests, dtype=">u8") >> np.uint64(4)).astype(np.float64) / float(1 << HASH_BITS)


def drawn_positions(prefix: str, n: int, samples: np.ndarray, rank: int) -> np.ndarray:
    """The position (0 to n - 1) of the draw of this rank in each sample."""
    low, high = np.zeros(len(samples), dtype=np.int64), np.full(len(samples), n, dtype=np.int64)
    draws, ranks = np.full(len(samples), n, dtype=np.int64), np.full(len(samples), rank, dtype=np.int64)
    live = np.flatnonzero(high - low > 1)
    while len(live):
        a, b, c, r = low[live], high[live], draws[live], ranks[live]
        middle = (a + b) // 2
        uniform = _uniform([f"{prefix}|{s}|{x}|{y}" for s, x, y in zip(samples[live].tolist(), a.tolist(), b.tolist())])
        first = binomial_quantiles(c, middle - a, b - a, uniform)
        inside = r < first
        low[live], high[live] = np.where(inside, a, middle), np.where(inside, middle, b)
        draws[live], ranks[live] = np.where(inside, first, c - first), np.where(inside, r, r - first)
        live = live[(high - low)[live] > 1]
    return low


def median_positions(sizes: DataFrame, groups: Sequence[str], count: str, samples: int, seed: int, purpose: str) -> DataFrame:
    """(groups, sample_no, position): for each group and sample the positions whose values' mean is the median; two rows, equal ones too."""
    groups = list(groups)
    ship_package(sizes.sparkSession)
    prefix = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[F.col(g).cast("string") for g in groups]).alias("_prefix")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-samples // _SAMPLES) - 1))).alias("_block")
    asked = sizes.select(*groups, F.col(count).cast("bigint").alias("_n"), prefix, blocks)
    asked = asked.repartition("_prefix", "_block")
    schema = T.StructType([*[asked.schema[g] for g in groups], T.StructField("sample_no", T.LongType()), T.StructField("position", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, names, numbers = (batch.column(len(groups) + i).to_pylist() for i in range(3))
            for i in range(batch.num_rows):
                mine = np.arange(numbers[i] * _SAMPLES, min((numbers[i] + 1) * _SAMPLES, samples), dtype=np.int64)
                found = [drawn_positions(names[i], n[i], mine, rank) for rank in sorted({(n[i] - 1) // 2, n[i] // 2})]
                found = found * 2 if len(found) == 1 else found
                keys = [batch.column(g).slice(i, 1).take(pa.array(np.zeros(2 * len(mine), np.int64))) for g in range(len(groups))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.tile(mine, 2)), pa.array(np.concatenate(found))], names=[f.name for f in schema.fields])

    return asked.mapInArrow(run, schema)


def values_at(cells: DataFrame, groups: Sequence[str], value: str, count: str, wanted: DataFrame, position: str) -> DataFrame:
    """``wanted(groups, position, ...)`` with the value that stands at each position of its group's sorted values.

    ``cells`` has each value of a group once with its count. Only buckets that hold a wanted position are sorted, and of a value's positions only
    those between the group's first and last wanted one become rows; medians of resamples lie within some root of n of each other.
    """
    groups = list(groups)
    span = wanted.groupBy(*groups).agg(F.min(position).alias("_first"), F.max(position).alias("_last"))
    cut = value_bucket(cells, value)
    placed = bucket_offsets(cut, groups, count).join(span, groups).where("_before <= _last and _before + _bc > _first")
    within = Window.partitionBy(*groups, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    low = F.col("_before") + F.coalesce(F.sum(count).over(within), F.lit(0))
    rows = cut.join(placed.select(*groups, "_b", "_before", "_first", "_last"), [*groups, "_b"]).withColumn("_lo", low)
    ranged = rows.select(*groups, value, F.greatest("_lo", "_first").alias("_from"), F.least(F.col("_lo") + F.col(count) - 1, F.col("_last")).alias("_to"))
    spots = ranged.where("_from <= _to").select(*groups, value, F.explode(F.sequence("_from", "_to")).alias(position))
    return wanted.join(spots, [*groups, position])
