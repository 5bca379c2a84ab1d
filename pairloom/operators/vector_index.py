"""Exact top-k over clustered vectors: clusters whose bound cannot reach a query's k-th score are left out.

Scores are dot products (a cosine is one of unit vectors). Of a cluster with centre c and radius r no row scores more than q.c + |q| r for a
query q, by Cauchy and Schwarz. Every row is indexed: it goes to the nearest of at most ``MAX_CELLS`` centres, which are fitted on a sample of at most
``SAMPLE_ROWS`` rows and only decide how well the bounds separate. A cluster of any size is dealt to blocks of bounded bytes that share its bound.

A query first visits one block of the cluster with the highest bound that can fill its answer; the k-th score found there is its floor. Then it
meets all clusters whose bound reaches the floor. Small clusters lie in bundles of bounded bytes and a query goes to a bundle once, however many of its clusters it wants;
there neighbouring queries are scored together against the clusters that any of them wants. Queries that want the same bundle are dealt to tasks of bounded size, so neither a
cluster nor a popular query region becomes one task. The centres, at most ``MAX_CELLS`` rows, are all that is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package, written
from .ordering import sample_capped
from .retrieve import Encoding, best_rows, best_wanted_rows, merged, payload_matrix

MAX_CELLS = 1024
SAMPLE_ROWS = 20_000
BLOCK_BYTES = 16 << 20
ROUNDS = 6
# Bounds and scores are sums of a few hundred products of doubles; this is far above their rounding.
SLACK = 1e-9


@dataclass(frozen=True)
class Cells:
    """Centres, radii and sizes of the clusters, in the order of their numbers."""

    centres: np.ndarray
    radii: np.ndarray
    rows: np.ndarray
    blocks: np.ndarray

    def first_bundles(self, row_bytes: int, most: int) -> np.ndarray:
        """Number of each cluster's first bundle. A cluster of several blocks has a bundle for each; others share bundles of at most ``most`` bytes."""
        first, bundle, held = np.zeros(len(self.rows), dtype=np.int64), -1, most
        for cell in np.flatnonzero(self.blocks == 1):
            size = int(self.rows[cell]) * row_bytes
            if held + size > most:
                bundle, held = bundle + 1, 0
            first[cell], held = bundle, held + size
        for cell in np.flatnonzero(self.blocks > 1):
            first[cell] = bundle + 1
            bundle += int(self.blocks[cell])
        return first

    def bounds(self, points: np.ndarray) -> np.ndarray:
        """What a row of each cluster can score at most for each point."""
        size = np.sqrt((points * points).sum(axis=1, keepdims=True))
        return points @ self.centres.T + size * self.radii[None, :] + SLACK * (1 + size * (1 + np.abs(self.centres).max(initial=0.0)))


@dataclass(frozen=True)
class VectorIndex:
    """Rows (keys, payload, cell, block), written, and the clusters they are in."""

    rows: DataFrame
    keys: list[str]
    payload: str
    coding: Encoding
    cells: Cells


def _fit(sample: np.ndarray, wanted: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres by Lloyd's rounds from evenly spaced rows of the sample; equal rows give one centre."""
    centres = np.unique(sample[:: max(1, len(sample) // wanted)][:wanted], axis=0)
    for _ in range(rounds):
        cell = _nearest(sample, centres)
        size = np.bincount(cell, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, cell, sample)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(points @ centres.T - 0.5 * (centres * centres).sum(axis=1)[None, :], axis=1)


def build(corpus: DataFrame, keys: Sequence[str], payload: str, coding: Encoding, cells: int | None = None, block_bytes: int = BLOCK_BYTES, seed: int = 0) -> VectorIndex:
    """Index all rows of ``corpus`` that the encoding accepts; by default the number of clusters grows as the root of the rows."""
    keys = list(keys)
    spark = corpus.sparkSession
    ship_package(spark)
    rows = corpus.where(coding.accepts(F.col(payload))).select(*keys, payload)
    count = rows.count()
    wanted = min(MAX_CELLS, cells or max(1, int(np.sqrt(count))))
    picked = sample_capped(rows, min(SAMPLE_ROWS, 64 * wanted), seed, "cells", keys).select(payload).toArrow()
    sample = payload_matrix(picked, payload, coding) if picked.num_rows else np.zeros((0, coding.dim))
    centres = _fit(sample, wanted) if len(sample) else np.zeros((1, coding.dim))
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        middle = shared.value
        place = len(keys)
        for batch in batches:
            start = 0
            for points in coding.points(batch.column(place)):
                cell = _nearest(points, middle)
                away = np.sqrt(((points - middle[cell]) ** 2).sum(axis=1))
                part = batch.slice(start, len(points))
                start += len(points)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(away)], names=[*keys, payload, "cell", "away"])

    schema = rows.select(*keys, payload).schema.add("cell", T.IntegerType()).add("away", T.DoubleType())
    assigned = written(rows.mapInArrow(assign, schema), "cells")
    held = {r["cell"]: (r["n"], r["radius"]) for r in assigned.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()}
    sizes = np.array([held.get(c, (0, 0.0))[0] for c in range(len(centres))], dtype=np.int64)
    radii = np.array([held.get(c, (0, 0.0))[1] for c in range(len(centres))])
    found = Cells(centres, radii, sizes, np.maximum(1, -(-sizes * coding.dim * 8 // block_bytes)))
    parts = F.element_at(F.array(*[F.lit(int(b)) for b in found.blocks]), F.col("cell") + 1)
    return VectorIndex(assigned.drop("away").withColumn("block", F.pmod(F.xxhash64(*keys), parts).cast("int")), keys, payload, coding, found)


def wanted_cells(index: VectorIndex, queries: DataFrame, query_key: str, k: int) -> DataFrame:
    """(query key, payload, cell): of the clusters that can fill the answer the one with the highest bound."""
    payload, coding = index.payload, index.coding
    shared = queries.sparkSession.sparkContext.broadcast(index.cells)
    # A first block holds about this share of its cluster.
    enough = index.cells.rows // index.cells.blocks > k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        for batch in batches:
            start = 0
            for points in coding.points(batch.column(1)):
                part = batch.slice(start, len(points))
                start += len(points)
                usable = np.where(enough if enough.any() else cells.rows > 0, cells.bounds(points), -np.inf)
                row, cell = np.arange(len(points)), usable.argmax(axis=1)
                keep = cells.rows[cell] > 0
                row, cell = row[keep], cell[keep]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(cell.astype(np.int32))], names=[query_key, payload, "cell"]
                )

    schema = queries.select(query_key, payload).schema.add("cell", T.IntegerType())
    return queries.select(query_key, payload).mapInArrow(run, schema)


def _visits(index: VectorIndex, queries: DataFrame, query_key: str) -> DataFrame:
    """(query key, payload, floor, near, bundle, cells): the clusters whose bound reaches a query's ``floor`` (null: all), a row for each bundle they lie in.

    ``bundle`` is the first one of a cluster of several; ``near`` is the cluster of the highest bound.
    """
    payload, coding = index.payload, index.coding
    first = index.cells.first_bundles(coding.dim * 8, BLOCK_BYTES)
    # Clusters in the order of their bundles, so that those of a bundle stand together.
    order = np.argsort(first, kind="stable")
    shared = queries.sparkSession.sparkContext.broadcast((index.cells, first, order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, first, order = shared.value
        for batch in batches:
            start = 0
            for points in coding.points(batch.column(1)):
                part = batch.slice(start, len(points))
                start += len(points)
                bounds = cells.bounds(points)
                least = part.column(2).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                wanted = (bounds >= least[:, None]) & (cells.rows > 0)[None, :]
                near = np.where(cells.rows > 0, bounds, -np.inf).argmax(axis=1)
                row, place = np.nonzero(wanted[:, order])
                cell = order[place]
                begins = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (first[cell[1:]] != first[cell[:-1]])])) if len(row) else np.zeros(0, np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(begins, len(row)).astype(np.int32)), pa.array(cell.astype(np.int32)))
                taken = pa.array(row[begins])
                columns = [*[part.column(i).take(taken) for i in range(3)], pa.array(near[row[begins]].astype(np.int32)), pa.array(first[cell[begins]].astype(np.int32)), lists]
                yield pa.RecordBatch.from_arrays(columns, names=[query_key, payload, "floor", "near", "bundle", "cells"])

    schema = queries.select(query_key, payload, "floor").schema.add("near", T.IntegerType()).add("bundle", T.IntegerType()).add("cells", T.ArrayType(T.IntegerType()))
    return queries.select(query_key, payload, "floor").mapInArrow(run, schema)


def _first_meeting(index: VectorIndex, visits: DataFrame, query_key: str, k: int, skip_self: bool) -> DataFrame:
    """(query key, keys, score): the k best of the first block of each query's cluster."""
    coding, cells = index.coding, index.cells
    # Queries of a cluster are dealt to parts of bounded bytes; the block goes to each.
    asked = {r["cell"]: r["n"] for r in visits.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = _of("cell", [max(1, -(-asked.get(c, 0) * coding.dim * 8 // BLOCK_BYTES)) for c in range(len(cells.rows))])
    left = visits.withColumn("part", F.pmod(F.xxhash64(query_key), parts).cast("int"))
    rows = index.rows.where("block = 0")
    if asked:
        rows = rows.where(F.col("cell").isin(list(asked))) if len(asked) < len(cells.rows) else rows
    right = rows.withColumn("part", _every(parts))
    on = ["cell", "part"]
    run, schema = best_rows(query_key, index.keys, index.payload, coding, k, skip_self)
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, schema)


def _meet(index: VectorIndex, visits: DataFrame, query_key: str, k: int, skip_self: bool) -> DataFrame:
    """(query key, keys, score): the k best of every bundle that a query meets, as far as they reach its floor."""
    coding, cells = index.coding, index.cells
    first = cells.first_bundles(coding.dim * 8, BLOCK_BYTES)
    # How many bundles follow one for the clusters of several, and how many parts of bounded bytes its queries are dealt to.
    blocks = np.ones(int(first.max(initial=0)) + 1, dtype=np.int64)
    np.maximum.at(blocks, first, cells.blocks)
    asked = {r["bundle"]: r["n"] for r in visits.groupBy("bundle").agg(F.count("*").alias("n")).collect()}
    parts = _of("bundle", [max(1, -(-asked.get(b, 0) * coding.dim * 8 // BLOCK_BYTES)) for b in range(len(blocks))])
    left = visits.withColumn("part", F.pmod(F.xxhash64(query_key), parts).cast("int")).withColumn("block", _every(_of("bundle", blocks)))
    right = index.rows.withColumn("bundle", _of("cell", first).cast("int")).withColumn("part", _every(parts))
    on = ["bundle", "block", "part"]
    run, schema = best_wanted_rows(query_key, index.keys, index.payload, coding, k, skip_self)
    return left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, schema)


def _of(number: str, values: Sequence[int]):
    """The value that stands at a numbering column's place."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(number) + 1)


def _every(count):
    return F.explode(F.sequence(F.lit(0), count - 1))


def search(index: VectorIndex, queries: DataFrame, query_key: str, k: int, skip_self: bool = False) -> DataFrame:
    """Exact k best rows per query with their ``rank``, ties to the smallest keys."""
    queries = queries.where(index.coding.accepts(F.col(index.payload))).select(query_key, index.payload)
    return merged(_meet(index, _floored_visits(index, queries, query_key, k, skip_self), query_key, k, skip_self), query_key, index.keys, k)


def planned_visits(index: VectorIndex, queries: DataFrame, query_key: str, k: int, skip_self: bool = False) -> DataFrame:
    """(query key, payload, cell) of all that ``search`` visits, after the first visits have set the floors."""
    return _floored_visits(index, queries, query_key, k, skip_self).select(query_key, index.payload, F.explode("cells").alias("cell"))


def _floored_visits(index: VectorIndex, queries: DataFrame, query_key: str, k: int, skip_self: bool) -> DataFrame:
    first = _first_meeting(index, wanted_cells(index, queries, query_key, k), query_key, k, skip_self)
    floors = merged(first, query_key, index.keys, k).where(F.col("rank") == k).select(query_key, F.col("score").alias("floor"))
    # Row identity is the key; rows that repeat one share its floor, which holds for each of them.
    floors = floors.groupBy(query_key).agg(F.min("floor").alias("floor"))
    return written(_visits(index, queries.join(floors, query_key, "left"), query_key), "visits")
