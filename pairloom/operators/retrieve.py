"""Exact top-k retrieval by blocked matrix products inside tasks.

A held side that fits one bounded block travels to the tasks that read the other side. With a larger one the corpus is clustered
(``vector_index``) and queries meet only the clusters whose bound reaches their k-th score; nothing of it passes through the driver. Either way a
task keeps the k best per query, so what is merged is queries x k rows per task and never a row per pair.

Rows without a payload, and vectors of another size or with a null inside, are no candidates and have no answers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .hashed import DEFAULT_DIM, hashed_weights
from .tokens import unit_rows

HELD_BLOCK_BYTES = 64 << 20
_DENSE_SLICE = 1024
# Queries scored together against the clusters that any of them wants.
_QUERY_SLICE = 256
# Scores held at a time in a task: 2M doubles are 16 MB.
_SCORE_CELLS = 1 << 21


@dataclass(frozen=True)
class Encoding:
    """How a payload column becomes matrices, and how two matrices become scores."""

    dim: int
    encode: Callable[[pa.Array], Iterator[np.ndarray]]
    accepts: Callable[[Column], Column]
    score: Callable[[np.ndarray, np.ndarray], np.ndarray]
    # What is done to scores that may be among the best; it keeps their order and moves none by more than ``slack``.
    finish: Callable[[np.ndarray], np.ndarray] = lambda scores: scores
    slack: Callable[[np.ndarray], np.ndarray] = lambda scores: 0.0 * scores
    # What makes a score the dot product of two rows, up to rounding.
    scaled: Callable[[np.ndarray], np.ndarray] = lambda matrix: matrix

    def points(self, column: pa.Array) -> Iterator[np.ndarray]:
        return (self.scaled(matrix) for matrix in self.encode(column))


def dense_encoding(dim: int, places: int = 12) -> Encoding:
    """Vectors scored by dot product; rounding makes equal rows tie whatever the sum order."""

    def encode(column: pa.Array) -> Iterator[np.ndarray]:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        matrix = flat.reshape(-1, dim)
        for start in range(0, len(matrix), _DENSE_SLICE):
            yield matrix[start : start + _DENSE_SLICE]

    def accepts(payload: Column) -> Column:
        return payload.isNotNull() & (F.size(payload) == dim) & ~F.exists(payload, lambda x: x.isNull())

    return Encoding(dim, encode, accepts, lambda left, right: left @ right.T, lambda x: np.round(x, places), lambda x: 10.0**-places * (1 + np.abs(x)))


def hashed_encoding(dim: int = DEFAULT_DIM) -> Encoding:
    """Texts as hashed integer weights, scored by cosine; the dot is exact."""

    def score(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        sizes = np.outer((left * left).sum(axis=1), (right * right).sum(axis=1))
        dots = left @ right.T
        return np.divide(dots, np.sqrt(sizes), out=np.zeros_like(dots), where=sizes > 0)

    return Encoding(dim, lambda column: hashed_weights(column, dim), lambda payload: payload.isNotNull(), score, scaled=unit_rows)


class _Best:
    """The k best rows per query seen so far: highest score, then smallest keys.

    Candidates below a query's current k-th score are dropped at once; the rest wait in a buffer that
    is sorted only when it has grown well beyond the kept rows.
    """

    def __init__(self, queries: int, k: int, coding: Encoding) -> None:
        self.k, self.coding = k, coding
        # Not above any unfinished score that belongs to the k best.
        self.floor = np.full(queries, -np.inf)
        self.parts: list[list[np.ndarray]] = []
        self.waiting = 0
        self.limit = max(2 * queries * k, 1 << 16)

    def add(self, first: int, scores: np.ndarray, keys: list[np.ndarray]) -> None:
        """Score matrix of the queries from ``first`` on against rows with these keys."""
        k, width = self.k, scores.shape[1]
        floor = self.floor[first : first + len(scores)]
        keep = scores >= floor[:, None]
        if width > k:
            # Only queries with more than k candidates here need a higher floor.
            many = np.flatnonzero(np.count_nonzero(keep, axis=1) > k)
            if len(many):
                # Rows that all have to go are often all there are.
                chosen = scores if len(many) == len(scores) else scores[many]
                least = np.partition(chosen, width - k, axis=1)[:, width - k]
                with np.errstate(invalid="ignore"):
                    least = np.where(np.isneginf(least), least, least - self.coding.slack(least))
                floor[many] = np.maximum(floor[many], least)
                keep[many] = chosen >= floor[many, None]
        row, col = np.nonzero(keep & (scores > -np.inf) if np.isneginf(floor).any() else keep)
        self.parts.append([first + row, self.coding.finish(scores[row, col]), *[c[col] for c in keys]])
        self.waiting += len(row)
        if self.waiting > self.limit:
            self.prune()

    def prune(self) -> list[np.ndarray]:
        """Keep and return (query, score, keys...) of the k best per query."""
        if not self.parts:
            return []
        query, score, *keys = [np.concatenate(c) for c in zip(*self.parts)]
        order = np.lexsort((*reversed(keys), -score, query))
        placed = query[order]
        rank = np.arange(len(order)) - np.searchsorted(placed, placed)
        order, rank = order[rank < self.k], rank[rank < self.k]
        last = order[rank == self.k - 1]
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last] - self.coding.slack(score[last]))
        kept = [c[order] for c in (query, score, *keys)]
        self.parts, self.waiting = [kept], len(order)
        return kept


@dataclass(frozen=True)
class _Held:
    """A block of the held side, as a broadcast would hand it over."""

    value: tuple[list[np.ndarray], np.ndarray]


def _block(table: pa.Table, keys: Sequence[str], payload: str, coding: Encoding) -> tuple[list[np.ndarray], np.ndarray]:
    """(keys, matrix) of one block."""
    column = table.column(payload).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    parts = list(coding.encode(column)) if len(column) else []
    matrix = np.concatenate(parts) if parts else np.zeros((0, coding.dim))
    return [table.column(c).to_numpy().astype(np.int64) for c in keys], matrix


def payload_matrix(table: pa.Table, payload: str, coding: Encoding) -> np.ndarray:
    """The rows of a bounded table as points."""
    column = table.column(payload).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    return np.concatenate(list(coding.points(column)))


def best_rows(query_key: str, corpus_keys: Sequence[str], payload: str, coding: Encoding, k: int, skip_self: bool):
    """(cogroup function, its schema): the k best rows of the right group for each query of the left one."""
    names = [query_key, *corpus_keys, "score"]
    schema = _found_schema(names)

    def run(block: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if block.num_rows and rows.num_rows:
            task = _scan(_Held(_block(block, [query_key], payload, coding)), coding, k, True, skip_self, names)
            found = list(task(rows.select([*corpus_keys, payload]).combine_chunks().to_batches()))
        return pa.Table.from_batches(found) if found else pa.table({f.name: pa.array([], pa.float64() if f.name == "score" else pa.int64()) for f in schema.fields})

    return run, schema


def best_wanted_rows(query_key: str, corpus_keys: Sequence[str], payload: str, coding: Encoding, k: int, skip_self: bool):
    """(cogroup function, its schema): the k best rows of the right group, not below the floor, for each query of the left one.

    Left rows name the ``cells`` they want and their ``near`` one, by which queries are taken together; right rows have a ``cell``. A slice of queries is scored against the rows of all
    cells that one of them wants.
    """
    names = [query_key, *corpus_keys, "score"]
    schema = _found_schema(names)

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        found = []
        if asked.num_rows and rows.num_rows:
            asked = asked.sort_by("near")
            cell = rows.column("cell").to_numpy()
            (ids,), points = _block(asked, [query_key], payload, coding)
            keys, matrix = _block(rows, corpus_keys, payload, coding)
            floors = asked.column("floor").fill_null(-np.inf).to_numpy()
            for start in range(0, len(ids), _QUERY_SLICE):
                part = slice(start, start + _QUERY_SLICE)
                wanted = np.isin(cell, asked.column("cells")[part].combine_chunks().flatten().to_numpy())
                # All rows are used as they lie.
                mine, their = (matrix, keys) if wanted.all() else (matrix[wanted], [c[wanted] for c in keys])
                best = _Best(len(ids[part]), k, coding)
                best.floor[:] = np.where(np.isneginf(floors[part]), -np.inf, floors[part] - coding.slack(np.where(np.isneginf(floors[part]), 0, floors[part])))
                step = max(1, _SCORE_CELLS // len(best.floor))
                for first in range(0, len(mine), step):
                    here = slice(first, first + step)
                    scores = coding.score(points[part], mine[here])
                    if skip_self:
                        scores[ids[part][:, None] == their[0][here][None, :]] = -np.inf
                    best.add(0, scores, [c[here] for c in their])
                if kept := best.prune():
                    query, score, *own = kept
                    found.append(pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[part][query], *own, score)], names=names))
        return pa.Table.from_batches(found) if found else pa.table({f.name: pa.array([], pa.float64() if f.name == "score" else pa.int64()) for f in schema.fields})

    return run, schema


def _found_schema(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.LongType()) for n in names[:-1]] + [T.StructField("score", T.DoubleType())])


def merged(found: DataFrame, query_key: str, corpus_keys: Sequence[str], k: int) -> DataFrame:
    """The k best of all that tasks have found, with their ``rank``."""
    best = Window.partitionBy(query_key).orderBy(F.desc("score"), *corpus_keys)
    return found.withColumn("rank", F.row_number().over(best).cast("bigint")).where(F.col("rank") <= k)


def top_k(
    queries: DataFrame,
    query_key: str,
    corpus: DataFrame,
    corpus_keys: Sequence[str],
    payload: str,
    coding: Encoding,
    k: int,
    hold: str = "queries",
    skip_self: bool = False,
) -> DataFrame:
    """Exact k best corpus rows per query, ties to the smallest corpus keys.

    ``hold`` names the smaller side. Both sides carry ``payload``; the keys are integers. With
    ``skip_self`` a corpus row never answers the query of the same key.
    """
    corpus_keys = list(corpus_keys)
    names = [query_key, *corpus_keys, "score"]
    queries, corpus = (df.where(coding.accepts(F.col(payload))) for df in (queries, corpus))
    sides = {"queries": (queries, [query_key]), "corpus": (corpus, corpus_keys)}
    (held, held_keys), (stream, stream_keys) = sides[hold], sides["corpus" if hold == "queries" else "queries"]
    held, stream = held.select(*held_keys, payload), stream.select(*stream_keys, payload)
    spark = queries.sparkSession
    ship_package(spark)
    # One block and one row more tell whether the side is larger than a block.
    most = max(1, HELD_BLOCK_BYTES // (coding.dim * 8))
    rows = held.limit(most + 1).toArrow().combine_chunks()
    if rows.num_rows > most:
        from . import vector_index

        return vector_index.search(vector_index.build(corpus, corpus_keys, payload, coding), queries, query_key, k, skip_self)
    block = _block(rows, held_keys, payload, coding)
    scan = _scan(spark.sparkContext.broadcast(block), coding, k, hold == "queries", skip_self, names)
    schema = _found_schema(names)
    found = stream.mapInArrow(scan, schema) if len(block[1]) else spark.createDataFrame([], schema)
    return merged(found, query_key, corpus_keys, k)


def _scan(shared, coding: Encoding, k: int, held_queries: bool, skip_self: bool, names: list[str]):
    def emit(query_ids, kept) -> Iterator[pa.RecordBatch]:
        if kept:
            query, score, *keys = kept
            columns = [pa.array(c) for c in (query_ids[query], *keys, score)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_keys, block = shared.value
        best = _Best(len(block), k, coding) if held_queries else None
        for batch in batches:
            row_keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns - 1)]
            start = 0
            for matrix in coding.encode(batch.column(batch.num_columns - 1)):
                here = [c[start : start + len(matrix)] for c in row_keys]
                start += len(matrix)
                local = best or _Best(len(matrix), k, coding)
                step = max(1, _SCORE_CELLS // len(matrix))
                for first in range(0, len(block), step):
                    part = slice(first, first + step)
                    if held_queries:
                        scores, ids, keys = coding.score(block[part], matrix), block_keys[0][part], here
                    else:
                        scores, ids, keys = coding.score(matrix, block[part]), here[0], [c[part] for c in block_keys]
                    if skip_self:
                        scores[ids[:, None] == keys[0][None, :]] = -np.inf
                    local.add(first if held_queries else 0, scores, keys)
                if best is None:
                    yield from emit(here[0], local.prune())
        if best is not None:
            yield from emit(block_keys[0], best.prune())

    return run


def offset_negatives(numbered: DataFrame, idx: str, value: str, size: int, shift: int = 23) -> DataFrame:
    """Pair row i with the row at (i + shift) mod size by an equi-join on the computed index."""
    wanted = numbered.withColumn("negative_idx", F.pmod(F.col(idx) + shift, F.lit(size)))
    other = numbered.select(F.col(idx).alias("negative_idx"), F.col(value).alias("negative"))
    return wanted.join(other, "negative_idx")


def pair_scores(df: DataFrame, left: str, right: str, dim: int = DEFAULT_DIM, name: str = "score") -> DataFrame:
    """Hashed cosine of two text columns of the same row."""
    ship_package(df.sparkSession)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    places = df.columns.index(left), df.columns.index(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for a, b in zip(*[hashed_weights(batch.column(i), dim) for i in places]):
                size = (a * a).sum(axis=1) * (b * b).sum(axis=1)
                dots = (a * b).sum(axis=1)
                scores.append(np.divide(dots, np.sqrt(size), out=np.zeros_like(dots), where=size > 0))
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
