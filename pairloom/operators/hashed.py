"""Signed feature hashing of texts into dense vectors.

Every token adds +2 or -2 at one bucket and the opposite half at a second one. The integer weights
are the same vector as +-1/sqrt(n) and -+0.5/sqrt(n) up to a factor that the L2 norm removes, and
they make sums, norms and dot products exact.

The work per row is independent, so it is a narrow Arrow pass: no token row is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .tokens import hash60, list_array, split_tokens, text_slices, unit_rows

DEFAULT_DIM = 512
# Rows turned into a matrix at a time: 256 x 512 doubles stay in the processor cache.
_SLICE_ROWS = 256


def hashed_weights(texts: pa.Array, dim: int) -> Iterator[np.ndarray]:
    """Integer-valued weight matrices of consecutive row slices.

    From the md5 hex digits of a lowercase token: 0-6 primary bucket, 7-13 secondary bucket, digit
    14 even means plus.
    """
    batch = split_tokens(texts, lower=True)
    head = hash60(batch.vocabulary)
    primary = (head >> 32) % dim
    secondary = ((head >> 4) & ((1 << 28) - 1)) % dim
    sign = np.where(head & 1, -1.0, 1.0)
    for start in range(0, len(texts), _SLICE_ROWS):
        edges = batch.edges[start : start + _SLICE_ROWS + 1]
        token = batch.codes[edges[0] : edges[-1]]
        base = np.repeat(np.arange(len(edges) - 1) * dim, np.diff(edges))
        where = np.concatenate([base + primary[token], base + secondary[token]])
        weight = np.concatenate([2.0 * sign[token], -sign[token]])
        flat = np.bincount(where, weights=weight, minlength=(len(edges) - 1) * dim)
        # An empty count comes back as integers.
        yield flat.astype(np.float64, copy=False).reshape(-1, dim)


def hash_embed(df: DataFrame, text: str, dim: int = DEFAULT_DIM, name: str = "embedding", keep: Sequence[str] | None = None) -> DataFrame:
    """Append the L2-normalised hashed vector of ``text``; no token gives a zero vector.

    ``keep`` names the columns that come back, all by default: a text nobody reads again need not travel.
    """
    ship_package(df.sparkSession)
    kept = df.columns if keep is None else list(keep)
    # Only what is kept, and the text, goes to Python.
    df = df.select(*kept, *([] if text in kept else [text]))
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(name, T.ArrayType(T.FloatType()))])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in text_slices(b, [place])):
            start = 0
            for weights in hashed_weights(batch.column(place), dim):
                part = batch.slice(start, len(weights))
                columns = [*part.columns[: len(kept)], list_array(unit_rows(weights).astype(np.float32))]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
                start += len(weights)

    return df.mapInArrow(run, schema)


def hash_embed_wide(df: DataFrame, text: str, dim: int = DEFAULT_DIM) -> DataFrame:
    """``text`` and one column ``emb_i`` per dimension."""
    vectors = hash_embed(df.select(F.col(text).alias("text")), "text", dim, "_v")
    return vectors.select("text", *[F.col("_v")[i].alias(f"emb_{i}") for i in range(dim)])
