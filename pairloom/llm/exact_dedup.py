"""Exact duplicates by content-defined chunk recipes.

A text is cut where a rolling fingerprint of its last 32 bytes ends in zero bits, so equal stretches give
equal chunks wherever they stand. Chunk contents cross the network once, to prove that a digest names one
content only; after that a document is its ordered list of identifiers, 16 bytes for each KB or so, and only
those lists are grouped and joined.

Defined cases: null counts as the empty text; empty texts equal each other; A-Z and a-z are the same letter
and no other characters are; an id that is null is smaller than every other; rows that repeat both id and
text stand or fall together, and ``drop_duplicates`` leaves one of them.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK_BITS = 10
MAX_CHUNK = 1 << 16
SPELLED_LIMIT = 100_000
_WINDOW_STEPS = (1, 2, 4, 8, 16)
_GEAR = np.random.default_rng(7).integers(0, 2**32, size=256, dtype=np.uint32)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def boundaries(data: np.ndarray, bits: int = CHUNK_BITS, longest: int = MAX_CHUNK) -> np.ndarray:
    """Chunk ends in ``data``, the last one being its length. Depends on the last 32 bytes before a cut only."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cuts = []
    for low in range(0, n, 1 << 20):
        first = max(0, low - 31)
        h = _GEAR[data[first : low + (1 << 20)]]
        for k in _WINDOW_STEPS:
            if len(h) > k:
                h = np.concatenate([h[:k], h[k:] + (h[:-k] << np.uint32(k))])
        cuts.append(np.flatnonzero((h[low - first :] >> np.uint32(32 - bits)) == 0) + low + 1)
    ends = np.unique(np.append(np.concatenate(cuts), n))
    gaps = np.diff(ends, prepend=0)
    if (gaps > longest).any():
        more = [np.arange(e - g + longest, e, longest) for e, g in zip(ends[gaps > longest], gaps[gaps > longest])]
        ends = np.unique(np.concatenate([ends, *more]))
    return ends


def chunks_of(data: np.ndarray) -> list[bytes]:
    whole = data.tobytes()
    out, start = [], 0
    for end in boundaries(data).tolist():
        out.append(whole[start:end])
        start = end
    return out


def _texts(batch: pa.Table) -> list[np.ndarray]:
    raw, offsets = common.text_buffer(batch.column("text"))
    folded = common.ASCII_LOWER[raw]
    return [folded[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def chunk_rows(name=digest):
    """Arrow mapper: the distinct (digest, chunk) pairs of each batch."""

    def run(records):
        for batch in common.batches(records):
            pairs = {c: name(c) for t in _texts(batch) for c in chunks_of(t)}
            rows = list(pairs)
            for at in range(0, len(rows), 4096):
                part = rows[at : at + 4096]
                yield pa.RecordBatch.from_arrays([pa.array([pairs[c] for c in part], pa.binary()), pa.array(part, pa.binary())], names=["digest", "chunk"])

    return run


def recipe_rows(shared: set[bytes], spell_all: bool, name=digest):
    """Arrow mapper: (doc_id, recipe, text_sha256). A digest that names several contents is followed by the content."""

    def element(chunk: bytes) -> bytes:
        key = name(chunk)
        return key + len(chunk).to_bytes(8, "big") + chunk if spell_all or key in shared else key

    def run(records):
        for batch in common.batches(records):
            texts = _texts(batch)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").combine_chunks().cast(pa.int64()),
                    pa.array([b"".join(map(element, chunks_of(t))) for t in texts], pa.binary()),
                    pa.array([hashlib.sha256(t.tobytes()).hexdigest() for t in texts], pa.string()),
                ],
                names=["doc_id", "recipe", "text_sha256"],
            )

    return run


def exact_groups(docs: DataFrame, name=digest) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    chunks = common.map_arrow(source.select("text"), chunk_rows(name), "digest binary, chunk binary").distinct()
    shared = chunks.groupBy("digest").count().where("count > 1").select("digest").limit(SPELLED_LIMIT + 1).collect()
    known = {bytes(r.digest) for r in shared}
    recipes = common.written(
        common.map_arrow(source, recipe_rows(known, len(known) > SPELLED_LIMIT, name), "doc_id bigint, recipe binary, text_sha256 string"), "recipes"
    )
    groups = common.written(
        recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "recipe-groups"
    )
    joined = recipes.join(groups, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, without those that another row with an equal text stands for."""
    folded = F.sha2(F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER, _LOWER), 256)
    return common.keep_rows(docs, exact_groups(docs), folded)
