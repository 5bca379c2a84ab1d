"""Helpers shared by the operators: written tables, bounded batches, word fingerprints, components."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package

# Text bytes that a task handles at once; bounds its memory, not what it covers.
BATCH_BYTES = 8 << 20
SMALL_SIDE_BYTES = 32 << 20
# 20,000 links are about 1 MB.
FEW_LINKS = 20_000
NO_ID = np.iinfo(np.int64).max


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a table in the shared folder, read back with its own schema."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def small_join(left: DataFrame, right: DataFrame, on: list[str], rows: int, row_bytes: int, how: str = "left") -> DataFrame:
    """Broadcast the right side while its counted size is small; beyond that Spark shuffles both."""
    return left.join(F.broadcast(right) if rows * row_bytes <= SMALL_SIDE_BYTES else right, on, how)


def parts_for(units: int, per_part: int) -> int:
    """Number of shuffle groups: grows with the input so that a group stays bounded."""
    return max(8, -(-max(units, 1) // per_part))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column)).alias("b")).first()["b"] or 0


def keep_rows(docs: DataFrame, decided: DataFrame, text_sha256: Column) -> DataFrame:
    """Rows of ``docs``, all columns, that ``decided(doc_id, text_sha256, kept)`` keeps; of rows equal in id and text one stays.

    Only what goes, or stands for several rows, is written and joined; while it is small the texts stay where they are.
    """
    own = "__"
    while any(c.lower().startswith(own) for c in docs.columns):
        own += "_"
    gone = written(
        decided.groupBy(F.col("doc_id").alias(f"{own}id"), F.col("text_sha256").alias(f"{own}sha"))
        .agg(F.min("kept").alias(f"{own}kept"), F.count("*").alias(f"{own}n"))
        .where(f"not {own}kept or {own}n > 1"),
        "decided",
    )
    few = gone.count() * 120 <= SMALL_SIDE_BYTES
    marked = docs.join(F.broadcast(gone) if few else gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col(f"{own}id")) & (text_sha256 == F.col(f"{own}sha")), "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = marked.where(f"{own}sha is null").select(columns)
    repeated = marked.where(f"{own}kept and {own}n > 1").dropDuplicates([f"{own}id", f"{own}sha"]).select(columns)
    return single.unionByName(repeated)


# --- batches ---------------------------------------------------------------------------------


def batches(records: Iterable[pa.RecordBatch], text: str = "text", target: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Regroup a task's record batches to about ``target`` bytes of text; a longer text is a batch of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for record in records:
        start = 0
        lengths = np.diff(_offsets(_strings(record.column(record.schema.get_field_index(text)))))
        for cut in _cuts(lengths, target, size):
            piece = record.slice(start, cut - start)
            size += int(lengths[start:cut].sum())
            held.append(piece)
            start = cut
            if size >= target:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def packed_table(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table.combine_chunks())
    return zstandard.compress(sink.getvalue(), 3)


def unpacked_table(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(zstandard.decompress(blob)).read_all()


def _cuts(lengths: np.ndarray, target: int, size: int) -> Iterator[int]:
    """Row counts at which the running size reaches the target, and the end."""
    for i, n in enumerate(lengths, start=1):
        size += int(n)
        if size >= target and i < len(lengths):
            yield i
            size = 0
    if len(lengths):
        yield len(lengths)


def _strings(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """One contiguous array; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column.cast(pa.large_string()).fill_null("")


def _offsets(column: pa.LargeStringArray) -> np.ndarray:
    return np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets of each text in them)."""
    column = _strings(column)
    offsets = _offsets(column)
    data = column.buffers()[2] if len(column) else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def ids_of(column) -> np.ndarray:
    """doc_id as int64; a null id is ``NO_ID`` and so is smaller than none."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False).astype(np.int64)


# --- word fingerprints -----------------------------------------------------------------------

_rng = np.random.default_rng(20240607)
_BYTE_VALUES = _rng.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 0x9E3779B97F4A7C15 | 1
_SLICE = 1 << 16
_LONG_WORD = 64
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
# The bytes that end a word.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int) -> np.ndarray:
    out = np.full(_SLICE + 1, base % 2**64, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_STEP), _powers(pow(_STEP, -1, 2**64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that near values differ everywhere."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the number of words before each text (one more entry than texts)."""
    inside = ~_SPACE[raw]
    before = np.empty(len(raw), dtype=bool)
    if len(raw):
        before[0] = False
        before[1:] = inside[:-1]
        at = offsets[:-1][offsets[:-1] < len(raw)]
        before[at] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(raw), dtype=bool)
    if len(raw):
        after[-1] = False
        after[:-1] = inside[1:]
        at = offsets[1:][offsets[1:] > 0] - 1
        after[at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_case: bool = False) -> np.ndarray:
    """64-bit fingerprint of each word, from whole bytes; long words by a cryptographic hash."""
    values = _BYTE_VALUES[ASCII_LOWER] if fold_case else _BYTE_VALUES
    out = np.zeros(len(starts), dtype=np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _SLICE, side="right")))
        low = int(starts[a])
        if ends[b - 1] - low <= _SLICE:
            sums = np.zeros(int(ends[b - 1]) - low + 1, dtype=np.uint64)
            np.cumsum(values[raw[low : ends[b - 1]]] * _UP[: len(sums) - 1], out=sums[1:])
            s, e = starts[a:b] - low, ends[a:b] - low
            out[a:b] = (sums[e] - sums[s]) * _DOWN[s]
        a = b
    for i in np.flatnonzero(ends - starts > _LONG_WORD):
        word = raw[starts[i] : ends[i]]
        word = ASCII_LOWER[word] if fold_case else word
        out[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")
    return mix(out)


def run_hashes(words_: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Fingerprint of every run of ``length`` words over the whole array, texts not yet told apart."""
    n = len(words_) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    factors = np.random.default_rng(seed).integers(1, 2**63, size=length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        out += words_[k : k + n] * factors[k]
    return mix(out)


# --- connected components --------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links(a, b)``.

    Alternating star steps: nodes first hang their larger neighbours, then their smaller ones, on the
    smallest neighbour. Minima combine before the shuffle and neighbours are never gathered in a list, so
    a hub may hold any share of the links. Each round is written to the shared folder.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    count, mark = edges.count(), None
    while True:
        # Few links are one partition, and then no step of a round has to move them.
        edges = edges.coalesce(1) if count <= FEW_LINKS else edges
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = both.coalesce(1) if count <= FEW_LINKS else both
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        tied = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where("a <> b")
        edges = written((tied.coalesce(1) if count <= FEW_LINKS else tied).distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(now) == mark:
            break
        mark, count = tuple(now), max(count, now["n"])
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
