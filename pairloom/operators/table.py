"""The token-embedding table: token ids, initialisation, pooling and embedding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..functions.hashing import unit_draw
from ..functions.text import NOT_WHITE
from ..session import ship_package
from .layout import BROADCAST_LIMIT_BYTES, broadcast_within
from .tokens import TokenBatch, hash60, list_array, split_tokens, text_slices, unit_rows

PAD_ID = 0
UNKNOWN_ID = 1
INIT_SCALE = 0.05
# Up to this many dimensions a sum per dimension stays within generated code.
_PLAIN_SUM_DIMS = 64
_COUNTS = T.ArrayType(T.StructType([T.StructField("token_id", T.IntegerType()), T.StructField("count", T.IntegerType())]))
# Token rows gathered at a time in batch scoring: 4,096 x 512 doubles are 16 MB.
SLICE_TOKENS = 4096


@dataclass(frozen=True)
class ModelConfig:
    vocab_size: int = 8192
    embedding_dim: int = 512
    max_seq_len: int | None = 64
    normalize: bool = True

    def __post_init__(self) -> None:
        if self.vocab_size <= 2 or self.embedding_dim <= 0 or (self.max_seq_len is not None and self.max_seq_len <= 0):
            raise ValueError(f"vocab_size must be > 2, the other sizes > 0 (max_seq_len None: whole texts): {self}")

    def as_dict(self) -> dict:
        return asdict(self)


def batch_ids(texts: pa.Array, config: ModelConfig) -> TokenBatch:
    """Tokens of each text, at most max_seq_len, with ``vocabulary`` turned into token ids.

    A token is known by its ASCII letters and digits in lowercase; one without any is unknown.
    """
    batch = split_tokens(texts).cut(config.max_seq_len)
    bare = pc.ascii_lower(pc.replace_substring_regex(batch.vocabulary, "[^A-Za-z0-9]+", ""))
    ids = (hash60(bare) % (config.vocab_size - 2) + 2).astype(np.int32)
    ids[pc.equal(bare, "").to_numpy(zero_copy_only=False)] = UNKNOWN_ID
    return TokenBatch(batch.vocabulary, ids[batch.codes], batch.edges)


def with_ids(df: DataFrame, columns: dict[str, str], config: ModelConfig, keep: Sequence[str] | None = None) -> DataFrame:
    """Append an array of token ids per text column; ``columns`` maps new names to texts.

    ``keep`` names the columns that come back, all by default: a text nobody reads again need not travel.
    """
    ship_package(df.sparkSession)
    kept = df.columns if keep is None else list(keep)
    # Only what is kept, and the texts, goes to Python.
    df = df.select(*kept, *[c for c in dict.fromkeys(columns.values()) if c not in kept])
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in columns]])
    places = [df.columns.index(c) for c in columns.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in text_slices(b, places)):
            added = []
            for place in places:
                found = batch_ids(batch.column(place), config)
                added.append(pa.ListArray.from_arrays(pa.array(found.edges.astype(np.int32)), pa.array(found.codes)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *added], names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)


def token_ids(df: DataFrame, text: str, config: ModelConfig) -> DataFrame:
    """One row per token position with its id."""
    others = [c for c in df.columns if c != text]
    exploded = with_ids(df, {"_ids": text}, config, others).select(*others, F.posexplode("_ids").alias("position", "token_id"))
    return exploded.withColumn("token_id", F.col("token_id").cast("bigint"))


def count_ids(placed: DataFrame, keys: Sequence[str], ids: str) -> DataFrame:
    """(keys, length, token_id, count) rows of id arrays."""
    tokens = placed.select(*keys, F.size(ids).alias("length"), F.explode(ids).alias("token_id"))
    counted = tokens.groupBy(*keys, "length", "token_id").agg(F.count("*").alias("count"))
    return counted.withColumn("token_id", F.col("token_id").cast("bigint"))


def token_counts(df: DataFrame, keys: Sequence[str], text: str, config: ModelConfig) -> DataFrame:
    """(keys, length, token_id, count) rows; a token stands once per text.

    Texts become arrays of their distinct ids, counted where they are read, and are then placed by their first key, which must
    spread the rows. What moves is one compact array per text and never a row per token, and no table of all tokens of a
    partition is kept to count them.
    """
    ship_package(df.sparkSession)
    kept = df.select(*keys, text)
    schema = T.StructType([*[kept.schema[c] for c in keys], T.StructField("length", T.IntegerType()), T.StructField("_counts", _COUNTS)])
    place = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in text_slices(b, [place])):
            found = batch_ids(batch.column(place), config)
            lengths = np.diff(found.edges)
            row, ids, times = _counted(found.codes, lengths, config.vocab_size)
            edges = np.searchsorted(row, np.arange(len(lengths) + 1)).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(ids), pa.array(times)], names=["token_id", "count"])
            columns = [*batch.columns[:place], pa.array(lengths.astype(np.int32)), pa.ListArray.from_arrays(pa.array(edges), pairs)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])

    placed = kept.mapInArrow(run, schema).repartition(keys[0])
    tokens = placed.select(*keys, "length", F.explode("_counts").alias("_c"))
    return tokens.select(*keys, "length", F.col("_c.token_id").cast("bigint").alias("token_id"), F.col("_c.count").cast("bigint").alias("count"))


def _counted(ids: np.ndarray, lengths: np.ndarray, vocab_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, id, times) of the distinct ids of each row, rows in order."""
    row = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
    used, times = np.unique(row * vocab_size + ids, return_counts=True)
    return used // vocab_size, (used % vocab_size).astype(np.int32), times.astype(np.int32)


def init_token_table(spark: SparkSession, config: ModelConfig, seed: int) -> DataFrame:
    """Rows (token_id, vec) with keyed uniform cells in [-0.05, 0.05); the padding row is zero."""
    return init_rows(spark.range(config.vocab_size).select(F.col("id").alias("token_id")), config, seed)


def init_rows(ids: DataFrame, config: ModelConfig, seed: int) -> DataFrame:
    cell = lambda d: (unit_draw(seed, "init", F.col("token_id"), d) * 2 - 1) * INIT_SCALE
    drawn = F.transform(F.sequence(F.lit(0), F.lit(config.embedding_dim - 1)), cell)
    return ids.select("token_id", F.when(F.col("token_id") == PAD_ID, V.zeros(config.embedding_dim)).otherwise(drawn).alias("vec"))


def lookup(tokens: DataFrame, table: DataFrame, config: ModelConfig) -> DataFrame:
    """Add each token's row. The table travels to the tokens while vocab x dim is small; a larger one
    is a shuffled join in which adaptive execution splits hot tokens."""
    side = broadcast_within(table, config.vocab_size, config.embedding_dim * 8)
    return tokens.join(side, "token_id")


def pooled(
    counts: DataFrame, keys: Sequence[str], weight: str, table: DataFrame, config: ModelConfig, name: str = "embedding"
) -> DataFrame:
    """Weighted mean of the table rows per key, summed in the JVM with map-side partials.

    Few dimensions are plain sums in generated code; many use the vector summarizer, with the rows
    turned into vectors before the join, once each.
    """
    if config.embedding_dim <= _PLAIN_SUM_DIMS:
        joined = lookup(counts, table.select("token_id", "vec"), config)
        sums = [F.sum(F.col("vec")[i] * F.col(weight)).alias(f"_s{i}") for i in range(config.embedding_dim)]
        totals = joined.groupBy(*keys).agg(F.sum(F.col(weight)).alias("_w"), *sums)
        return totals.select(*keys, F.array(*[F.col(f"_s{i}") / F.col("_w") for i in range(config.embedding_dim)]).alias(name))
    rows = table.select("token_id", array_to_vector("vec").alias("_v"))
    joined = lookup(counts, rows, config)
    mean = Summarizer.metrics("mean").summary(F.col("_v"), F.col(weight).cast("double")).getField("mean")
    return joined.groupBy(*keys).agg(vector_to_array(mean).alias(name))


def mean_pool(df: DataFrame, keys: Sequence[str], text: str, table: DataFrame, config: ModelConfig) -> DataFrame:
    """Mean of the token vectors of each text; repeated tokens count each time and a text without tokens gives no row."""
    return pooled(token_counts(df, keys, text, config), keys, "count", table, config)


def masked_mean_pool(df: DataFrame, keys: Sequence[str], mask: str, dim: int, count: str | None = None) -> DataFrame:
    """Mean over the rows with mask > 0, each counted ``count`` times; a key with none gives a zero vector.

    Masked rows keep their key but carry a zero vector and weight 0, so no second pass is needed.
    """
    use = F.when(F.col(mask) > 0, F.col(count).cast("double") if count else F.lit(1.0)).otherwise(0.0)
    live = df.withColumn("_live", use)
    if dim <= _PLAIN_SUM_DIMS:
        # Plain sums stay in generated code and in one small row per key; an aggregate of vectors sorts and spills a row per token.
        used = lambda i: F.when(F.col("_live") > 0, F.col("vec")[i] * F.col("_live")).otherwise(0.0)
        found = live.groupBy(*keys).agg(F.sum("_live").alias("_n"), *[F.sum(used(i)).alias(f"_s{i}") for i in range(dim)])
        sums = F.array(*[F.col(f"_s{i}") for i in range(dim)])
        mean = F.when(F.col("_n") > 0, V.scale(sums, 1.0 / F.col("_n"))).otherwise(sums)
        return found.select(*keys, mean.alias("embedding"))
    weighted = V.scale(F.col("vec"), F.col("_live")) if count else F.col("vec")
    sums = live.select(*keys, "_live", array_to_vector(F.when(F.col("_live") > 0, weighted).otherwise(V.zeros(dim))).alias("_v"))
    total = vector_to_array(Summarizer.sum(F.col("_v")))
    found = sums.groupBy(*keys).agg(total.alias("_sum"), F.sum("_live").alias("_n"))
    mean = F.when(F.col("_n") > 0, V.scale(F.col("_sum"), 1.0 / F.col("_n"))).otherwise(F.col("_sum"))
    return found.select(*keys, mean.alias("embedding"))


def embed_table(df: DataFrame, keys: Sequence[str], text: str, table: DataFrame, config: ModelConfig) -> DataFrame:
    """Mean-pooled and, if configured, normalised vector per key; a null text or one without tokens is zero.

    ``keys`` must be unique: rows that share a key are pooled as one text.
    """
    pooled_rows = mean_pool(df, keys, text, table, config)
    vec = V.l2_normalize(F.col("embedding")) if config.normalize else F.col("embedding")
    known = pooled_rows.select(*keys, vec.alias("embedding"))
    empty = df.where(~F.coalesce(F.col(text), F.lit("")).rlike(NOT_WHITE)).select(*keys, V.zeros(config.embedding_dim).alias("embedding"))
    return known.unionByName(empty)


def fits_broadcast(config: ModelConfig) -> bool:
    return config.vocab_size * config.embedding_dim * 8 <= BROADCAST_LIMIT_BYTES


def table_matrix(table: DataFrame, config: ModelConfig) -> np.ndarray:
    """The table as one matrix for batch scoring; callers check ``fits_broadcast``."""
    rows = table.select("token_id", "vec").toArrow().combine_chunks()
    matrix = np.zeros((config.vocab_size, config.embedding_dim))
    vecs = rows.column("vec").combine_chunks()
    vecs = vecs.chunk(0) if isinstance(vecs, pa.ChunkedArray) else vecs
    matrix[rows.column("token_id").to_numpy()] = vecs.flatten().to_numpy().reshape(-1, config.embedding_dim)
    return matrix


def mean_rows(matrix: np.ndarray, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Mean of the rows ``ids[edges[i]:edges[i + 1]]``; a text longer than a slice is counted first, so no text gathers a row per token."""
    counts = np.diff(edges)
    out = np.zeros((len(counts), matrix.shape[1]))
    if len(counts) == 1 and counts[0] > SLICE_TOKENS:
        used, times = np.unique(ids, return_counts=True)
        for start in range(0, len(used), SLICE_TOKENS):
            part = slice(start, start + SLICE_TOKENS)
            out[0] += times[part] @ matrix[used[part]]
        return out / counts[0]
    filled = counts > 0
    if filled.any():
        out[filled] = np.add.reduceat(matrix[ids], edges[:-1][filled], axis=0) / counts[filled, None]
    return out


def embed_batches(df: DataFrame, text: str, table: DataFrame, config: ModelConfig, name: str = "embedding") -> DataFrame:
    """One vector per row of a loaded model.

    While the table fits a broadcast, texts are scored in Arrow batches without a shuffle. Beyond it each distinct text
    is embedded once through the relational lookup and joined back.
    """
    if not fits_broadcast(config):
        key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
        distinct = df.select(key.alias("_text_key"), F.col(text).alias("_text")).dropDuplicates(["_text_key"])
        vectors = embed_table(distinct, ["_text_key"], "_text", table, config).withColumnRenamed("embedding", "_vector")
        joined = df.withColumn("_text_key", key).join(vectors, "_text_key")
        return joined.select(*[F.col(c) for c in df.columns], F.col("_vector").alias(name))
    spark = df.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(table_matrix(table, config))
    normalize = config.normalize
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        for batch in (s for b in batches for s in text_slices(b, [place])):
            found = batch_ids(batch.column(place), config)
            edges, start = found.edges, 0
            while start < len(edges) - 1:
                stop = max(start + 1, int(np.searchsorted(edges, edges[start] + SLICE_TOKENS, side="right")) - 1)
                out = mean_rows(matrix, found.codes[edges[start] : edges[stop]], edges[start : stop + 1] - edges[start])
                columns = [*batch.slice(start, stop - start).columns, list_array(unit_rows(out) if normalize else out)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema.fields])
                start = stop

    return df.mapInArrow(run, schema)
