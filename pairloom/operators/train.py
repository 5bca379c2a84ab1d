"""Triplet training of the token table as synchronous mini-batch steps.

A step reads the old table, sums the updates of all active triplets of the batch per token and
writes the new table. With one triplet per batch it is the sequential update rule.

A single step over a table small enough to broadcast is one narrow pass: every task embeds its
triplets, and hands on their losses and one summed update per token it touched. Only those sums are
shuffled. A larger table takes the relational way, a shuffled join of token rows with the table.
Training over many steps sends a small table along with each job and keeps a larger one dealt by token id on the executors.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from ..session import dropped_shuffles, forget, scratch_path, scratch_tables, ship_package, written
from .negatives import draw_rejecting, index_pool, pool_hash
from .ordering import hash_index, index_hashed
from .pairs import pool_of_pairs
from .table import SLICE_TOKENS, ModelConfig, count_ids, fits_broadcast, mean_rows, pooled, table_matrix, with_ids
from .tokens import list_array, unit_rows

ROLES = ("anchor", "positive", "negative")
# Triplets of a batch that lie in one file, and the most files a batch is spread over when it is written.
FILE_TRIPLETS, BATCH_FILES = 1024, 64
# Triplets of consecutive batches of at most FILE_TRIPLETS that one job takes.
RUN_TRIPLETS = 4096
# Token counts of a batch, rows x vocabulary, that are held whole.
_COUNT_CELLS = 1 << 20
# A table up to this size goes to each step with the job and comes back as sums; beyond it the table stays dealt.
HELD_TABLE_BYTES = 1 << 20
PAIR_KEYS = ["pkey"]
# Triplets computed together where the table stays dealt; triplets ordered at a time in the sequential rule.
PART_TRIPLETS = 256
# A batch of so many rows is one list; of larger ones blocks of so many bytes meet, and so many scores are held at a time.
LIST_ROWS, BLOCK_BYTES, _SCORE_CELLS = 256, 8 << 20, 1 << 21
SEQUENCE_ROWS = 20_000
# In place of a token id: the row holds counts.
_COUNTS_ROW = -1
_STEP = "tid bigint, loss double, token_id bigint, delta array<double>"


@dataclass(frozen=True)
class TrainOptions:
    epochs: int = 3
    learning_rate: float = 0.06
    margin: float = 0.2
    batch_size: int = 100_000
    seed: int = 42
    # One triplet after the other, as far as the result goes.
    sequential: bool = False


def tokenize(triplets: DataFrame, config: ModelConfig) -> DataFrame:
    """Replace the three texts by their token ids, which a step then reads twice."""
    return with_ids(triplets, {f"{r}_ids": r for r in ROLES}, config, [c for c in triplets.columns if c not in ROLES])


def _role_tokens(tokenized: DataFrame) -> DataFrame:
    """(tid, role, length, token_id, count) rows, placed by tid."""
    placed = tokenized.select("tid", *[f"{r}_ids" for r in ROLES]).repartition("tid")
    roles = F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"{r}_ids").alias("ids")) for r in ROLES]))
    return count_ids(placed.select("tid", roles), ["tid", "role"], "ids")


def _forward(tokens: DataFrame, table: DataFrame, config: ModelConfig) -> DataFrame:
    """One row per triplet with the three vectors; a role without tokens is null."""
    embedded = pooled(tokens, ["tid", "role"], "count", table, config)
    vec = V.l2_normalize(F.col("embedding")) if config.normalize else F.col("embedding")
    by_role = embedded.select("tid", "role", vec.alias("v"))
    return by_role.groupBy("tid").agg(*[F.max_by("v", F.when(F.col("role") == r, 1)).alias(r[0]) for r in ROLES])


def hinge(a: Column, p: Column, n: Column, margin: float) -> Column:
    """margin - a.p + a.n, not below 0; a missing vector gives 0."""
    loss = F.lit(margin) - V.dot(a, p) + V.dot(a, n)
    return F.greatest(F.coalesce(loss, F.lit(0.0)), F.lit(0.0))


def triplet_vectors(tokenized: DataFrame, table: DataFrame, config: ModelConfig, margin: float) -> DataFrame:
    """(tid, a, p, n, loss) of the triplets that have any token."""
    forward = _forward(_role_tokens(tokenized), table, config)
    return forward.withColumn("loss", hinge(F.col("a"), F.col("p"), F.col("n"), margin))


def losses_of(triplets: DataFrame, vectors: DataFrame) -> DataFrame:
    losses = triplets.select("tid").join(vectors.select("tid", "loss"), "tid", "left")
    return losses.select("tid", F.coalesce("loss", F.lit(0.0)).alias("loss"))


@dataclass(frozen=True)
class Step:
    """Losses (tid, loss) and summed updates (token_id, delta) of one batch."""

    losses: DataFrame
    updates: DataFrame
    held: Broadcast | None = None

    def release(self) -> None:
        """Drop the table copies of this step, once its result is kept."""
        if self.held is not None:
            self.held.destroy()


def run_step(
    tokenized: DataFrame, table: DataFrame, config: ModelConfig, learning_rate: float, margin: float, keep: Callable = lambda df: df
) -> Step:
    """One forward and backward pass; ``keep`` may write its result, which losses and updates share."""
    if fits_broadcast(config):
        shared = tokenized.sparkSession.sparkContext.broadcast(table_matrix(table, config))
        both = keep(_narrow_pass(tokenized, shared, config, learning_rate, margin))
        return Step(both.where(F.col("tid").isNotNull()).select("tid", "loss"), _summed(both), shared)
    vectors = keep(triplet_vectors(tokenized, table, config, margin))
    return Step(losses_of(tokenized, vectors), gradients_of(tokenized, vectors, learning_rate))


def _narrow_pass(
    tokenized: DataFrame, shared: Broadcast, config: ModelConfig, learning_rate: float, margin: float
) -> DataFrame:
    """Rows (tid, loss) for triplets and (token_id, delta) for each task's summed updates."""
    spark = tokenized.sparkSession
    ship_package(spark)
    normalize = config.normalize
    columns = ["tid", *[f"{r}_ids" for r in ROLES]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        total, touched = np.zeros_like(matrix), np.zeros(len(matrix), dtype=bool)
        for batch in batches:
            roles = [RoleTokens.of(batch.column(i)) for i in (1, 2, 3)]
            losses = _learn(matrix, roles, normalize, learning_rate, margin, total, touched)
            yield _step_rows(batch.column(0), pa.array(losses), None, None)
        used = np.flatnonzero(touched)
        if len(used):
            yield _step_rows(None, None, pa.array(used), list_array(total[used]))

    return tokenized.select(*columns).mapInArrow(run, _STEP)


def _learn(matrix, roles: list[RoleTokens], normalize: bool, learning_rate: float, margin: float, total, touched) -> np.ndarray:
    """Losses of some triplets; their updates are added to ``total`` and the rows they reach marked in ``touched``."""
    rows = len(roles[0].edges) - 1
    losses = np.zeros(rows)
    start = 0
    while start < rows:
        stop = min(r.stop_after(start) for r in roles)
        parts = [r.rows(start, stop) for r in roles]
        a, p, n = [mean_rows(matrix, ids, edges) for ids, edges in parts]
        if normalize:
            a, p, n = unit_rows(a), unit_rows(p), unit_rows(n)
        filled = np.all([np.diff(edges) > 0 for _ids, edges in parts], axis=0)
        loss = np.where(filled, margin - (a * p).sum(axis=1) + (a * n).sum(axis=1), 0.0)
        losses[start:stop] = np.maximum(loss, 0.0)
        for (ids, edges), gradient in zip(parts, (n - p, -a, a)):
            _spread_updates(total, touched, ids, edges, gradient, loss > 0, learning_rate)
        start = stop
    return losses


def _learn_counted(matrix, roles: list[RoleTokens], normalize: bool, learning_rate: float, margin: float, total, touched) -> np.ndarray:
    """``_learn`` of few rows over a small table: tokens are counted once, vectors and updates are products with the counts."""
    rows, vocab = len(roles[0].edges) - 1, len(matrix)
    shares = []
    for role in roles:
        lengths = np.diff(role.edges)
        cells = np.repeat(np.arange(rows) * vocab, lengths) + role.ids
        shares.append(np.bincount(cells, minlength=rows * vocab).reshape(rows, vocab) / np.maximum(lengths, 1)[:, None])
    a, p, n = [unit_rows(share @ matrix) if normalize else share @ matrix for share in shares]
    filled = np.all([np.diff(r.edges) > 0 for r in roles], axis=0)
    losses = np.maximum(np.where(filled, margin - (a * p).sum(axis=1) + (a * n).sum(axis=1), 0.0), 0.0)
    active = losses > 0
    for share, gradient in zip(shares, (n - p, -a, a)):
        share = share[active]
        total += learning_rate * (share.T @ gradient[active])
        touched |= share.any(axis=0)
    return losses


# --- a small table that goes along with each step --------------------------------------------


def held_step(tokenized: DataFrame, matrix: np.ndarray, config: ModelConfig, learning_rate: float, margin: float, one_by_one: bool) -> tuple[np.ndarray, np.ndarray]:
    """(steps, active steps and their loss, summed updates) of one pass over a table that is a few rows beside its triplets: one job.

    A task hands back its counts and one row per token it touched. With ``one_by_one`` (batches of few files) the driver adds up the tasks' rows,
    otherwise they are summed by token first, so what the driver gets is bounded by the table.
    """
    spark = tokenized.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(matrix)
    normalize = config.normalize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value
        total, touched, counts = np.zeros_like(matrix), np.zeros(len(matrix), dtype=bool), np.zeros(3)
        for batch in batches:
            losses = _learn(matrix, [RoleTokens.of(batch.column(i)) for i in range(3)], normalize, learning_rate, margin, total, touched)
            counts += len(losses), (losses > 0).sum(), losses.sum()
        used = np.flatnonzero(touched)
        yield pa.RecordBatch.from_arrays([pa.array([_COUNTS_ROW]), list_array(counts[None, :])], names=["token_id", "delta"])
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), list_array(total[used])], names=["token_id", "delta"])

    found = tokenized.select(*[f"{r}_ids" for r in ROLES]).mapInArrow(run, "token_id bigint, delta array<double>")
    rows = (found if one_by_one else _vector_sums(found)).toArrow()
    shared.destroy()
    counts, updates = np.zeros(3), np.zeros_like(matrix)
    for token, delta in zip(rows.column("token_id").to_pylist(), rows.column("delta").to_pylist()):
        if token == _COUNTS_ROW:
            counts += delta
        else:
            updates[token] += delta
    return counts, updates


def held_run(tokenized: DataFrame, matrix: np.ndarray, config: ModelConfig, learning_rate: float, margin: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps, active steps and their loss, the matrix after them) of a run of batches of ``size`` triplets each: one job.

    A small batch is one task's work and the next one waits for it, so one task takes a run of them, bounded in triplets, one after the other. It hands back its counts
    and the rows of the tokens it touched.
    """
    spark = tokenized.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(matrix)
    normalize = config.normalize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = shared.value.copy()
        total, touched, changed, counts, step = np.zeros_like(matrix), np.zeros(len(matrix), dtype=bool), np.zeros(len(matrix), dtype=bool), np.zeros(3), None

        def end_step() -> None:
            used = np.flatnonzero(touched)
            matrix[used] -= total[used]
            total[used], touched[used], changed[used] = 0.0, False, True

        for batch in batches:
            own = batch.column(0).to_numpy() // size
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for low, high in zip(edges[:-1], edges[1:]):
                if low == high:
                    continue
                if own[low] != step:
                    end_step()
                    step = own[low]
                roles = [RoleTokens.of(batch.column(i).slice(low, high - low)) for i in (1, 2, 3)]
                learn = _learn_counted if (high - low) * len(matrix) <= _COUNT_CELLS else _learn
                losses = learn(matrix, roles, normalize, learning_rate, margin, total, touched)
                counts += len(losses), (losses > 0).sum(), losses.sum()
        end_step()
        used = np.flatnonzero(changed)
        yield pa.RecordBatch.from_arrays([pa.array([_COUNTS_ROW]), list_array(counts[None, :])], names=["token_id", "delta"])
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used), list_array(matrix[used])], names=["token_id", "delta"])

    ordered = tokenized.select("tid", *[f"{r}_ids" for r in ROLES]).coalesce(1).sortWithinPartitions("tid")
    rows = ordered.mapInArrow(run, "token_id bigint, delta array<double>").toArrow()
    shared.destroy()
    counts, new = np.zeros(3), matrix.copy()
    for token, row in zip(rows.column("token_id").to_pylist(), rows.column("delta").to_pylist()):
        if token == _COUNTS_ROW:
            counts += row
        else:
            new[token] = row
    return counts, new


# --- a table that stays dealt by token -------------------------------------------------------


@dataclass(frozen=True)
class DealtTable:
    """A token table in buckets of token ids. Its files lie in the scratch folder; the session's catalog holds only their description."""

    rows: DataFrame
    name: str

    def forget(self) -> None:
        self.rows.sparkSession.sql(f"DROP TABLE IF EXISTS {self.name}")


def dealt_table(table: DataFrame, buckets: int) -> DealtTable:
    """The table written so that joins by token id that many partitions wide need not move it."""
    spark = table.sparkSession
    path = scratch_path(spark, "table")
    name = os.path.basename(path).replace("-", "_")
    table.select("token_id", "vec").repartition(buckets, "token_id").write.bucketBy(buckets, "token_id").sortBy("token_id").option("path", path).saveAsTable(name)
    return DealtTable(spark.table(name), name)


def dealt_step(tokenized: DataFrame, table: DataFrame, config: ModelConfig, learning_rate: float, margin: float, keep: Callable = lambda df: df) -> Step:
    """One forward and backward pass that neither broadcasts the table nor brings it to the driver.

    Triplets go in parts of bounded size. A part asks for the rows of its distinct tokens where the table lies, computes with those alone and sends back
    one summed update per token. What moves is rows that are asked for and updates.
    """
    spark = tokenized.sparkSession
    ship_package(spark)
    normalize, dim = config.normalize, config.embedding_dim
    ids = [f"{r}_ids" for r in ROLES]
    parts = max(1, -(-tokenized.count() // PART_TRIPLETS))
    placed = tokenized.select("tid", *ids).withColumn("part", F.pmod(F.xxhash64("tid"), F.lit(parts)).cast("int"))
    asked = placed.select(F.col("part").alias("asker"), F.explode(F.array_distinct(F.concat(*ids).cast("array<bigint>"))).alias("token_id")).distinct()
    pulled = table.hint("merge").join(asked, "token_id").select("asker", "token_id", "vec")

    def run(triplets: pa.Table, rows: pa.Table) -> pa.Table:
        triplets, rows = triplets.combine_chunks(), rows.combine_chunks()
        known = rows.column("token_id").to_numpy()
        order = np.argsort(known)
        known = known[order]
        matrix = _flat(rows.column("vec")).reshape(-1, dim)[order]
        roles = [RoleTokens.of(_one(triplets.column(c))) for c in ids]
        roles = [RoleTokens(np.searchsorted(known, r.ids), r.edges) for r in roles]
        total, touched = np.zeros_like(matrix), np.zeros(len(matrix), dtype=bool)
        losses = _learn(matrix, roles, normalize, learning_rate, margin, total, touched)
        used = np.flatnonzero(touched)
        found = [_step_rows(_one(triplets.column("tid")), pa.array(losses), None, None), _step_rows(None, None, pa.array(known[used]), list_array(total[used]))]
        return pa.Table.from_batches(found)

    both = keep(placed.groupBy("part").cogroup(pulled.groupBy("asker")).applyInArrow(run, _STEP))
    return Step(both.where(F.col("tid").isNotNull()).select("tid", "loss"), _summed(both))


def _summed(both: DataFrame) -> DataFrame:
    return _vector_sums(both.where(F.col("token_id").isNotNull()))


def _vector_sums(rows: DataFrame) -> DataFrame:
    sums = rows.select("token_id", array_to_vector("delta").alias("_v"))
    return sums.groupBy("token_id").agg(vector_to_array(Summarizer.sum(F.col("_v"))).alias("delta"))


def _one(column: pa.ChunkedArray) -> pa.Array:
    """A combined column's only chunk."""
    return column.chunk(0) if column.num_chunks else pa.array([], column.type)


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return _one(column).flatten().to_numpy(zero_copy_only=False)


def conflict_levels(tokenized: DataFrame) -> DataFrame:
    """``tokenized`` with a ``level``: triplets of one level share no token, and one that shares a token with an earlier triplet has a higher level.

    Steps by level, all triplets of a level at once, therefore see and leave every row as one triplet after the other does. The rows, a bounded
    batch, are ordered by ``tid`` in one task; only ids go there.
    """
    ids = [f"{r}_ids" for r in ROLES]
    schema = tokenized.select("tid").schema.add("level", T.LongType())

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("tid").combine_chunks()
        roles = [RoleTokens.of(_one(rows.column(c))) for c in ids]
        last: dict[int, int] = {}
        levels = []
        for i in range(rows.num_rows):
            used = {t for r in roles for t in r.ids[r.edges[i] : r.edges[i + 1]].tolist()}
            level = 1 + max((last.get(t, 0) for t in used), default=0)
            last.update(dict.fromkeys(used, level))
            levels.append(level)
        return pa.table({"tid": rows.column("tid"), "level": pa.array(levels, pa.int64())})

    found = tokenized.select(F.lit(0).alias("_batch"), "tid", *ids).groupBy("_batch").applyInArrow(lambda rows: run(rows.drop_columns(["_batch"])), schema)
    return tokenized.join(found, "tid")


@dataclass(frozen=True)
class RoleTokens:
    """Token ids of one role: ``ids[edges[i]:edges[i + 1]]`` belong to row i."""

    ids: np.ndarray
    edges: np.ndarray

    @staticmethod
    def of(column: pa.ListArray) -> RoleTokens:
        edges = column.offsets.to_numpy().astype(np.int64)
        return RoleTokens(column.flatten().to_numpy(), edges - edges[0])

    def stop_after(self, start: int) -> int:
        """End of the run of rows from ``start`` whose tokens fit one slice; at least one row."""
        within = int(np.searchsorted(self.edges, self.edges[start] + SLICE_TOKENS, side="right")) - 1
        return max(start + 1, within)

    def rows(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        edges = self.edges[start : stop + 1]
        return self.ids[edges[0] : edges[-1]], edges - edges[0]


def _spread_updates(total, touched, ids, edges, gradient, active, learning_rate) -> None:
    """Add each active row's gradient x rate / length to all its token occurrences."""
    counts = np.diff(edges)
    row = np.repeat(np.arange(len(counts)), counts)
    live = active[row]
    row, ids = row[live], ids[live]
    if len(ids) == 0:
        return
    used, place = np.unique(ids, return_inverse=True)
    share = np.bincount(place * len(counts) + row, weights=learning_rate / counts[row], minlength=len(used) * len(counts))
    total[used] += share.reshape(len(used), len(counts)) @ gradient
    touched[used] = True


def _step_rows(tid, loss, token_id, delta) -> pa.RecordBatch:
    size = len(tid if tid is not None else token_id)
    kinds = (pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))
    columns = [pa.nulls(size, t) if c is None else c for c, t in zip((tid, loss, token_id, delta), kinds)]
    return pa.RecordBatch.from_arrays(columns, names=["tid", "loss", "token_id", "delta"])


def triplet_loss(triplets: DataFrame, table: DataFrame, config: ModelConfig, margin: float) -> DataFrame:
    """(tid, loss) of every triplet."""
    return run_step(tokenize(triplets, config), table, config, 0.0, margin).losses


def gradients_of(tokenized: DataFrame, vectors: DataFrame, learning_rate: float) -> DataFrame:
    """(token_id, delta): the amount each touched token row is lowered by in one step.

    Inactive triplets leave before anything is expanded; the sum per token combines on the map side,
    so a word found in most texts is no hot key.
    """
    active = vectors.where(F.col("loss") > 0).select("tid", "a", "p", "n")
    a, p, n = F.col("a"), F.col("p"), F.col("n")
    gradient = (
        F.when(F.col("role") == "anchor", V.subtract(n, p))
        .when(F.col("role") == "positive", F.transform(a, lambda x: -x))
        .otherwise(a)
    )
    # Joined by tid alone: both sides are already placed by it.
    steps = _role_tokens(tokenized).join(active, "tid").select(
        "token_id",
        array_to_vector(gradient).alias("g"),
        (F.lit(learning_rate) * F.col("count") / F.col("length")).alias("w"),
    )
    # The weighted mean times the total weight: the summarizer's own sum ignores the weights.
    mean = Summarizer.metrics("mean").summary(F.col("g"), F.col("w")).getField("mean")
    total = steps.groupBy("token_id").agg(vector_to_array(mean).alias("_mean"), F.sum("w").alias("_w"))
    return total.select("token_id", V.scale(F.col("_mean"), F.col("_w")).alias("delta"))


def triplet_gradients(
    triplets: DataFrame, table: DataFrame, config: ModelConfig, learning_rate: float, margin: float
) -> DataFrame:
    return run_step(tokenize(triplets, config), table, config, learning_rate, margin).updates


def apply_gradients(table: DataFrame, gradients: DataFrame) -> DataFrame:
    joined = table.join(gradients, "token_id", "left")
    vec = F.when(F.col("delta").isNull(), F.col("vec")).otherwise(V.subtract(F.col("vec"), F.col("delta")))
    return joined.select("token_id", vec.alias("vec"))


def train_step(
    triplets: DataFrame, table: DataFrame, config: ModelConfig, learning_rate: float, margin: float
) -> DataFrame:
    return apply_gradients(table, triplet_gradients(triplets, table, config, learning_rate, margin))


def with_pair_key(pairs: DataFrame) -> DataFrame:
    """Add ``pkey``, the digest of (anchor, positive, copy) that keys every draw and order.

    Identical pairs differ by their copy number; lengths before the texts keep pairs apart whose texts hold the separator. Keying by the digest reads the long texts once,
    however many draws follow.
    """
    numbered = pairs if "copy" in pairs.columns else pairs.withColumn("copy", F.lit(1).cast("bigint"))
    sized = [F.concat_ws("|", F.length(c).cast("string"), F.col(c)) for c in ("anchor", "positive")]
    return numbered.withColumn("pkey", F.md5(F.concat_ws("|", *sized, F.col("copy").cast("string"))))


def epoch_order(pairs: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Pairs with their position in the keyed shuffle of this epoch."""
    return hash_index(pairs, seed, f"epoch{epoch}", PAIR_KEYS, "position")


def epoch_triplets(pairs: DataFrame, indexed_pool: DataFrame, options: TrainOptions, epoch: int) -> DataFrame:
    """Shuffled pairs with a drawn negative, a batch number and ``tid`` = position."""
    ordered = epoch_order(pairs, options.seed, epoch)
    drawn = draw_rejecting(ordered, indexed_pool, options.seed + epoch, PAIR_KEYS)
    batch = F.floor(F.col("position") / options.batch_size).cast("bigint")
    return drawn.select(F.col("position").alias("tid"), batch.alias("batch"), *ROLES)


def epoch_summary(losses: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Steps, active steps and mean loss over active steps only (0 without any)."""
    active = F.col("loss") > 0
    return losses.groupBy(*by).agg(
        F.count("*").alias("steps"),
        F.count_if(active).alias("active_steps"),
        F.coalesce(F.avg(F.when(active, F.col("loss"))), F.lit(0.0)).alias("mean_active_loss"),
    )


def train_epochs(
    pairs: DataFrame, table: DataFrame, config: ModelConfig, options: TrainOptions, kept: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Train on keyed pairs over all epochs; returns the final table and one summary row per epoch.

    Each distinct text is tokenised once. Pairs and drawn negatives are places in the pool, so orders and draws move small rows; an epoch's triplets get their token ids
    last. They are written in a folder per run of batches, which is deleted when the epoch is over. A table within ``HELD_TABLE_BYTES``, less than
    a batch of texts, goes along with each job: one for each run of small batches (``held_run``) or for each large batch (``held_step``). A larger one lies in buckets of
    token ids from step to step: a step sends requests to it and updates back, and neither the driver nor a broadcast ever holds it; every step writes its pass and
    the new table as Parquet, so lineage stays one step deep and a lost executor costs one step. Either way plans do not grow with the batches.

    With ``sequential`` the result is that of one triplet after the other: a batch, then at most ``SEQUENCE_ROWS`` triplets, is taken in levels that share no token.
    ``kept`` says that the pairs are a written table, which is read twice.
    """
    size = min(options.batch_size, SEQUENCE_ROWS) if options.sequential else options.batch_size
    small = config.vocab_size * config.embedding_dim * 8 <= HELD_TABLE_BYTES
    in_runs = small and not options.sequential and size <= FILE_TRIPLETS
    with scratch_tables(pairs.sparkSession) as keep:
        pool, placed = _placed_pairs(pairs if kept else keep(pairs, "pairs"), config, options.seed, keep)
        steps = _epoch_steps(placed, pool, replace(options, batch_size=size), max(1, RUN_TRIPLETS // size) if in_runs else 1)
        if not small:
            return _train_dealt(steps, table, config, options)
        rate, margin = options.learning_rate, options.margin
        if in_runs:
            return _train_held(steps, table, lambda part, matrix: held_run(part, matrix, config, rate, margin, size), config)

        def step(part: DataFrame, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found, updates = held_step(part, matrix, config, rate, margin, size <= 8 * FILE_TRIPLETS)
            return found, matrix - updates

        return _train_held(steps, table, step, config)


def _placed_pairs(pairs: DataFrame, config: ModelConfig, seed: int, keep: Callable) -> tuple[DataFrame, DataFrame]:
    """The pool (pool_idx, text_id, ids) of the pairs' distinct texts in the order of ``index_pool``, and the pairs (pkey, anchor, positive) as places in it.

    A text is known by its digest, ``text_id``; of a hash that two texts share, the beginnings of the texts decide.
    """
    text = F.col("negative")
    named = pool_of_pairs(pairs).select("negative", F.sha2(text, 256).alias("text_id"), F.substring(text, 1, 32).alias("head"), pool_hash(text, seed).alias("_h"))
    tokens = keep(with_ids(named, {"ids": "negative"}, config, ["text_id", "head", "_h"]), "texts")
    # The order of a text's tokens counts no more, and sorted ids are short when packed.
    pool = keep(index_hashed(tokens.withColumn("ids", F.sort_array("ids")), ["head", "text_id"], "pool_idx").drop("head"), "pool")
    if pool.count() < 2:
        raise ValueError("fewer than two texts to draw negatives from")
    sides = pairs.select(*PAIR_KEYS, *[F.sha2(c, 256).alias(f"_{c}") for c in ("anchor", "positive")])
    for c in ("anchor", "positive"):
        sides = sides.join(pool.select(F.col("text_id").alias(f"_{c}"), F.col("pool_idx").alias(c)), f"_{c}", "left")
    return pool, keep(sides.select(*PAIR_KEYS, "anchor", "positive"), "places")


def _epoch_steps(placed: DataFrame, pool: DataFrame, options: TrainOptions, run: int) -> Iterator[tuple[int, DataFrame]]:
    """(epoch, tokenised triplets of ``run`` batches, or of a level of one batch) in the order of training."""
    spark, size = placed.sparkSession, options.batch_size
    files = min(BATCH_FILES, -(-size // FILE_TRIPLETS))
    # A null text is drawn, and then is no negative.
    drawable = pool.select("pool_idx", F.when(F.col("text_id").isNotNull(), F.col("pool_idx")).alias("negative"))
    ids = pool.select(F.col("pool_idx").alias("place"), "ids")
    nothing = F.array().cast("array<int>")
    for epoch in range(1, options.epochs + 1):
        triplets = epoch_triplets(placed, drawable, options, epoch)
        texts = F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("place")) for r in ROLES]))
        own = [F.floor(F.col("batch") / run).cast("bigint").alias("run"), F.pmod("tid", F.lit(files)).alias("file")]
        asked = triplets.select("tid", *own, texts).join(ids, "place", "left").repartition("run", "file")
        whole = asked.groupBy("run", "file", "tid").agg(
            *[F.coalesce(F.max_by("ids", F.when(F.col("role") == r, 1)), nothing).alias(f"{r}_ids") for r in ROLES]
        ).drop("file")
        path = scratch_path(spark, "triplets")
        with dropped_shuffles(spark):
            whole.write.partitionBy("run").parquet(path)
        written_runs = spark.read.schema(whole.schema).parquet(path).select("run").distinct().collect()
        for number in sorted(r["run"] for r in written_runs):
            part = spark.read.schema(whole.drop("run").schema).parquet(f"{path}/run={number}")
            for step in _steps_of(part, options.sequential):
                yield epoch, step
        forget(spark, path)


def _train_held(steps: Iterator[tuple[int, DataFrame]], table: DataFrame, step: Callable, config: ModelConfig) -> tuple[DataFrame, DataFrame]:
    """``step(part, matrix)`` gives the counts of the part and the next matrix."""
    spark = table.sparkSession
    matrix = table_matrix(table, config)
    counts: dict[int, np.ndarray] = {}
    for epoch, part in steps:
        found, matrix = step(part, matrix)
        counts[epoch] = counts.get(epoch, 0) + found
    rows = [(epoch, int(n), int(active), float(loss / active) if active else 0.0) for epoch, (n, active, loss) in counts.items() if n]
    history = spark.createDataFrame(rows, "epoch bigint, steps bigint, active_steps bigint, mean_active_loss double")
    new = spark.createDataFrame(pa.table({"token_id": pa.array(np.arange(len(matrix))), "vec": list_array(matrix)}))
    return written(new.join(table.select("token_id"), "token_id", "left_semi"), "trained"), history


def _train_dealt(steps: Iterator[tuple[int, DataFrame]], table: DataFrame, config: ModelConfig, options: TrainOptions) -> tuple[DataFrame, DataFrame]:
    spark = table.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    losses_path = scratch_path(spark, "losses")
    dealt = dealt_table(table, buckets)
    for epoch, part in steps:
        step = dealt_step(part, dealt.rows, config, options.learning_rate, options.margin, lambda df: written(df, "step"))
        step.losses.select(F.lit(epoch).cast("bigint").alias("epoch"), "tid", "loss").write.mode("append").parquet(losses_path)
        old, dealt = dealt, dealt_table(apply_gradients(dealt.rows.hint("merge"), step.updates), buckets)
        old.forget()
    history = epoch_summary(spark.read.schema("epoch bigint, tid bigint, loss double").parquet(losses_path), ("epoch",))
    final = written(dealt.rows, "trained")
    dealt.forget()
    return final, history


def _steps_of(batch: DataFrame, sequential: bool) -> Iterator[DataFrame]:
    """The batch, or its levels of triplets without a common token, in order."""
    if not sequential:
        yield batch
        return
    path = scratch_path(batch.sparkSession, "levels")
    conflict_levels(batch).write.partitionBy("level").parquet(path)
    last = batch.sparkSession.read.parquet(path).agg(F.max("level")).first()[0]
    for level in range(1, (last or 0) + 1):
        yield batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/level={level}")


def inbatch_rank_loss(batched: DataFrame, scale: float = 20.0, most_rows: int | None = None, list_rows: int = LIST_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Softmax loss of every anchor against all positives of its batch, mean per batch; ``batched`` has (batch, a, p).

    ``most_rows`` is a known bound of the batches; without it they are written once and counted. Batches of up to ``list_rows`` rows are one short list each. Of larger ones blocks of anchors meet blocks of positives, and each meeting gives an
    anchor the largest score and the sum of exponentials relative to it, which are merged over the blocks: memory is that of two blocks whatever the batch.
    """
    if most_rows is not None and most_rows <= list_rows:
        return _listed_loss(batched, scale)
    batched = written(batched, "batched")
    sizes = batched.groupBy("batch").agg(F.count("*").alias("_rows"), F.max(F.size("a")).alias("_dim"))
    large = written(sizes.where(F.col("_rows") > list_rows), "batches")
    if large.isEmpty():
        return _listed_loss(batched, scale)
    small = _listed_loss(batched.join(large, "batch", "left_anti"), scale)
    return small.unionByName(_blocked_loss(batched, large, scale, block_bytes))


def _listed_loss(batched: DataFrame, scale: float) -> DataFrame:
    rows = batched.groupBy("batch").agg(F.collect_list(F.struct("a", "p")).alias("rows"))
    positives = F.transform("rows", lambda r: r["p"])
    logits = lambda r: F.transform(positives, lambda p: V.dot(r["a"], p) * scale)

    def loss(own, values):
        top = F.array_max(values)
        total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.log(total) + top - own

    scored = rows.select("batch", F.explode(F.transform("rows", lambda r: F.struct((V.dot(r["a"], r["p"]) * scale).alias("own"), logits(r).alias("all")))).alias("s"))
    return scored.groupBy("batch").agg(
        F.count("*").alias("size"), F.avg(loss(F.col("s.own"), F.col("s.all"))).alias("loss")
    )


def _blocked_loss(batched: DataFrame, large: DataFrame, scale: float, block_bytes: int) -> DataFrame:
    """Loss of the batches in ``large(batch, _rows, _dim)``."""
    spark = batched.sparkSession
    ship_package(spark)
    # Numbered once and written, so that a row keeps its block when it is read again.
    rows = written(batched.join(large, "batch").withColumn("_id", F.monotonically_increasing_id()), "rows")
    blocks = F.ceil(F.col("_rows") * F.col("_dim") * 8 / block_bytes).cast("int")
    placed = rows.withColumn("_blocks", blocks).withColumn("_block", F.pmod(F.xxhash64("_id"), "_blocks").cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    own = (V.dot(F.col("a"), F.col("p")) * scale).alias("own")
    left = placed.select("batch", F.col("_block").alias("i"), every.alias("j"), "_id", "a", own)
    right = placed.select("batch", every.alias("i"), F.col("_block").alias("j"), "p")
    schema = T.StructType([batched.schema["batch"], *[T.StructField(n, T.DoubleType()) for n in ("own", "top", "total")], T.StructField("_id", T.LongType())])

    def run(anchors: pa.Table, positives: pa.Table) -> pa.Table:
        anchors, positives = anchors.combine_chunks(), positives.combine_chunks()
        if not anchors.num_rows or not positives.num_rows:
            return anchors.select(["batch", "own"]).append_column("top", anchors.column("own")).append_column("total", anchors.column("own")).append_column("_id", anchors.column("_id")).slice(0, 0)
        a = _flat(anchors.column("a")).reshape(anchors.num_rows, -1)
        p = _flat(positives.column("p")).reshape(positives.num_rows, -1)
        top, total = np.empty(len(a)), np.empty(len(a))
        step = max(1, _SCORE_CELLS // len(p))
        for start in range(0, len(a), step):
            part = slice(start, start + step)
            scores = a[part] @ p.T * scale
            top[part] = scores.max(axis=1)
            total[part] = np.exp(scores - top[part, None]).sum(axis=1)
        return anchors.select(["batch", "own"]).append_column("top", pa.array(top)).append_column("total", pa.array(total)).append_column("_id", anchors.column("_id"))

    on = ["batch", "i", "j"]
    met = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(run, schema)
    # One entry per block of positives.
    merged = met.groupBy("batch", "_id").agg(F.first("own").alias("own"), F.max("top").alias("top"), F.collect_list(F.struct("top", "total")).alias("parts"))
    total = F.aggregate("parts", F.lit(0.0), lambda acc, x: acc + x["total"] * F.exp(x["top"] - F.col("top")))
    losses = merged.select("batch", (F.log(total) + F.col("top") - F.col("own")).alias("loss"))
    return losses.groupBy("batch").agg(F.count("*").alias("size"), F.avg("loss").alias("loss"))


def loss_batches(pairs: DataFrame, seed: int, keys: list[str], batch_size: int) -> DataFrame:
    """Shuffled batches of at most ``batch_size`` rows."""
    ordered = hash_index(pairs, seed, "batch", keys, "position")
    return ordered.withColumn("batch", F.floor(F.col("position") / batch_size).cast("bigint"))
