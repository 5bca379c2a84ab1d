"""Quality by the perplexity of an interpolated modified Kneser-Ney model.

The model counts byte 5-grams of trusted text (A-Z folded), so one exact 40-bit key is one n-gram and no word list is
needed. Counts are dealt to shards by the two bytes before the predicted one; a shard then holds everything that orders 3 to 5 need,
and only the tables of orders 1 and 2, at most 65,536 numbers, go to every task. Documents are scored in bounded batches: a batch asks each shard once
for its distinct n-grams, packed, and the answers meet the batch again. The threshold of a language is a quantile
over its trusted documents, exact on bits rounded to 1/10,000.

Defined cases: null and empty texts have no perplexity and are not kept; a null language is a group of its own; a language
without trusted text takes the quantile over all trusted documents, and without any trusted text everything with a
perplexity is kept. Rows with a null id are never trusted. Repeated rows are scored each, and trained on each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

ORDER = 5
QUANTILE = 0.99
SHARD_BYTES = 32 << 20
# Texts whose questions to one shard meet in one task; a frequent context's questions are split so.
PART_BYTES = 64 << 30
# A shard is a set of two-byte contexts; more shards than these hold nothing.
CONTEXTS = 1 << 16
SCALE = 10_000
_PAD = 10


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (common.mix((keys >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int32)


def grams(column) -> tuple[np.ndarray, np.ndarray]:
    """(key of the 5-gram that ends at each byte, document of the byte); each text starts after four line ends."""
    raw, offsets = common.text_buffer(column)
    lengths = np.diff(offsets)
    document = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(raw)) + (ORDER - 1) * (document + 1)
    padded = np.full(len(raw) + (ORDER - 1) * len(lengths) + 1, _PAD, np.uint8)
    padded[at] = common.ASCII_LOWER[raw]
    key = np.zeros(len(raw), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        key <<= np.uint64(8)
        key |= padded[at - back]
    return key, document


def _rows(shards: int, keys: np.ndarray, *more: np.ndarray) -> Iterator[tuple]:
    """(shard, packed keys, packed rest...) of sorted distinct keys."""
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    borders = np.searchsorted(shard[order], np.arange(shards + 1))
    for k in range(shards):
        mine = order[borders[k] : borders[k + 1]]
        if len(mine):
            yield (k, pack(keys[mine]), *[m[mine].tobytes() for m in more])


def pack(keys: np.ndarray) -> bytes:
    """Five bytes a key, the planes one after the other so that sorted keys compress."""
    return zstandard.compress(np.ascontiguousarray(keys.view(np.uint8).reshape(-1, 8)[:, :ORDER].T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(ORDER, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :ORDER] = planes.T
    return out.view(np.uint64).ravel()


def counted(shards: int):
    """Arrow mapper over trusted texts: each batch's 5-grams with counts, by shard."""

    def run(records) -> Iterator[pa.RecordBatch]:
        for table in common.batches(records):
            keys, counts = np.unique(grams(table.column("text"))[0], return_counts=True)
            for k, packed, number in _rows(shards, keys, counts.astype(np.int64)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary()), pa.array([number], pa.binary())], names=["shard", "keys", "counts"])

    return run


def levels(keys: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of orders 5, 4 and 3 from the 5-grams: lower orders count the different bytes before."""
    out = {ORDER: (keys, counts)}
    for order in (4, 3):
        out[order] = np.unique(out[order + 1][0] & np.uint64((1 << 8 * order) - 1), return_counts=True)
    return out


def merged(group: pa.Table) -> pa.Table:
    """One shard of the model, with the numbers of n-grams seen 1 to 4 times and what it adds to order 2."""
    keys = np.concatenate([unpack(k) for k in group.column("keys").to_pylist()])
    counts = np.concatenate([np.frombuffer(c, np.int64) for c in group.column("counts").to_pylist()])
    keys, place = np.unique(keys, return_inverse=True)
    counts = np.bincount(place, weights=counts).astype(np.int64)
    found = levels(keys, counts)
    seen = [[int((found[n][1] == k).sum()) for k in (1, 2, 3, 4)] for n in (5, 4, 3)]
    pairs, before = np.unique(found[3][0] & np.uint64(0xFFFF), return_counts=True)
    return pa.table(
        [
            pa.array([group.column("shard")[0].as_py()], pa.int32()), pa.array([pack(keys)], pa.binary()), pa.array([counts.tobytes()], pa.binary()),
            pa.array([seen], pa.list_(pa.list_(pa.int64()))), pa.array([pairs.astype(np.int64).tolist()], pa.list_(pa.int64())),
            pa.array([before.astype(np.int64).tolist()], pa.list_(pa.int64())),
        ],
        names=["shard", "keys", "counts", "seen", "pairs", "before"],
    )


def discounts(seen) -> np.ndarray:
    """Modified Kneser-Ney discounts of n-grams seen 0, once, twice and more often."""
    n1, n2, n3, n4 = (float(x) for x in seen)
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *np.clip(raw, [0.05, 0.05, 0.05], [1, 2, 3])])


class Level:
    """One order: discounted counts and what each context leaves to the next lower order."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, cut: np.ndarray):
        self.keys = keys
        self.contexts, place = np.unique(keys >> np.uint64(8), return_inverse=True)
        d = cut[np.minimum(counts, 3)]
        self.total = np.bincount(place, weights=counts, minlength=len(self.contexts))
        self.left = np.bincount(place, weights=d, minlength=len(self.contexts)) / np.maximum(self.total, 1)
        self.share = (counts - d) / self.total[place]

    def probability(self, asked: np.ndarray, lower: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return lower
        context = asked >> np.uint64(8)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        left = np.where(self.contexts[at] == context, self.left[at], 1.0)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.share[at], 0.0) + left * lower


def lowest(pairs: np.ndarray, before: np.ndarray) -> np.ndarray:
    """P(byte | byte before) as 65,536 numbers from the order 2 continuation counts."""
    count_of = lambda c: discounts([(c == k).sum() for k in (1, 2, 3, 4)])
    pairs = pairs.astype(np.uint64)
    order = np.argsort(pairs)
    pairs, before = pairs[order], before[order]
    single, kinds = np.unique(pairs & np.uint64(0xFF), return_counts=True)
    uniform = np.full(256, 1 / 256)
    every = np.arange(256, dtype=np.uint64)
    one = Level(single, kinds, count_of(kinds)).probability(every, uniform)
    asked = np.arange(1 << 16, dtype=np.uint64)
    return Level(pairs, before, count_of(before)).probability(asked, np.tile(one, 256))


def asked_grams(shards: int):
    """Arrow mapper: the distinct 5-grams of each batch, by shard."""

    def run(records) -> Iterator[pa.RecordBatch]:
        for table in common.batches(records):
            keys = np.unique(grams(table.column("text"))[0])
            name = batch_name(table, keys)
            for k, packed in _rows(shards, keys):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([name], pa.binary()), pa.array([packed], pa.binary())], names=["shard", "batch", "keys"])

    return run


def batch_name(table: pa.Table, keys: np.ndarray) -> bytes:
    name = hashlib.blake2b(digest_size=16)
    name.update(common.ids_of(table.column("doc_id")).tobytes())
    name.update(keys.tobytes())
    return name.digest()


def answered(pair_probability, cuts):
    """Cogroup function: the model's log2 probability of each n-gram that the batches ask of one shard."""

    def run(questions: pa.Table, model: pa.Table) -> pa.Table:
        if model.num_rows:
            keys, counts = unpack(model.column("keys")[0].as_py()), np.frombuffer(model.column("counts")[0].as_py(), np.int64)
        else:
            keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        found = levels(keys, counts)
        models = [Level(*found[n], cuts[n]) for n in (3, 4, 5)]
        batches, shards, out = [], [], []
        for batch, shard, packed in zip(*(questions.column(c).to_pylist() for c in ("batch", "shard", "keys"))):
            asked = unpack(packed)
            p = pair_probability[(asked & np.uint64(0xFFFF)).astype(np.int64)]
            for n, level in zip((3, 4, 5), models):
                p = level.probability(asked & np.uint64((1 << 8 * n) - 1), p)
            batches.append(batch)
            shards.append(shard)
            out.append(np.log2(np.maximum(p, 1e-12)).astype(np.float32).tobytes())
        return pa.table([pa.array(batches, pa.binary()), pa.array(shards, pa.int32()), pa.array(out, pa.binary())], names=["batch", "shard", "logs"])

    return run


def held(records) -> Iterator[pa.RecordBatch]:
    """Arrow mapper: each batch as one compressed row."""
    for table in common.batches(records):
        name = batch_name(table, np.unique(grams(table.column("text"))[0]))
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([common.packed_table(table)], pa.binary())], names=["batch", "packed"])


def summed(shards: int):
    """Cogroup function: bits per byte of each document of a batch from the answers of all shards."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise RuntimeError("a batch was read in two different ways; write the input table first")
        out = []
        answers = {k: logs for k, logs in zip(right.column("shard").to_pylist(), right.column("logs").to_pylist())}
        for blob in left.column("packed").to_pylist():
            table = common.unpacked_table(blob)
            every, document = grams(table.column("text"))
            keys, place = np.unique(every, return_inverse=True)
            shard = shard_of(keys, shards)
            logs = np.full(len(keys), np.nan)
            for k, values in answers.items():
                logs[shard == k] = np.frombuffer(values, np.float32)
            if np.isnan(logs).any():
                raise RuntimeError("a batch was read in two different ways; write the input table first")
            n = table.num_rows
            size = np.bincount(document, minlength=n)
            bits = -np.bincount(document, weights=logs[place], minlength=n) / np.maximum(size, 1)
            out.append(pa.table([table.column("doc_id").combine_chunks(), table.column("lang"), table.column("trusted"), pa.array(bits, mask=size == 0)], names=["doc_id", "lang", "trusted", "bits"]))
        return pa.concat_tables(out)

    return run


def scored(docs: DataFrame, trusted: DataFrame, shard_bytes: int = SHARD_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, lang, trusted, bits): bits per byte of every document under the model of the trusted ones.

    The batches' questions to a shard are dealt to parts by batch, each of which meets a copy of the shard's model.
    """
    ids = trusted.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(True))
    columns = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    source = common.small_join(columns, ids, ["doc_id"], ids.count(), 16).withColumn("trusted", F.coalesce("trusted", F.lit(False)))
    size = common.text_bytes(columns)
    shards, parts = min(CONTEXTS, common.parts_for(size, shard_bytes)), max(1, -(-size // part_bytes))
    counts = common.map_arrow(source.where("trusted").select("text"), counted(shards), "shard int, keys binary, counts binary")
    model = common.written(
        counts.groupBy("shard").applyInArrow(merged, "shard int, keys binary, counts binary, seen array<array<bigint>>, pairs array<bigint>, before array<bigint>"), "lm-shards"
    )
    seen = model.agg(*[F.sum(F.col("seen")[i][k]).alias(f"s{i}{k}") for i in range(3) for k in range(4)]).first()
    cuts = {n: discounts([seen[f"s{i}{k}"] or 0 for k in range(4)]) for i, n in enumerate((5, 4, 3))}
    # At most 65,536 rows, whatever the corpus.
    pairs = model.select(F.inline(F.arrays_zip("pairs", "before"))).groupBy("pairs").agg(F.sum("before").alias("n")).collect()
    table = lowest(np.array([r.pairs for r in pairs], np.int64), np.array([r.n for r in pairs], np.int64))
    asked = common.map_arrow(source.select("doc_id", "text"), asked_grams(shards), "shard int, batch binary, keys binary")
    dealt = asked.withColumn("part", F.pmod(F.xxhash64("batch"), F.lit(parts)).cast("int")).groupBy("shard", "part")
    copies = model.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "keys", "counts").groupBy("shard", "part")
    answers = dealt.cogroup(copies).applyInArrow(answered(table, cuts), "batch binary, shard int, logs binary")
    blobs = common.map_arrow(source, held, "batch binary, packed binary")
    return blobs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(summed(shards), "doc_id bigint, lang string, trusted boolean, bits double")


def thresholds(scores: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, limit): the quantile of rounded bits over the trusted documents of each language; over all of them in the row with ``every``."""
    trusted = scores.where("trusted and bits is not null").select("lang", F.round(F.col("bits") * SCALE).cast("bigint").alias("step"))
    counts = trusted.groupBy("lang", "step").count().withColumn("every", F.lit(False))
    both = counts.unionByName(counts.groupBy("step").agg(F.sum("count").alias("count")).select(F.lit(None).cast("string").alias("lang"), "step", "count", F.lit(True).alias("every")))
    # A language has at most 80,000 steps, so a window holds a bounded number of rows.
    w = Window.partitionBy("every", "lang")
    ranked = both.withColumn("below", F.sum("count").over(w.orderBy("step"))).withColumn("total", F.sum("count").over(w))
    return ranked.where(F.col("below") >= F.ceil(F.col("total") * quantile)).groupBy("every", "lang").agg((F.min("step") / SCALE).alias("limit"))


def judged(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per document: doc_id, lang, perplexity (per byte), limit, kept."""
    scores = common.written(scored(docs, trusted), "lm-scores")
    limits = common.written(thresholds(scores, quantile), "lm-limits")
    own = limits.where("not every").select(F.col("lang").alias("of_lang"), F.col("limit").alias("own"))
    every = limits.where("every").select(F.max("limit")).scalar()
    placed = scores.join(F.broadcast(own), F.col("lang").eqNullSafe(F.col("of_lang")), "left")
    limit = F.coalesce(F.col("own"), every)
    step = F.round(F.col("bits") * SCALE) / SCALE
    return placed.select("doc_id", "lang", F.pow(F.lit(2.0), "bits").alias("perplexity"), F.pow(F.lit(2.0), limit).alias("limit"), F.coalesce(F.col("bits").isNotNull() & (limit.isNull() | (step <= limit)), F.lit(False)).alias("kept"))
