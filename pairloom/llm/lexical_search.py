"""Ranked lexical search over an index stratified by document length.

A document's score for a term depends on nothing but the term, how often the document holds it (tf) and the document's normaliser m, a whole
number that its length gives. So documents of equal m are a stratum, and inside a stratum a term's postings are runs of
equal tf: an impact is computed once per run and added to all its documents. A stratum knows the largest tf of each term, which bounds what a
document in it can score for an item.

Building: one pass over the texts writes each document's length, distinct terms and their tf; the lengths give N, L and m. These rows are dealt by ranges of m of
equal bytes (a stratum of any size goes over several), and each task turns its sorted rows into chunks of one stratum and at most ``CHUNK_BYTES`` of
terms. Terms are kept as strings, so nothing rests on fingerprints. The index is written to the shared folder.

Searching: items come in blocks of bounded size. One pass over the terms of the chunks gives df, a second the chunks with the highest bounds for each item; these are visited first
and their k-th score is a floor. The last pass goes through all chunks, in each task again by descending bound, and leaves out a chunk for an item if its
bound is below the floor or below the k-th score that the task has found. What is left out cannot reach the result; equal bounds are visited since
ties go by id.

Defined cases: null and empty texts hold no term and are in no result, as are scores of 0. Rows that repeat an id are documents of their own with ranks of
their own; a null id comes last among equal scores. Rows of one item id are one item; a null item id is an item. An item without terms has no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import common

TOP = 50
CHUNK_BYTES = 2 << 20
SEPARATOR = "\n"
# Terms and counts dealt to one task of the build.
SHARD_BYTES = 32 << 20
# Terms of items searched at once, and chunks visited first for an item.
BLOCK_TERMS = 100_000
FIRST_VISITS = 4
# Scores held at a time in a task: 2M whole numbers are 16 MB.
CELLS = 1 << 21
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# The bytes of a term, ASCII letters and digits and all of other characters.
_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[0x30:0x3A] = _IN_TERM[0x41:0x5B] = _IN_TERM[0x61:0x7B] = _IN_TERM[0x80:] = True
_COUNTED = "doc_id bigint, n bigint, terms string, tf binary"
# ``heads`` holds the terms with their df and largest tf, ``body`` documents, runs and postings, both compressed.
_CHUNK = "m bigint, chunk string, size int, heads binary, body binary"
_HEADS, _BODY = (np.uint8, np.int32, np.int32), (np.int64, np.int32, np.int32, np.int32, np.int32)
_FOUND = "item int, doc_id bigint, score bigint"


@dataclass(frozen=True)
class Corpus:
    """Documents with a term, and all their terms with repeats."""

    documents: int
    terms: int

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))

    def normaliser(self, length: str) -> Column:
        return F.expr(f"50 + (50L * {length} * {self.documents}L) div {max(self.terms, 1)}L")


@dataclass(frozen=True)
class Index:
    corpus: Corpus
    chunks: DataFrame


def impact(tf: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


# --- building --------------------------------------------------------------------------------


def build(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of all documents that hold a term, written to the shared folder."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")

    def count(records) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(records, target=chunk_bytes):
            yield _counted(batch)

    counted = common.written(common.map_arrow(source, count, _COUNTED), "terms")
    total = counted.agg(F.count("*").alias("d"), F.sum("n").alias("t")).first()
    corpus = Corpus(total["d"], total["t"] or 0)
    weighed = counted.withColumn("m", corpus.normaliser("n")).drop("n").withColumn("bytes", F.octet_length("tf") + F.octet_length("terms"))
    dealt = _dealt(weighed, shard_bytes).select("doc_id", "m", "terms", "tf")

    def run(records) -> Iterator[pa.RecordBatch]:
        for batch in common.batches(records, text="terms", target=chunk_bytes):
            yield _chunks(batch)

    return Index(corpus, _written(common.map_arrow(dealt, run, _CHUNK)))


def _dealt(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """Rows sorted by m, a partition for each ``shard_bytes`` of them.

    The bytes of each m, a table of as many rows as there are strata, say at which shard a stratum begins and over how many it
    goes; a row's place among those is hashed. Long texts are few rows of many bytes, so rows are no measure.
    """
    sizes = common.written(rows.groupBy("m").agg(F.sum("bytes").alias("b")), "sizes")
    strata, total = sizes.agg(F.count("*"), F.sum("b")).first()
    before = F.coalesce(F.sum("b").over(Window.orderBy("m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first, last = F.expr(f"(before div {shard_bytes}L)"), F.expr(f"((before + b - 1) div {shard_bytes}L)")
    places = sizes.withColumn("before", before).select("m", first.alias("first"), (last - first + 1).alias("over"))
    placed = common.small_join(rows, places, ["m"], strata, 64, "inner")
    shard = F.col("first") + F.pmod(F.xxhash64("doc_id", "terms"), F.col("over"))
    return placed.withColumn("shard", shard.cast("int")).repartitionById(common.parts_for(total or 0, shard_bytes), "shard").sortWithinPartitions("shard", "m")


def _written(chunks: DataFrame) -> DataFrame:
    """The index as a table whose row groups are small: a reader holds one at a time, and a chunk may be large."""
    path = scratch_path(chunks.sparkSession, "strata")
    sizes = {"parquet.block.size": 4 * CHUNK_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}
    chunks.write.options(**sizes).parquet(path)
    return chunks.sparkSession.read.schema(chunks.schema).parquet(path)


def _counted(batch: pa.Table) -> pa.RecordBatch:
    """Length, distinct terms and their tf of each text that has any."""
    terms, lengths = _tokens(*common.text_buffer(batch.column("text")))
    coded = terms.dictionary_encode()
    size = max(len(coded.dictionary), 1)
    pairs, tf = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + coded.indices.to_numpy(), return_counts=True)
    held = np.flatnonzero(lengths)
    borders = np.append(np.searchsorted(pairs // size, held), len(pairs))
    lists = pa.LargeListArray.from_arrays(pa.array(borders), coded.dictionary.take(pa.array(pairs % size)))
    ids = batch.column("doc_id").combine_chunks().cast(pa.int64()).take(pa.array(held))
    joined = pc.binary_join(lists, pa.scalar(SEPARATOR, pa.large_string())).cast(pa.string())
    return pa.RecordBatch.from_arrays([ids, pa.array(lengths[held], pa.int64()), joined, _packed(tf.astype(np.int32), borders)], names=["doc_id", "n", "terms", "tf"])


def _packed(values: np.ndarray, borders: np.ndarray) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in zip(borders, borders[1:])], pa.binary())


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, lower-cased, and how many each text has."""
    inside = _IN_TERM[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    # Texts lie side by side; a term ends with its text.
    borders = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(raw))]
    opens[borders] = inside[borders]
    closes[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    places = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    spelled = common.ASCII_LOWER[raw[inside]]
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(spelled))
    return terms, np.diff(np.searchsorted(starts, offsets))


def _chunks(batch: pa.Table) -> pa.RecordBatch:
    """One row per stratum of a batch sorted by m; a term's postings stand by falling tf."""
    ids, m = common.ids_of(batch.column("doc_id")), batch.column("m").to_numpy().astype(np.int64)
    terms, lengths = _tokens(*common.text_buffer(batch.column("terms")))
    coded = terms.dictionary_encode()
    code, size = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
    doc, tf = np.repeat(np.arange(len(ids)), lengths), np.frombuffer(b"".join(batch.column("tf").to_pylist()), np.int32)
    new = np.concatenate([[True], np.diff(m) != 0])
    stratum = (np.cumsum(new) - 1)[doc]
    first_doc = np.flatnonzero(new)
    # By stratum, term, falling tf and document; the sort is stable.
    order = np.argsort(-tf, kind="stable")
    order = order[np.argsort((stratum * size + code)[order], kind="stable")]
    doc, code, tf, stratum = doc[order], code[order], tf[order].astype(np.int64), stratum[order]
    term_new = np.concatenate([[True], (np.diff(code) != 0) | (np.diff(stratum) != 0)])
    run_new = term_new | np.concatenate([[True], np.diff(tf) != 0])
    term_at, run_at = np.flatnonzero(term_new), np.flatnonzero(run_new)
    edges = np.arange(len(first_doc) + 1)
    by_posting, by_term, by_run = (np.searchsorted(s, edges) for s in (stratum, stratum[term_at], stratum[run_at]))
    local_doc = (doc - first_doc[stratum]).astype(np.int32)
    local_term = (np.cumsum(term_new) - 1)[run_at] - by_term[stratum[run_at]]
    run_size, run_tf = np.diff(np.append(run_at, len(tf))).astype(np.int32), tf[run_at]
    doc_edges, sizes = np.append(first_doc, len(ids)), np.diff(np.append(term_at, len(tf))).astype(np.int32)
    spelled, most = coded.dictionary.take(pa.array(code[term_at])), tf[term_at].astype(np.int32)
    joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(by_term, pa.int64()), spelled), pa.scalar(SEPARATOR, pa.large_string()))
    heads, bodies, names = [], [], []
    for k in range(len(first_doc)):
        t, r, p, d = (slice(edges[k], edges[k + 1]) for edges in (by_term, by_run, by_posting, doc_edges))
        raw, _offsets = common.text_buffer(joined.slice(k, 1))
        heads.append(_sealed(raw, sizes[t], most[t]))
        bodies.append(_sealed(ids[d], local_term[r].astype(np.int32), run_tf[r].astype(np.int32), run_size[r], local_doc[p]))
        names.append(hashlib.blake2b(bodies[-1] + heads[-1], digest_size=12).hexdigest())
    columns = [pa.array(m[first_doc]), pa.array(names), pa.array(np.diff(doc_edges), pa.int32()), pa.array(heads, pa.binary()), pa.array(bodies, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _CHUNK.split(", ")])


def _sealed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; their sizes stand in front."""
    parts = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.compress(np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(parts), 1)


def _unsealed(blob: bytes, kinds: tuple) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(blob), [], 8 * len(kinds)
    for size, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), kinds):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


# --- searching -------------------------------------------------------------------------------


class Queries:
    """The items of a block: numbered terms, and the terms of each item side by side."""

    def __init__(self, rows: list[tuple]):
        self.items = sorted({i for i, _t in rows}, key=lambda i: (i is None, i or 0))
        self.terms = sorted({t for _i, t in rows})
        number, place = {t: k for k, t in enumerate(self.terms)}, {i: k for k, i in enumerate(self.items)}
        flat = sorted((place[i], number[t]) for i, t in rows)
        self.flat = np.array([t for _i, t in flat], dtype=np.int64)
        self.starts = np.searchsorted([i for i, _t in flat], np.arange(len(self.items)))
        self.ends = np.append(self.starts[1:], len(flat))
        self.weights = np.zeros(len(self.terms), dtype=np.int64)
        self._known: pa.Array | None = None

    def __getstate__(self):
        return {**self.__dict__, "_known": None}

    def found(self, terms: pa.Array) -> np.ndarray:
        """The number of each term, -1 where no item has it."""
        if self._known is None:
            self._known = pa.array(self.terms, pa.large_string())
        return pc.index_in(terms, value_set=self._known).fill_null(-1).to_numpy().astype(np.int64)

    def bounds(self, numbers: np.ndarray, max_tf: np.ndarray, m: int) -> np.ndarray:
        """What a document of the chunk can score at most, for each item."""
        most = np.zeros(len(self.terms), dtype=np.int64)
        known = numbers >= 0
        most[numbers[known]] = self.weights[numbers[known]] * impact(max_tf[known].astype(np.int64), m)
        return np.add.reduceat(most[self.flat], self.starts)


@dataclass
class Chunk:
    m: int
    docs: np.ndarray
    numbers: np.ndarray
    row: list[np.ndarray]

    def scores(self, queries: Queries, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(documents, scores by item and document) of some documents at a time, for the items ``wanted``."""
        run_term, run_tf, run_size, postings = self.row
        number = self.numbers[run_term]
        needed = np.zeros(len(queries.terms) + 1, dtype=bool)
        needed[np.concatenate([queries.flat[queries.starts[i] : queries.ends[i]] for i in wanted])] = True
        runs = needed[number]
        # One impact per run, whatever the number of its documents.
        values = queries.weights[number[runs]] * impact(run_tf[runs].astype(np.int64), self.m)
        at = np.repeat(runs, run_size)
        places, values, number = postings[at], np.repeat(values, run_size[runs]), np.repeat(number[runs], run_size[runs])
        # Terms in use become rows of a small table; row 0 stays empty for the others.
        used, line = np.unique(number, return_inverse=True)
        line_of = np.zeros(len(queries.terms), dtype=np.int64)
        line_of[used] = np.arange(1, len(used) + 1)
        width = max(1, CELLS // (len(used) + len(wanted) + 1))
        for low in range(0, len(self.docs), width):
            top = min(low + width, len(self.docs))
            mine = (places >= low) & (places < top)
            table = np.zeros((len(used) + 1, top - low), dtype=np.int64)
            table[line[mine] + 1, places[mine] - low] = values[mine]
            yield self.docs[low:top], np.stack([table[lines[lines > 0]].sum(axis=0) for lines in (line_of[queries.flat[queries.starts[i] : queries.ends[i]]] for i in wanted)])


def _heads(record: pa.RecordBatch, queries: Queries) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, number, df and largest tf of each term that an item has) of the chunks."""
    for k, blob in enumerate(record.column(record.schema.get_field_index("heads"))):
        raw, df, max_tf = _unsealed(blob.as_py(), _HEADS)
        numbers = queries.found(_tokens(raw, np.array([0, len(raw)], np.int64))[0])
        yield k, numbers, df, max_tf


class Best:
    """The k best documents per item so far; what is below an item's k-th score is not taken."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, np.maximum(floors, 1)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting, self.limit = 0, max(1 << 16, 2 * k * len(floors))

    def add(self, items: np.ndarray, docs: np.ndarray, scores: np.ndarray) -> None:
        if scores.shape[1] > self.k:
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]
            self.floors[items] = np.maximum(self.floors[items], kth)
        row, col = np.nonzero(scores >= self.floors[items][:, None])
        self.held.append((items[row], docs[col], scores[row, col]))
        self.waiting += len(row)
        if self.waiting > self.limit:
            self.prune()

    def prune(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return (np.zeros(0, np.int64),) * 3
        item, doc, score = (np.concatenate(c) for c in zip(*self.held))
        order = np.lexsort((doc, -score, item))
        item, doc, score = item[order], doc[order], score[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.k
        item, doc, score, rank = item[keep], doc[keep], score[keep], rank[keep]
        last = rank == self.k - 1
        self.floors[item[last]] = np.maximum(self.floors[item[last]], score[last])
        self.held, self.waiting = [(item, doc, score)], len(item)
        return item, doc, score


def visited(records: Iterable[pa.RecordBatch], queries: Queries, floors: np.ndarray, k: int) -> tuple[Best, int, int]:
    """(the best documents, chunk and item pairs scored, pairs in all) of the chunks of a task."""
    best, scored, pairs = Best(floors, k), 0, 0
    for record in records:
        m = record.column(record.schema.get_field_index("m")).to_pylist()
        bounds = {row: queries.bounds(numbers, max_tf, m[row]) for row, numbers, _df, max_tf in _heads(record, queries)}
        pairs += len(bounds) * len(queries.items)
        for row in sorted(bounds, key=lambda r: -int(bounds[r].max())):
            wanted = np.flatnonzero((bounds[row] >= best.floors) & (bounds[row] > 0))
            scored += len(wanted)
            if len(wanted):
                # Opened again, since the terms of all chunks of a batch would not stay small.
                (_row, numbers, _df, _max_tf), = _heads(record.slice(row, 1), queries)
                docs, *rest = _unsealed(record.column(record.schema.get_field_index("body"))[row].as_py(), _BODY)
                for held, scores in Chunk(m[row], docs, numbers, rest).scores(queries, wanted):
                    best.add(wanted, held, scores)
    return best, scored, pairs


def _emit(rows: Iterable[np.ndarray], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[s.split()[1]]) for c, s in zip(rows, schema.split(", "))], names=names)


def _weighed(index: Index, queries: Queries) -> Queries:
    """With the weight of each term; a term that stands nowhere has none to give."""
    schema = "number int, df bigint"

    def run(records) -> Iterator[pa.RecordBatch]:
        df = np.zeros(len(queries.terms) + 1, dtype=np.int64)
        for record in records:
            for _row, numbers, counts, _max_tf in _heads(record, queries):
                np.add.at(df, numbers, counts)
        held = np.flatnonzero(df[:-1])
        yield _emit((held, df[held]), schema)

    sums = common.map_arrow(index.chunks.select("heads"), run, schema).groupBy("number").agg(F.sum("df").alias("df"))
    for row in sums.collect():
        queries.weights[row["number"]] = index.corpus.weight(row["df"])
    return queries


def _floors(index: Index, queries: Queries, k: int, first_visits: int) -> np.ndarray:
    """A score that each item's k-th document has at least, from the chunks with the highest bounds."""
    schema = "item int, chunk string, bound bigint"

    def run(records) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        bounds: list[np.ndarray] = []
        for record in records:
            m, chunk, size = (record.column(record.schema.get_field_index(c)).to_pylist() for c in ("m", "chunk", "size"))
            large = [i for i, n in enumerate(size) if n >= k]
            for row, numbers, _df, max_tf in _heads(record.take(pa.array(large, pa.int64())), queries):
                names.append(chunk[large[row]])
                bounds.append(queries.bounds(numbers, max_tf, m[large[row]]))
            if len(bounds) > 4 * first_visits + 64:
                names, bounds = _highest(names, bounds, first_visits)
        table = np.stack(bounds) if bounds else np.zeros((0, len(queries.items)), np.int64)
        top = np.argsort(-table, axis=0, kind="stable")[:first_visits]
        item = np.tile(np.arange(len(queries.items)), len(top))
        yield _emit((item, np.array(names, dtype=object)[top.ravel()], table[top.ravel(), item]), schema)

    heads = index.chunks.select("m", "chunk", "size", "heads")
    order = Window.partitionBy("item").orderBy(F.desc("bound"), "chunk")
    highest = common.map_arrow(heads, run, schema).where("bound > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first_visits)
    # At most items x first_visits names.
    chosen = F.broadcast(highest.select("chunk").distinct())
    found = _best_of(index.chunks.join(chosen, "chunk", "left_semi"), queries, np.ones(len(queries.items), np.int64), k)
    last = Window.partitionBy("item").orderBy(F.desc("score"))
    floors = np.ones(len(queries.items), dtype=np.int64)
    for row in found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") == k).collect():
        floors[row["item"]] = row["score"]
    return floors


def _highest(names: list[str], bounds: list[np.ndarray], first_visits: int) -> tuple[list[str], list[np.ndarray]]:
    """Only the chunks that are among the highest for some item."""
    keep = np.unique(np.argsort(-np.stack(bounds), axis=0, kind="stable")[:first_visits])
    return [names[i] for i in keep], [bounds[i] for i in keep]


def _best_of(chunks: DataFrame, queries: Queries, floors: np.ndarray, k: int) -> DataFrame:
    """(item, doc_id, score) of the k best documents per item and task."""

    def run(records) -> Iterator[pa.RecordBatch]:
        best, _scored, _pairs = visited(records, queries, floors, k)
        yield _emit(best.prune(), _FOUND)

    return common.map_arrow(chunks, run, _FOUND)


def _item_blocks(items: DataFrame, block_terms: int) -> Iterator[list[tuple]]:
    """Distinct (item id, term) rows, all terms of an item in one block."""
    folded = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.explode(F.regexp_extract_all(folded, F.lit(_TERM), F.lit(0))).alias("term")).distinct()
    count = -(-terms.count() // block_terms)
    for b in range(count):
        rows = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == b).collect()
        if rows:
            yield [(r.item_id, r.term) for r in rows]


def search(index: Index, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS, first_visits: int = FIRST_VISITS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    spark = items.sparkSession
    ranked = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    for rows in _item_blocks(items, block_terms):
        queries = _weighed(index, Queries(rows))
        found = _best_of(index.chunks, queries, _floors(index, queries, k, first_visits), k)
        numbers = F.broadcast(spark.createDataFrame(list(enumerate(queries.items)), "item int, item_id bigint"))
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).join(numbers, "item")
        real = F.when(F.col("doc_id") != int(common.NO_ID), F.col("doc_id")).alias("doc_id")
        ranked = ranked.unionByName(best.select("item_id", "rank", real, "score"))
    return ranked


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """The k best documents of each item, over an index built for this call."""
    return search(build(docs), items, k)
