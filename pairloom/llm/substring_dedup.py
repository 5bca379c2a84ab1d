"""Repeated passages by a relative Lempel-Ziv parse against every document before.

The reference is every document, indexed in blocks: the fingerprints of all 13-word windows are dealt to blocks by an
independent hash, and each block keeps for a fingerprint its first place: the smallest document that holds it, and there the first position. A task asks the blocks for
the distinct windows of a bounded batch (packed, each once a batch, with document boundaries as counts and positions as compressed steps).

A document is parsed greedily from left to right: at the next window that a smaller document holds a factor begins at that window's first place, and it goes on while the
following windows' first places run on there, word for word. At a factor's border the windows across it are looked at one by one: one that is held elsewhere begins the
next factor, which takes the words that its predecessor left. So factors do not overlap, each is one stretch of one source, and together they cover just the
words of windows that a smaller document holds; those words go, the rest stays. First places are the same for all who ask, so where an older document holds an
inner window too a factor ends and another begins: factors are the longest along first places, not along all holders.

A block's number and the 64 bits inside it come from independent hashes; with blocks growing in number
with the corpus, chance agreement does not grow with it.

Defined cases: null and empty texts have no words; the hash of no kept words is that of the empty string. Windows are
compared between different ids only, so rows that repeat an id do not remove each other's words; a null id is
larger than all others and equal to other nulls. Texts shorter than a window lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
BLOCK_WINDOWS = 3_000_000
_REQUEST = "block int, batch binary, owners binary, counts binary, keys binary, places binary"
_REPLY = "batch binary, block int, hits binary, sources binary, places binary"


class Batch:
    """Windows of a bounded set of documents in the order of their ids."""

    def __init__(self, records: pa.Table, window: int = WINDOW):
        ids = common.ids_of(records.column("doc_id"))
        order = np.argsort(ids, kind="stable")
        self.records = records.take(pa.array(order))
        self.ids = ids[order]
        self.raw, self.offsets = common.text_buffer(self.records.column("text"))
        self.starts, self.ends, self.first = common.words(self.raw, self.offsets)
        hashes = common.word_hashes(self.raw, self.starts, self.ends)
        keys = common.run_hashes(hashes, window, 13)
        block_keys = common.run_hashes(hashes, window, 17)
        # Windows that start at least ``window`` words before the end of their document.
        inside = np.zeros(len(keys), dtype=bool)
        lengths = np.diff(self.first)
        for a, n in zip(self.first[:-1][lengths >= window], lengths[lengths >= window]):
            inside[a : a + n - window + 1] = True
        self.at = np.flatnonzero(inside)
        self.document = np.searchsorted(self.first, self.at, side="right") - 1
        # The first of equal windows is the one of the smallest id. Both hashes tell windows apart.
        keys, block_keys = keys[self.at], block_keys[self.at]
        order = np.argsort(keys)
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(keys[order]) != 0) | (np.diff(block_keys[order]) != 0)
        group = np.cumsum(new) - 1
        lead = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
        place = np.argsort(lead, kind="stable")
        rank = np.empty(len(place), dtype=np.int64)
        rank[place] = np.arange(len(place))
        self.which = np.empty(len(order), dtype=np.int64)
        self.which[order] = rank[group]
        lead = lead[place]
        self.keys, self.block_keys, self.owner = keys[lead], block_keys[lead], self.document[lead]
        # Where in its document the window first starts.
        self.place = (self.at[lead] - self.first[self.owner]).astype(np.int32)
        name = hashlib.blake2b(digest_size=16)
        for part in (self.ids, self.offsets, self.keys):
            name.update(np.ascontiguousarray(part).tobytes())
        self.name = name.digest()

    def by_block(self, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(block of each distinct window, stable order by block, borders of the blocks)."""
        block = (self.block_keys % np.uint64(blocks)).astype(np.int32)
        order = np.argsort(block, kind="stable")
        return block, order, np.searchsorted(block[order], np.arange(blocks + 1))


def requests(blocks: int, window: int):
    def run(records) -> Iterator[pa.RecordBatch]:
        for table in common.batches(records):
            batch = Batch(table, window)
            _block, order, borders = batch.by_block(blocks)
            for k in range(blocks):
                mine = order[borders[k] : borders[k + 1]]
                if len(mine):
                    owners, counts = np.unique(batch.owner[mine], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([k], pa.int32()), pa.array([batch.name], pa.binary()), pa.array([batch.ids[owners].tobytes()], pa.binary()),
                            pa.array([counts.astype(np.int32).tobytes()], pa.binary()), pa.array([batch.keys[mine].tobytes()], pa.binary()),
                            pa.array([_steps(batch.place[mine])], pa.binary()),
                        ],
                        names=["block", "batch", "owners", "counts", "keys", "places"],
                    )

    return run


def _steps(places: np.ndarray) -> bytes:
    """Positions as compressed differences, most of which are small."""
    return zstandard.compress(np.diff(places, prepend=np.int32(0)).astype(np.int32).tobytes(), 1)


def _places(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.decompress(packed), np.int32), dtype=np.int32)


def answer(group: pa.Table) -> pa.Table:
    """One block: for each batch which of its windows start in a smaller document elsewhere, in which and where there."""
    keys = [np.frombuffer(k, np.uint64) for k in group.column("keys").to_pylist()]
    ids = [np.repeat(np.frombuffer(o, np.int64), np.frombuffer(c, np.int32)) for o, c in zip(group.column("owners").to_pylist(), group.column("counts").to_pylist())]
    flat, owner = np.concatenate(keys), np.concatenate(ids)
    order = np.argsort(flat)
    ranked = flat[order]
    starts = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    least = np.minimum.reduceat(owner[order], starts)
    sizes = np.diff(np.append(starts, len(flat)))
    first, spot = np.empty(len(flat), dtype=np.int64), np.empty(len(flat), dtype=np.int32)
    first[order] = np.repeat(least, sizes)
    # Of the places in that document the first one.
    place = np.concatenate([_places(p) for p in group.column("places").to_pylist()])
    near = np.where(owner == first, place, np.iinfo(np.int32).max)[order]
    spot[order] = np.repeat(np.minimum.reduceat(near, starts), sizes)
    hits, sources, spots, at = [], [], [], 0
    for mine in keys:
        part = slice(at, at + len(mine))
        at += len(mine)
        hit = first[part] < owner[part]
        hits.append(np.packbits(hit).tobytes())
        sources.append(zstandard.compress(first[part][hit].tobytes(), 1))
        spots.append(_steps(spot[part][hit]))
    return pa.table(
        [group.column("batch"), group.column("block"), *[pa.array(c, pa.binary()) for c in (hits, sources, spots)]],
        names=["batch", "block", "hits", "sources", "places"],
    )


def packed(window: int):
    """Arrow mapper: each batch as one compressed row, to meet its answers."""

    def run(records) -> Iterator[pa.RecordBatch]:
        for table in common.batches(records):
            batch = Batch(table, window)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.name], pa.binary()), pa.array([common.packed_table(batch.records)], pa.binary())], names=["batch", "packed"]
            )

    return run


def factors(sources: np.ndarray, spots: np.ndarray, at: np.ndarray, window: int) -> list[tuple[int, int, int, int]]:
    """(start word, words, source id, start word there) of the greedy parse of one document.

    ``at`` has the starts of its copied windows, ``sources`` and ``spots`` the first place of each. A factor takes windows while they follow each other and so do their
    places; the next one begins with the first copied window behind its last, less the words that are taken already.
    """
    out, end = [], 0
    if len(at):
        breaks = np.flatnonzero((np.diff(at) != 1) | (np.diff(sources) != 0) | (np.diff(spots) != 1)) + 1
        for a, b in zip(np.concatenate([[0], breaks]), np.concatenate([breaks, [len(at)]])):
            start, stop = int(at[a]), int(at[b - 1]) + window
            taken = max(0, end - start)
            out.append((start + taken, stop - start - taken, int(sources[a]), int(spots[a]) + taken))
            end = stop
    return out


def parse(blocks: int, window: int):
    """Cogroup function: the parse of one batch from the answers of all blocks."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for blob in left.column("packed").to_pylist():
            records = common.unpacked_table(blob)
            batch = Batch(records, window)
            _block, order, borders = batch.by_block(blocks)
            source, spot = np.full(len(batch.keys), common.NO_ID, dtype=np.int64), batch.place.copy()
            hit = np.zeros(len(batch.keys), dtype=bool)
            # Batches that agree in ids and windows share their answers.
            answers = {k: rest for k, *rest in zip(*(right.column(c).to_pylist() for c in ("block", "hits", "sources", "places")))}
            answered = 0
            for k, (bits, packed_sources, packed_places) in answers.items():
                mine = order[borders[k] : borders[k + 1]]
                answered += len(mine)
                found = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(mine)).astype(bool)
                hit[mine] = found
                source[mine[found]] = np.frombuffer(zstandard.decompress(packed_sources), np.int64)
                spot[mine[found]] = _places(packed_places)
            if answered != len(batch.keys):
                raise RuntimeError("a batch was read in two different ways; write the input table first")
            # The first place of each window: outside, or else in the first document of this batch.
            holder = np.where(hit, source, batch.ids[batch.owner])[batch.which]
            copied = holder < batch.ids[batch.document]
            out.append(_kept(batch, holder, spot[batch.which], copied, window))
        return pa.concat_tables(out)

    return run


def _kept(batch: Batch, holder: np.ndarray, spot: np.ndarray, copied: np.ndarray, window: int) -> pa.Table:
    at, document, holder, spot = batch.at[copied], batch.document[copied], holder[copied], spot[copied]
    borders = np.searchsorted(document, np.arange(len(batch.ids) + 1))
    removed, hashes, spans = [], [], []
    whole = batch.raw.tobytes()
    for d in range(len(batch.ids)):
        low, top = batch.first[d], batch.first[d + 1]
        mine = slice(borders[d], borders[d + 1])
        parsed = factors(holder[mine], spot[mine], at[mine], window)
        gone = np.zeros(top - low, dtype=bool)
        for start, size, _source, _spot in parsed:
            gone[start - low : start - low + size] = True
        stay = np.flatnonzero(~gone) + low
        hashes.append(hashlib.sha256(b" ".join([whole[a:b] for a, b in zip(batch.starts[stay].tolist(), batch.ends[stay].tolist())])).hexdigest())
        removed.append(int(gone.sum()))
        spans.append([{"start": s - int(low), "words": n, "source": src, "source_start": there} for s, n, src, there in parsed])
    return pa.table(
        [
            batch.records.column("doc_id").combine_chunks(), pa.array(np.diff(batch.first), pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string()),
            pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64()), ("source", pa.int64()), ("source_start", pa.int64())]))),
        ],
        names=["doc_id", "n_words", "n_removed", "kept_sha256", "factors"],
    )


def duplicate_spans(docs: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, factors(start, words, source, source_start)."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    blocks = common.parts_for(common.text_bytes(source) // 5, block_windows)
    asked = common.map_arrow(source, requests(blocks, window), _REQUEST)
    answers = asked.groupBy("block").applyInArrow(answer, _REPLY)
    held = common.map_arrow(source, packed(window), "batch binary, packed binary")
    return held.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(
        parse(blocks, window),
        "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, factors array<struct<start:bigint,words:bigint,source:bigint,source_start:bigint>>",
    )
