"""Benchmark passages in documents, found by pigeonhole pieces and bit-parallel edit distance.

Texts are compared in lower case with runs of white space as one space. A test item of m characters may be
changed by k = floor(rate * m) edits; cut into k + 1 pieces, at least one piece must then stand unchanged in
the document. All pieces are searched at once by an automaton; around each hit the item is compared with
Myers' bit-parallel algorithm. Windows of neighbouring hits are joined, so no alignment is judged twice and none is
left out. Items travel in blocks of bounded size, each block to all documents.

Defined cases: null and empty texts hold nothing and null or empty items are found nowhere; rows that repeat an
item or a document give one row each time they appear as a document, one per distinct item id and text.
"""

from __future__ import annotations

from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ERROR_RATE = 0.08
BLOCK_CHARS = 1 << 20


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


@dataclass
class Item:
    item_id: int | None
    text: str
    errors: int
    masks: dict[str, int]


def make_item(item_id, text: str, rate: float) -> Item:
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return Item(item_id, text, int(rate * len(text)), masks)


def cut(text: str, pieces: int) -> list[tuple[int, str]]:
    """(offset, piece) of ``pieces`` pieces of nearly equal length, none empty."""
    size = len(text)
    marks = [size * i // pieces for i in range(pieces + 1)]
    return [(a, text[a:b]) for a, b in zip(marks, marks[1:]) if b > a]


def nearest(item: Item, text: str) -> tuple[int, int]:
    """(distance, end) of the substring of ``text`` nearest to the item; the first of equals."""
    size = len(item.text)
    full, high = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = full, 0, size
    best, at = size, 0
    masks = item.masks
    for j, c in enumerate(text, start=1):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | ~(xh | plus)
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        plus = mh | ~(xv | ph) & full
        minus = ph & xv
        if score < best:
            best, at = score, j
    return best, at


class Finder:
    """The items of one block, ready to be searched in texts."""

    def __init__(self, items: list[tuple], rate: float):
        self.items = [make_item(i, t, rate) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, item in enumerate(self.items):
            for offset, piece in cut(item.text, item.errors + 1):
                pieces.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def matches(self, text: str | None) -> list[tuple[Item, int, int]]:
        """(item, distance, end in the normalised text) of each item that stands in the text within its errors."""
        text = normal(text)
        if self.empty or not text:
            return []
        starts: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, offset in places:
                starts.setdefault(n, set()).add(end + 1 - size - offset)
        out = []
        for n, found in starts.items():
            item = self.items[n]
            windows: list[list[int]] = []
            for s in sorted(found):
                low, top = max(0, s - item.errors), min(len(text), s + len(item.text) + item.errors)
                if windows and low <= windows[-1][1]:
                    windows[-1][1] = max(windows[-1][1], top)
                else:
                    windows.append([low, top])
            hits = [(d, low + at) for low, top in windows for d, at in [nearest(item, text[low:top])] if d <= item.errors]
            if hits:
                out.append((item, *min(hits)))
        return out


_FINDERS: list[tuple[list, float, Finder]] = []


def _finder(shared, rate: float) -> Finder:
    """The finder of a block. The items are kept with it, as a worker that drops them could give their id to another block."""
    value = shared.value
    if not _FINDERS or _FINDERS[0][0] is not value or _FINDERS[0][1] != rate:
        _FINDERS[:] = [(value, rate, Finder(value, rate))]
    return _FINDERS[0][2]


def item_blocks(items: DataFrame, block_chars: int = BLOCK_CHARS):
    """Distinct normalised items, one bounded block at a time."""
    wanted = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("length(text) > 0").distinct()
    chars = wanted.agg(F.sum(F.length("text")).alias("c")).first()["c"] or 0
    count = -(-chars // block_chars)
    for k in range(count):
        block = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
        rows = sorted({(r.item_id, normal(r.text)) for r in block if normal(r.text)}, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            yield rows


def leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, stop): every document and item that match; ``stop`` counts normalised characters."""
    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, distance int, stop bigint"
    found = docs.sparkSession.createDataFrame([], schema)
    for rows in item_blocks(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(records, shared=shared):
            finder = _finder(shared, rate)
            for record in records:
                ids = record.column(0).to_pylist()
                hits = [(i, item.item_id, d, stop) for i, t in zip(ids, record.column(1).to_pylist()) for item, d, stop in finder.matches(t)]
                if hits:
                    a, b, c, d = zip(*hits)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int64())],
                        names=["doc_id", "item_id", "distance", "stop"],
                    )

        found = found.unionByName(common.map_arrow(source, run, schema))
    return found


def drop_leaks(docs: DataFrame, items: DataFrame, rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    for rows in item_blocks(items, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(rows)

        def run(records, shared=shared):
            finder = _finder(shared, rate)
            for record in records:
                texts = record.column(record.schema.get_field_index("text")).to_pylist()
                yield record.filter(pa.array([not finder.matches(t) for t in texts], pa.bool_()))

        docs = common.map_arrow(docs, run, docs.schema)
    return docs
