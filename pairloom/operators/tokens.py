"""Token work on Arrow text columns: each distinct token of a batch is handled once.

Splitting and hashing are the hot path of every embedding. A batch repeats the same words over and
over, so encoding it as a dictionary first makes the per-token cost an integer lookup.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions.text import ODD_SPACES

_ODD_CLASS = f"[{ODD_SPACES}]"
# Bytes that begin whitespace other than the plain space; where none stands texts split at spaces.
_ODD_LEADS = sorted({c.encode()[:1] for c in ODD_SPACES})
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *[ord(c) for c in ODD_SPACES if c <= "\x7f"]]] = True
# md5's first words, its turns by round and its additive words.
_MD5_BEGIN = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_TURNS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
# A text of so many bytes and its length mark fill one block; so many texts stay in the processor cache.
_ONE_BLOCK = 55
_MD5_ROWS = 16_384
# Texts split at a time; their tokens take several times as much.
SLICE_BYTES = 2 << 20


@dataclass(frozen=True)
class TokenBatch:
    """Tokens of consecutive texts: ``codes[edges[i]:edges[i + 1]]`` point into ``vocabulary``."""

    vocabulary: pa.Array
    codes: np.ndarray
    edges: np.ndarray

    def cut(self, limit: int | None) -> TokenBatch:
        """The first ``limit`` tokens of every text; None keeps all."""
        counts = np.diff(self.edges)
        if limit is None or len(counts) == 0 or counts.max() <= limit:
            return self
        place = np.arange(len(self.codes)) - np.repeat(self.edges[:-1], counts)
        edges = np.concatenate([[0], np.cumsum(np.minimum(counts, limit))])
        return TokenBatch(self.vocabulary, self.codes[place < limit], edges)


def text_slices(batch: pa.RecordBatch, places: list[int], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows whose texts in these columns come to about ``most`` bytes; at least one row each, and one slice of an empty batch."""
    sizes = np.zeros(batch.num_rows, dtype=np.int64)
    for place in places:
        sizes += pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while True:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop
        if start >= batch.num_rows:
            return


def split_tokens(texts: pa.Array, lower: bool = False) -> TokenBatch:
    """Non-empty tokens between Unicode whitespace; ``lower`` folds ASCII capitals."""
    column = pc.fill_null(texts, "").cast(pa.large_string())
    column = pc.ascii_lower(column) if lower else column
    raw, edges = _text_bytes(column)
    content = raw.tobytes()
    if any(content.find(lead) >= 0 for lead in _ODD_LEADS):
        column = pc.replace_substring_regex(column, _ODD_CLASS, " ") if raw.max() >= 0x80 else column
        return _split_bytes(*_text_bytes(column))
    lists = pc.split_pattern(column, " ")
    coded = lists.flatten().dictionary_encode()
    codes, edges = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
    edges = edges - edges[0]
    empty = pc.index(coded.dictionary, pa.scalar("", pa.large_string())).as_py()
    if empty >= 0:
        keep = codes != empty
        codes, edges = codes[keep], np.concatenate([[0], np.cumsum(keep)])[edges]
    return TokenBatch(coded.dictionary.cast(pa.string()), codes, edges)


def _split_bytes(raw: np.ndarray, edges: np.ndarray) -> TokenBatch:
    """Tokens between ASCII whitespace of texts that lie side by side."""
    inside = ~_SPACE[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    # A token ends with its text.
    borders = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(raw))]
    opens[borders] = inside[borders]
    closes[borders - 1] = inside[borders - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    places = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts, out=places[1:])
    coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(places), pa.py_buffer(raw[inside])).dictionary_encode()
    return TokenBatch(coded.dictionary.cast(pa.string()), coded.indices.to_numpy(), np.searchsorted(starts, edges))


def _text_bytes(column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, where each begins and the last ends)."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _valid, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[edges[0] : edges[-1]], edges - edges[0]


def hash60(tokens: pa.Array) -> np.ndarray:
    """First 15 hex digits of the md5 of each token as a number."""
    raw, edges = _text_bytes(tokens.cast(pa.large_string()))
    lengths = np.diff(edges)
    out = np.zeros(len(lengths), dtype=np.uint64)
    short = np.flatnonzero(lengths <= _ONE_BLOCK)
    for start in range(0, len(short), _MD5_ROWS):
        mine = short[start : start + _MD5_ROWS]
        out[mine] = _md5_heads(raw, edges[mine], lengths[mine])
    for i in np.flatnonzero(lengths > _ONE_BLOCK):
        out[i] = int.from_bytes(hashlib.md5(raw[edges[i] : edges[i + 1]].tobytes()).digest()[:8], "big")
    return (out >> np.uint64(4)).astype(np.int64)


def _md5_heads(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """First eight digest bytes of texts that fill one block each, all rows of a round at once (RFC 1321)."""
    rows = len(starts)
    block = np.zeros((rows, 64), dtype=np.uint8)
    if int(lengths.sum()) == int(starts[-1] + lengths[-1] - starts[0]):
        # Texts that lie side by side, as in nearly all vocabularies.
        at = np.arange(int(lengths.sum())) + np.repeat(np.arange(rows) * 64 - (starts - starts[0]), lengths)
        block.reshape(-1)[at] = raw[starts[0] : starts[0] + len(at)]
    else:
        row = np.repeat(np.arange(rows), lengths)
        within = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        block[row, within] = raw[starts[row] + within]
    block[np.arange(rows), lengths] = 0x80
    block[:, 56:58] = (lengths * 8).astype("<u2").view(np.uint8).reshape(rows, 2)
    message = np.ascontiguousarray(block.view("<u4").T)
    begin = [np.uint32(x) for x in _MD5_BEGIN]
    a, b, c, d = (np.full(rows, x) for x in begin)
    mixed, turned = np.empty(rows, np.uint32), np.empty(rows, np.uint32)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=mixed)
            np.bitwise_and(mixed, b, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
            word = i
        elif i < 32:
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_and(mixed, d, out=mixed)
            np.bitwise_xor(mixed, c, out=mixed)
            word = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=mixed)
            np.bitwise_xor(mixed, d, out=mixed)
            word = (3 * i + 5) % 16
        else:
            np.bitwise_or(b, np.invert(d, out=mixed), out=mixed)
            np.bitwise_xor(mixed, c, out=mixed)
            word = (7 * i) % 16
        np.add(mixed, a, out=mixed)
        np.add(mixed, message[word], out=mixed)
        np.add(mixed, _MD5_SINES[i], out=mixed)
        turn = _MD5_TURNS[i // 16][i % 4]
        np.right_shift(mixed, np.uint32(32 - turn), out=turned)
        np.left_shift(mixed, np.uint32(turn), out=mixed)
        np.bitwise_or(mixed, turned, out=mixed)
        # The oldest word's place takes the new one.
        a, b, c, d = d, np.add(b, mixed, out=a), b, c
    first, second = (a + begin[0]).byteswap(), (b + begin[1]).byteswap()
    return first.astype(np.uint64) << np.uint64(32) | second.astype(np.uint64)


def list_array(matrix: np.ndarray) -> pa.Array:
    """Rows of a matrix as a list column."""
    n, dim = matrix.shape
    offsets = np.arange(0, (n + 1) * dim, dim, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).reshape(-1)))


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    size = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, size, out=np.zeros_like(matrix), where=size > 0)
