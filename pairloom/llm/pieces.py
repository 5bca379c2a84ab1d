"""SentencePiece encoding and decoding as a weighted transducer.

The compiled machine is the composition of three parts: a normaliser (a dummy space in front, spaces to
U+2581), the pieces of the model, and a byte fallback for characters that no piece spells. Its states are
(place in the input, last piece taken); a transition takes a piece and costs its negated score. For a merge
model a transition is allowed only between pieces that the merges would leave side by side: a segmentation is the
merge result exactly when each neighbouring pair is, so of all paths one survives and the tropical shortest path
is the library's own encoding. No piece holds U+2581 after another character, so a text's best path is the
chain of the best paths of its words, and a word met before is not composed again.

Decoding runs the machine backwards: pieces to bytes, U+2581 to a space, the dummy space dropped.

Defined cases: null and empty texts encode to no pieces and decode to the empty text. A text that holds U+2581
itself decodes with a space there, as in the library.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHE_WORDS = 500_000
_CACHED_CHARS = 48
# Spaces with the word behind them; line ends stand alone since no piece holds one.
_UNITS = re.compile("▁*[^▁\n]+|▁+|\n")


@dataclass
class Machine:
    """The compiled transducer: plain tables, bounded by the vocabulary, that travel to the tasks once."""

    ids: dict[str, int]
    scores: list[float]
    spelled: list[bytes]
    byte_ids: list[int]
    merges: bool
    prefix: bool
    _pairs: dict[int, bool] = field(default_factory=dict)
    _words: dict[str, bytes] = field(default_factory=dict)
    _histories: dict[str, tuple] = field(default_factory=dict)

    def __getstate__(self):
        return {**self.__dict__, "_pairs": {}, "_words": {}, "_histories": {}}

    # -- normaliser --

    def normalise(self, text: str) -> str:
        return (SPACE if self.prefix and text else "") + text.replace(" ", SPACE)

    # -- pieces --

    def _history(self, piece: str) -> tuple[list[str], list[float], list[str], list[str]]:
        """Merge the characters of ``piece``, the best scored neighbours first, leftmost among equals.

        Gives what is left, the score of each merge, and the first and the last symbol before and after each.
        """
        symbols, steps, first, last = list(piece), [], [piece[0]], [piece[-1]]
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                k = self.ids.get(symbols[i] + symbols[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            steps.append(best)
            first.append(symbols[0])
            last.append(symbols[-1])
        return symbols, steps, first, last

    def _stays_apart(self, left: str, right: str) -> bool:
        """Would the merges of ``left + right`` never cross the border between the two?

        Until something crosses it, each side merges as it does alone; so the two known histories are replayed
        in the order of their scores and the pair at the border is looked up after each step.
        """
        if left + right in self._live:
            return False
        a, b = self._steps(left), self._steps(right)
        i = j = 0
        while True:
            over = self.ids.get(a[3][i] + b[2][j])
            next_a = a[1][i] if i < len(a[1]) else None
            next_b = b[1][j] if j < len(b[1]) else None
            if over is not None:
                score = self.scores[over]
                if (next_a is None or score > next_a) and (next_b is None or score >= next_b):
                    return False
            if next_a is None and next_b is None:
                return True
            if next_b is None or (next_a is not None and next_a >= next_b):
                i += 1
            else:
                j += 1

    def _steps(self, piece: str):
        found = self._histories.get(piece)
        if found is None:
            found = self._histories[piece] = self._history(piece)
        return found

    def _joins(self, left: int, right: int) -> bool:
        """May ``right`` follow ``left`` on a path?"""
        known = self._stays_apart(self._names[left], self._names[right])
        if len(self._pairs) > CACHE_WORDS:
            self._pairs.clear()
        self._pairs[left << 32 | right] = known
        return known

    def compile(self) -> Machine:
        names = {v: k for k, v in self.ids.items()}
        self._names = [names.get(i, "") for i in range(len(self.scores))]
        # A piece that its own characters do not merge to is never on a path.
        self._live = {p: i for p, i in self.ids.items() if not self.merges or len(p) == 1 or self._history(p)[0] == [p]}
        self._inside = {piece[k : k + 2] for piece in self.ids for k in range(len(piece) - 1)}
        self._trie = {}
        for piece, i in self._live.items():
            node = self._trie
            for character in piece:
                node = node.setdefault(character, {})
            node[""] = i
        return self

    def shortest(self, unit: str) -> list[int]:
        """Ids along the tropical shortest path through the composition with ``unit``."""
        return self._only_path(unit) if self.merges else self._cheapest_path(unit)

    def _only_path(self, unit: str) -> list[int]:
        """Merge models leave one path alive: follow it depth first, long pieces first, and never enter a dead state twice."""
        root, pairs, joins, size = self._trie, self._pairs, self._joins, len(unit)
        dead: set[tuple[int, int]] = set()
        path: list[int] = []
        places = [0]
        ways = [self._leaving(root, unit, 0)]
        while places[-1] < size:
            at, way = places[-1], ways[-1]
            last = path[-1] if path else -1
            if not way:
                if not path:
                    raise ValueError(f"no path through {unit[:40]!r}")
                dead.add((at, last))
                path.pop(), places.pop(), ways.pop()
                continue
            end, piece = way.pop()
            if last >= 0 and piece >= 0:
                fits = pairs.get(last << 32 | piece)
                if fits is None:
                    fits = joins(last, piece)
                if not fits:
                    continue
            if dead and (end, piece) in dead:
                continue
            path.append(piece)
            places.append(end)
            ways.append(self._leaving(root, unit, end) if end < size else None)
        out: list[int] = []
        for start, piece in zip(places, path):
            out.extend([piece] if piece >= 0 else [self.byte_ids[b] for b in unit[start].encode()])
        return out

    def _leaving(self, node: dict, unit: str, start: int) -> list[tuple[int, int]]:
        """(end, piece) of the transitions out of a place, shortest first; a byte spelling (-1) if no piece has the character."""
        out = []
        for end in range(start, len(unit)):
            node = node.get(unit[end])
            if node is None:
                break
            piece = node.get("")
            if piece is not None:
                out.append((end + 1, piece))
        return out or [(start + 1, -1)]

    def _cheapest_path(self, unit: str) -> list[int]:
        """Score models: every path is open, so the cheapest is found place by place."""
        best: list[tuple | None] = [(0.0, -1, 0)] + [None] * len(unit)
        for start in range(len(unit)):
            for end, piece in self._leaving(self._trie, unit, start):
                cost = best[start][0] + (-self.scores[piece] if piece >= 0 else 1e9)
                if best[end] is None or cost < best[end][0]:
                    best[end] = (cost, piece, start)
            if best[start + 1] is None:
                best[start + 1] = (best[start][0] + 1e9, -1, start)
        at, out = len(unit), []
        while at:
            _cost, piece, start = best[at]
            out.extend([piece] if piece >= 0 else [self.byte_ids[b] for b in reversed(unit[start:at].encode())])
            at = start
        return out[::-1]

    def encode_bytes(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        cache, parts = self._words, []
        for unit in _UNITS.findall(self.normalise(text)):
            found = cache.get(unit)
            parts.append(self._unit(unit) if found is None else found)
        return b"".join(parts)

    def _unit(self, unit: str) -> bytes:
        """Compose one unit; an end that no piece joins to what stands before it is looked up by itself."""
        if len(unit) > 1 and unit[-2:] not in self._inside:
            head, tail = unit[:-1], unit[-1]
            found = (self._words.get(head) or self._unit(head)) + (self._words.get(tail) or self._unit(tail)) if len(unit) <= _CACHED_CHARS else None
        else:
            found = None
        if found is None:
            found = np.array(self.shortest(unit), dtype="<i4").tobytes()
        if len(unit) <= _CACHED_CHARS:
            if len(self._words) >= CACHE_WORDS:
                self._words.clear()
            self._words[unit] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), dtype="<i4").tolist()

    def decode(self, ids) -> str:
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def load(path: str = DEFAULT_MODEL) -> Machine:
    """Compile the machine from a model file; read on the driver, sent to the tasks."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as schema

    with open(path, "rb") as source:
        content = source.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=content)
    spec = schema.ModelProto()
    spec.ParseFromString(content)
    if spec.normalizer_spec.precompiled_charsmap or spec.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("only models with the identity normaliser are compiled")
    size = model.get_piece_size()
    ids, scores, spelled, byte_ids = {}, [], [], [0] * 256
    for i in range(size):
        piece = model.id_to_piece(i)
        scores.append(model.get_score(i))
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            spelled.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelled.append(b"")
        else:
            ids[piece] = i
            spelled.append(piece.encode())
    odd = [p for p in ids if SPACE in p.lstrip(SPACE) or "\n" in p]
    if odd:
        raise ValueError(f"pieces cross a word border: {odd[:3]}")
    return Machine(ids, scores, spelled, byte_ids, spec.trainer_spec.model_type == 2, spec.normalizer_spec.add_dummy_prefix).compile()


def encode_documents(docs: DataFrame, model_path: str = DEFAULT_MODEL, column: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(load(model_path))

    def run(records):
        # A worker keeps a broadcast, and with it the word cache, for the tasks that name it and no longer.
        machine = shared.value
        for batch in common.batches(records, target=1 << 20):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            coded = [machine.encode_bytes(t) for t in texts]
            lengths = np.array([len(c) // 4 for c in coded], dtype=np.int64)
            flat = np.frombuffer(b"".join(coded), dtype="<i4")
            ids = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(lengths)]), pa.array(flat, pa.int32())).cast(pa.list_(pa.int32()))
            decoded = [machine.decode(np.frombuffer(c, dtype="<i4").tolist()) for c in coded]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").combine_chunks().cast(pa.int64()), ids, pa.array(decoded, pa.string())], names=["doc_id", "ids", "decoded"])

    source = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(column).alias("text"))
    return common.map_arrow(source, run, "doc_id bigint, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_pieces, ids_sha256, decoded_sha256) of encoded documents."""
    written = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return encoded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_pieces"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
