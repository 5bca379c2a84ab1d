"""Chat transcripts as token ids with a loss mask, assembled from separately encoded segments.

A conversation is a start sign and then, for each turn, an opening sign, the content and a closing sign. Signs are reserved ids above the
vocabulary and never come out of the encoder; contents are encoded on their own, a batch of segments at a time, and spliced between them at
places that a running sum of the segment lengths gives. The loss mask is another running sum: +1 where an assistant's content begins, -1 where it ends.

In the written form a sign is its string, so a content that holds a sign's string is escaped: a backslash goes in behind its first character, and
one more where backslashes stand there already. What begins a sign stands nowhere else in one, so escaping and its reverse act on the same places and
no content can form a sign with its neighbours. Reading back needs the ids and the mask alone.

Turns are dealt by conversation and sorted, then read as a stream. Work is done on at most ``BATCH_CHARS`` of content (or one longer content) at a time and a
conversation longer than ``PART_TOKENS`` goes on in further rows, so one that holds any share of all rows needs time but no memory.

Defined cases: a null text and a null role are empty strings; a null turn comes last. Turns of equal number are ordered by role, then text, and repeated rows are turns each.
Conversations with a null id are one conversation. A role without signs of its own is written out between the signs of a named role. A table without rows gives no row.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
BATCH_CHARS = 4 << 20
PART_TOKENS = 1 << 20
_PARTS = "conv_id bigint, part int, ids array<int>, loss array<boolean>, chars bigint"
_TURNS = "conv_id bigint, position bigint, role string, text string, loss boolean"
_DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


@dataclass(frozen=True)
class Template:
    """The signs of a chat format. ``roles`` maps a role to its opening and closing sign; other roles use ``named``."""

    start: str = "<s>"
    roles: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
    )
    named: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/TEXT]")
    learned: str = "assistant"

    def __post_init__(self):
        signs = self.signs()
        first = {s[:1] for s in signs}
        if len(set(signs)) < len(signs) or any(len(s) < 2 or "\\" in s or first & set(s[1:]) for s in signs):
            raise ValueError("signs must differ, have two characters at least, no backslash, and begin with what stands nowhere else in one")

    def signs(self) -> list[str]:
        return [self.start, *self.named, *[s for pair in self.roles.values() for s in pair]]

    def places(self, backslashes: str) -> re.Pattern:
        """Where a sign stands with so many backslashes behind its first character; the match ends in front of the rest."""
        rests: dict[str, list[str]] = {}
        for sign in sorted(self.signs()):
            rests.setdefault(sign[0], []).append(re.escape(sign[1:]))
        return re.compile("|".join(rf"{re.escape(first)}\\{backslashes}(?={'|'.join(rest)})" for first, rest in rests.items()))

    def escape(self, text: str) -> str:
        return self.places("*").sub(lambda m: m.group() + "\\", text)

    def unescape(self, text: str) -> str:
        return self.places("+").sub(lambda m: m.group()[:-1], text)


def _spelled(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary.

    Such a vocabulary writes a byte as a character: those that print in Latin-1 as themselves, the others by the characters from 256 on.
    """
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    names = [tokenizer.id_to_token(i) for i in range(tokenizer.get_vocab_size())]
    return [bytes(byte_of[c] for c in name) for name in names]


class Coder:
    """A vocabulary with the template's signs as ids above it."""

    def __init__(self, vocabulary: str, template: Template):
        # A task has one core; must be set before the library first encodes.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.template = template
        self.tokenizer = Tokenizer.from_str(vocabulary)
        # A string of a special token that occurs in a content is content.
        self.tokenizer.encode_special_tokens = True
        self.size = self.tokenizer.get_vocab_size()
        self.id_of = {s: self.size + i for i, s in enumerate(template.signs())}
        self.opens = {self.id_of[a]: role for role, (a, _b) in template.roles.items()}
        self.spelled = _spelled(self.tokenizer)

    def encode(self, contents: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(contents, add_special_tokens=False)]

    def decode(self, ids) -> str:
        """The content of one segment, as it was before escaping."""
        return self.template.unescape(self.written(ids))

    def written(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.spelled.__getitem__, ids)).decode()

    def segments(self, role: str, text: str) -> list[tuple[str | None, str | None, bool]]:
        """(sign, content, learned) of one turn; each has a sign or a content."""
        if role in self.template.roles:
            before, after = self.template.roles[role]
            return [(before, None, False), (None, text, role == self.template.learned), (after, None, False)]
        name, before, after = self.template.named
        return [(name, None, False), (None, role, False), (before, None, False), (None, text, role == self.template.learned), (after, None, False)]

    def assemble(self, segments: list[tuple[str | None, str | None, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, loss mask, first id of each segment and one more, characters written of each segment)."""
        segments = [(s, c if c is None else self.template.escape(c), l) for s, c, l in segments]
        contents = iter(self.encode([c for _s, c, _l in segments if c is not None]))
        pieces = [[self.id_of[s]] if c is None else next(contents) for s, c, _l in segments]
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        total = int(ends[-1]) if len(ends) else 0
        ids = np.fromiter(chain.from_iterable(pieces), dtype=np.int32, count=total)
        learned = np.array([l for _s, _c, l in segments], dtype=np.int64)
        steps = np.zeros(total + 1, dtype=np.int64)
        np.add.at(steps, starts, learned)
        np.add.at(steps, ends, -learned)
        chars = np.array([len(s) if c is None else len(c) for s, c, _l in segments], dtype=np.int64)
        return ids, np.cumsum(steps[:-1]) > 0, np.append(starts, total), chars


_CODERS: list[tuple[tuple, Coder]] = []


def _coder(shared) -> Coder:
    """One coder per Python worker; the broadcast value is kept with it."""
    if not _CODERS or _CODERS[0][0] is not shared.value:
        _CODERS[:] = [(shared.value, Coder(*shared.value))]
    return _CODERS[0][1]


def _shared(df: DataFrame, vocabulary_path: str, template: Template | None):
    with open(vocabulary_path, encoding="utf-8") as source:
        return df.sparkSession.sparkContext.broadcast((source.read(), template or Template()))


def _rows(records: Iterable[pa.RecordBatch], columns: list[str]) -> Iterator[tuple]:
    for record in records:
        for start in range(0, record.num_rows, 1024):
            piece = record.slice(start, 1024)
            yield from zip(*(piece.column(piece.schema.get_field_index(c)).to_pylist() for c in columns))


# --- writing ---------------------------------------------------------------------------------


def _batched_turns(rows: Iterator[tuple], batch_chars: int) -> Iterator[list[tuple]]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2] or "") + len(row[1] or "") + 64
        if size >= batch_chars:
            yield held
            held, size = [], 0
    if held:
        yield held


class _Parts:
    """Collects the ids of the running conversation into rows of at most ``most`` ids."""

    def __init__(self, most: int):
        self.most, self.conversation, self.number = most, None, 0
        self.ids: list[np.ndarray] = []
        self.loss: list[np.ndarray] = []
        self.size = self.chars = 0
        self.done: list[tuple] = []

    def begin(self, conversation) -> None:
        self.close()
        self.conversation, self.number = (conversation,), 0

    def add(self, ids: np.ndarray, loss: np.ndarray, chars: int) -> None:
        self.chars += chars
        while len(ids):
            room = self.most - self.size
            self.ids.append(ids[:room])
            self.loss.append(loss[:room])
            self.size += len(self.ids[-1])
            ids, loss = ids[room:], loss[room:]
            if self.size == self.most and len(ids):
                self._emit()

    def close(self) -> None:
        if self.conversation is not None:
            self._emit()
            self.conversation = None

    def _emit(self) -> None:
        join = lambda a, kind: np.concatenate(a) if a else np.zeros(0, kind)
        self.done.append((self.conversation[0], self.number, join(self.ids, np.int32), join(self.loss, bool), self.chars))
        self.number, self.ids, self.loss, self.size, self.chars = self.number + 1, [], [], 0, 0

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.done:
            conv, part, ids, loss, chars = zip(*self.done)
            offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
            lists = lambda values: pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(values)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(part, pa.int32()), lists(ids), lists(loss), pa.array(chars, pa.int64())],
                names=["conv_id", "part", "ids", "loss", "chars"],
            )
            self.done = []


def formatted(
    conversations: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY, template: Template | None = None, part_tokens: int = PART_TOKENS, batch_chars: int = BATCH_CHARS
) -> DataFrame:
    """(conv_id, part, ids, loss, chars): a conversation's ids in parts of at most ``part_tokens``, nearly always one.

    ``chars`` counts the characters that the part's segments take in the written form, a segment where it begins.
    """
    shared = _shared(conversations, vocabulary_path, template)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")

    def run(records) -> Iterator[pa.RecordBatch]:
        coder, parts = _coder(shared), _Parts(part_tokens)
        for batch in _batched_turns(_rows(records, ["conv_id", "role", "text"]), batch_chars):
            segments, first, opened = [], [], []
            running = parts.conversation
            for conversation, role, text_ in batch:
                fresh = running != (conversation,)
                running = (conversation,)
                first.append(len(segments))
                opened.append(fresh)
                segments += [(coder.template.start, None, False)] * fresh + coder.segments(role, text_)
            first.append(len(segments))
            ids, loss, starts, chars = coder.assemble(segments)
            written = np.concatenate([[0], np.cumsum(chars)])
            # Turns that follow each other in one conversation are added as one stretch.
            cuts = [i for i, fresh in enumerate(opened) if fresh or i == 0] + [len(batch)]
            for a, b in zip(cuts, cuts[1:]):
                if opened[a]:
                    parts.begin(batch[a][0])
                low, top = first[a], first[b]
                parts.add(ids[starts[low] : starts[top]], loss[starts[low] : starts[top]], int(written[top] - written[low]))
            yield from parts.take()
        parts.close()
        yield from parts.take()

    return common.map_arrow(dealt, run, _PARTS)


# --- reading ---------------------------------------------------------------------------------


def _parts_of(records: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, ids, loss, chars) of each part, ids and loss as arrays."""
    for record in records:
        column = lambda c: record.column(record.schema.get_field_index(c))  # noqa: B023, E731
        borders = column("ids").offsets.to_numpy()
        ids, loss = column("ids").flatten().to_numpy(), column("loss").flatten().to_numpy(zero_copy_only=False)
        borders = borders - borders[0]
        for conversation, chars, a, b in zip(column("conv_id").to_pylist(), column("chars").to_pylist(), borders, borders[1:]):
            yield conversation, ids[a:b], loss[a:b], chars


def _turns(coder: Coder, parts: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, event, value, learned) of the sorted parts: ``begin`` of a conversation, its ``turn``s as (role, text), and ``chars`` of each part.

    Only ids and mask are looked at. ``learned`` is the text under the mask. At most one turn is held.
    """
    t = coder.template
    text_id, close_named = (coder.id_of[s] for s in t.named[1:])
    closes = {coder.id_of[b] for _a, b in t.roles.values()} | {close_named}
    running, role, held, masks = None, None, [], []
    for conversation, ids, loss, chars in parts:
        if running != (conversation,):
            if role is not None or held:
                raise ValueError(f"conversation {running} ends inside a turn")
            running = (conversation,)
            yield conversation, "begin", None, ""
        yield conversation, "chars", chars, ""
        at = 0
        for sign in [*np.flatnonzero(ids >= coder.size).tolist(), len(ids)]:
            if sign > at:
                held.append(ids[at:sign])
                masks.append(loss[at:sign])
            if sign < len(ids):
                kind = int(ids[sign])
                if kind in coder.opens:
                    role = coder.opens[kind]
                elif kind == text_id:
                    role, held, masks = coder.decode(_joined(held)), [], []
                elif kind in closes:
                    content = coder.decode(_joined(held))
                    mask = np.concatenate(masks) if masks else np.zeros(0, bool)
                    learned = content if mask.all() and len(mask) else (coder.decode(np.concatenate(held)[mask].tolist()) if mask.any() else "")
                    yield conversation, "turn", (role, content), learned
                    role, held, masks = None, [], []
            at = sign + 1


def _joined(pieces: list[np.ndarray]) -> list[int]:
    return [i for p in pieces for i in p.tolist()]


def _sorted_parts(parts: DataFrame) -> DataFrame:
    return parts.select("conv_id", "part", "ids", "loss", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "part")


def turns_of(parts: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY, template: Template | None = None) -> DataFrame:
    """(conv_id, position, role, text, loss): the turns that the ids spell, ``loss`` where the mask covers the text."""
    shared = _shared(parts, vocabulary_path, template)

    def run(records) -> Iterator[pa.RecordBatch]:
        held, size, position = [], 0, 0
        names = ["conv_id", "position", "role", "text", "loss"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), types)], names=names)
        for conversation, event, value, learned in _turns(_coder(shared), _parts_of(records)):
            if event == "begin":
                position = 0
            elif event == "turn":
                held.append((conversation, position, *value, bool(learned)))
                position, size = position + 1, size + len(value[1])
                if size > BATCH_CHARS or len(held) > 10_000:
                    yield batch()
                    held, size = [], 0
        if held:
            yield batch()

    return common.map_arrow(_sorted_parts(parts), run, _TURNS)


def read_back(parts: DataFrame, vocabulary_path: str = DEFAULT_VOCABULARY, template: Template | None = None) -> DataFrame:
    """One row per conversation with digests of the turns and of the text under the loss mask, both read from the ids."""
    shared = _shared(parts, vocabulary_path, template)

    def run(records) -> Iterator[pa.RecordBatch]:
        done: list[list] = []
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def batch() -> pa.RecordBatch:
            rows = [(c, n, turns.hexdigest(), chars, loss.hexdigest(), written) for c, n, turns, chars, loss, written in done]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), types)], names=names)

        for conversation, event, value, learned in _turns(_coder(shared), _parts_of(records)):
            if event == "begin":
                if len(done) >= 10_000:
                    yield batch()
                    done.clear()
                done.append([conversation, 0, hashlib.sha256(), 0, hashlib.sha256(), 0])
            row = done[-1]
            if event == "chars":
                row[5] += value
            elif event == "turn":
                row[1] += 1
                row[2].update(f"{value[0]}\n{value[1]}\n".encode())
                row[3] += len(learned)
                row[4].update(learned.encode())
        if done:
            yield batch()

    return common.map_arrow(_sorted_parts(parts), run, _DIGESTS)
