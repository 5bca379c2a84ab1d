"""License notices by conditional compression.

Words that a notice cannot do without, taken from the templates given, say where to look: a notice may differ from its template in few words, so of one more than that
many of the template's words at least one stands in it. Around these the words of a text make blocks, and long blocks are cut to pieces of bounded words that overlap by more
than a notice. Each piece is compressed alone and with the template as a zstandard raw dictionary, with the same parameters: the more of the template it repeats, the more
bytes the dictionary saves. All candidates of a text are ranked by the share of the template's own compressed size that is saved, and confirmed in that order by the words
themselves: the template must align with the piece with few words different; words once taken count for no other notice. Savings rank and nothing more: no candidate
is dropped for saving little, so the length of the text around a notice does not matter.

Defined cases: null and empty texts and texts without such words give no row; repeated rows give their rows each time; equal savings are
ranked by template name, then place. A template without words is refused.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

# Public license wordings.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that "
        "it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution."
    ),
}
MOST_CHANGED = 0.15
# A piece is so many times as long as the longest notice of its template; the next begins where a notice could still be cut.
PIECE_NOTICES = 4
# The same on both sides, whatever the size of a piece.
_CODING = zstandard.ZstdCompressionParameters(window_log=17, chain_log=12, hash_log=12, search_log=4, min_match=4, strategy=zstandard.STRATEGY_LAZY)
_WORD = re.compile(r"[\w.+-]*\w")


@dataclass
class Template:
    name: str
    words: list[str]
    coder: zstandard.ZstdCompressor
    alone: int

    @property
    def limit(self) -> int:
        """Words that may differ."""
        return int(MOST_CHANGED * len(self.words))

    @property
    def span(self) -> int:
        """Words that a notice and its surroundings in an alignment take at most."""
        return len(self.words) + 2 * max(3, self.limit)

    def cues(self) -> list[str]:
        """Words of which at least one stands in every notice: one place of the template more than may differ, long words first."""
        times = Counter(self.words)
        out, places = [], 0
        for word in sorted(times, key=lambda w: (-len(w), w)):
            out.append(word)
            places += times[word]
            if places > self.limit:
                break
        return out


@dataclass
class Templates:
    """Compiled templates, and the automaton of their cues: a cue's value is the numbers of its templates."""

    templates: list[Template]
    automaton: ahocorasick.Automaton

    def cue_places(self, text: str) -> dict[int, list[int]]:
        """Template number to the places in the lowered text where one of its cues may begin."""
        found: dict[int, list[int]] = {}
        for end, (size, numbers) in self.automaton.iter(text):
            for n in numbers:
                found.setdefault(n, []).append(end + 1 - size)
        return found


def _plain_coder() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(compression_params=_CODING)


def compile_templates(templates: dict[str, str]) -> Templates:
    plain, out, numbers = _plain_coder(), [], {}
    for name, text in sorted(templates.items()):
        words = [w.lower() for w in _WORD.findall(text)]
        if not words:
            raise ValueError(f"template {name!r} has no words")
        raw = " ".join(words).encode()
        shared = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(Template(name, words, zstandard.ZstdCompressor(compression_params=_CODING, dict_data=shared), len(plain.compress(raw))))
        for cue in out[-1].cues():
            numbers.setdefault(cue, []).append(len(out) - 1)
    automaton = ahocorasick.Automaton()
    for cue, those in numbers.items():
        automaton.add_word(cue, (len(cue), those))
    if out:
        automaton.make_automaton()
    return Templates(out, automaton)


def pieces(cues: list[int], template: Template, count: int) -> list[tuple[int, int]]:
    """(first, last) words to look at: all that lie near enough to a cue, cut to bounded lengths that overlap by a notice."""
    blocks: list[list[int]] = []
    for at in sorted(cues):
        low, top = max(0, at - template.span), min(count, at + template.span + 1)
        if blocks and low <= blocks[-1][1]:
            blocks[-1][1] = max(top, blocks[-1][1])
        else:
            blocks.append([low, top])
    most, step = PIECE_NOTICES * template.span, (PIECE_NOTICES - 1) * template.span
    return [(a, min(a + most, top)) for low, top in blocks for a in range(low, max(low + 1, top - template.span), step)]


def runs(template: list[str], words: list[str], least: int) -> list[tuple[int, int, int]]:
    """(words, place in the block, place in the template) of all longest common runs of at least ``least`` words, long ones first."""
    places: dict[str, list[int]] = {}
    for j, w in enumerate(template):
        places.setdefault(w, []).append(j)
    out, before = [], {}
    for i, w in enumerate([*words, ""]):
        now = {j: before.get(j - 1, 0) + 1 for j in places.get(w, ())}
        out += [(n, i - n, j + 1 - n) for j, n in before.items() if n >= least and j + 1 not in now]
        before = now
    return sorted(out, key=lambda r: (-r[0], r[1], r[2]))


def aligned(template: list[str], words: list[str]) -> tuple[int, int, int] | None:
    """(words that differ, first, last) of an alignment of the template inside the block with few enough of them.

    With c words of the template changed and c words put in between, what is left stands in 2 c + 1 runs, so each run that can be the longest
    one of such an alignment is tried as its core. Places where too few words of the template stand are passed over.
    """
    limit = int(MOST_CHANGED * len(template))
    wanted, tried = Counter(template), set()
    for _size, a, b in runs(template, words, -(-(len(template) - limit) // (2 * limit + 1))):
        for slack in sorted({3, max(3, limit)}):
            low, top = max(0, a - b - slack), min(len(words), a - b + len(template) + slack)
            if (low, top) in tried:
                continue
            tried.add((low, top))
            if (wanted & Counter(words[low:top])).total() < len(template) - limit:
                continue
            matcher = difflib.SequenceMatcher(None, words[low:top], template, autojunk=False)
            spans = [m for m in matcher.get_matching_blocks() if m.size]
            same = sum(m.size for m in spans)
            first, last = low + spans[0].a, low + spans[-1].a + spans[-1].size
            changed = max(len(template), last - first) - same
            if changed <= limit:
                return changed, first, last
    return None


def notices(text: str | None, compiled: Templates) -> list[tuple[str, int, float, int, int, int]]:
    """(license, bytes saved, share saved, words changed, start, stop) of the confirmed notices of a text."""
    if not text or not compiled.templates:
        return []
    lowered = text.lower()
    # Few characters become two in lower case; then places in the lowered text say nothing, and words are looked up one by one.
    cues = compiled.cue_places(lowered) if len(lowered) == len(text) else None
    if cues == {}:
        return []
    found = [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]
    words, starts = [w for w, _a, _b in found], [a for _w, a, _b in found]
    plain, ranked, sizes = _plain_coder(), [], {}
    for n, template in enumerate(compiled.templates):
        wanted = set(template.cues())
        # A cue inside a longer word is none.
        at = range(len(words)) if cues is None else {bisect_right(starts, p) - 1 for p in cues.get(n, ())}
        for low, top in pieces([i for i in at if i >= 0 and words[i] in wanted], template, len(words)):
            raw = " ".join(words[low:top]).encode()
            if (low, top) not in sizes:
                sizes[low, top] = len(plain.compress(raw))
            saved = sizes[low, top] - len(template.coder.compress(raw))
            ranked.append((-saved / template.alone, template.name, low, top, saved, template))
    out = []
    for share, name, low, top, saved, template in sorted(ranked, key=lambda r: r[:4]):
        # A piece may hold a notice again; words that are taken match nothing more.
        while (place := aligned(template.words, words[low:top])) is not None:
            changed, first, last = place
            out.append((name, saved, float(-share), changed, found[low + first][1], found[low + last - 1][2]))
            words[low + first : low + last] = [""] * (last - first)
    return out


_SCHEMA = "doc_id bigint, license string, saved_bytes int, saved_share double, words_changed int, start bigint, stop bigint"


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per confirmed notice; offsets count characters of the text."""
    texts = TEMPLATES if templates is None else templates

    def run(records) -> Iterator[pa.RecordBatch]:
        compiled = compile_templates(texts)
        for record in records:
            rows = [(i, *n) for i, t in zip(record.column(0).to_pylist(), record.column(1).to_pylist()) for n in notices(t, compiled)]
            if rows:
                types = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
                names = ["doc_id", "license", "saved_bytes", "saved_share", "words_changed", "start", "stop"]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)

    return common.map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, _SCHEMA)
