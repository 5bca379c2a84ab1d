"""Tokens and their hashes in batches equal plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest

from pairloom.functions.text import ODD_SPACES
from pairloom.operators import tokens

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("alphabet", ["ab Z", "ab\t\n\r A", "aé\x85 　B ", "a\x1c\x1f  ", "漢É\xa0 x"])
def test_tokens_are_those_between_whitespace(alphabet):
    rng = random.Random(len(alphabet))
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", " ", "x" * 5000]
    for lower in (False, True):
        for part in (pa.array(texts), pa.array(texts)[17:90], pa.array([], pa.string()), pa.array([None, ""], pa.string())):
            batch = tokens.split_tokens(part, lower)
            found = [[batch.vocabulary[c].as_py() for c in batch.codes[a:b]] for a, b in zip(batch.edges, batch.edges[1:])]
            want = [[t for t in re.split(f"[ {ODD_SPACES}]", text or "") if t] for text in part.to_pylist()]
            assert found == [[t.translate(ASCII) for t in row] if lower else row for row in want]


def test_hashes_are_md5_heads(monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab é漢") for _ in range(rng.randrange(70))) for _ in range(3000)] + ["", "x" * 55, "x" * 56, "é" * 28]
    want = [int(hashlib.md5(t.encode()).hexdigest()[:15], 16) for t in texts]
    for rows in (16_384, 100):
        monkeypatch.setattr(tokens, "_MD5_ROWS", rows)
        assert tokens.hash60(pa.array(texts)).tolist() == want
        assert tokens.hash60(pa.array(texts)[40:45]).tolist() == want[40:45]
    assert tokens.hash60(pa.array([], pa.string())).tolist() == []
