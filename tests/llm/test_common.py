from __future__ import annotations

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import common
from tests.llm.helpers import WORD, fold

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\té\u3000\x1f", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    raw, offsets = common.text_buffer(pa.array(texts, pa.string()))
    starts, ends, first = common.words(raw, offsets)
    got = [[raw[a:b].tobytes().decode() for a, b in zip(starts[x:y], ends[x:y])] for x, y in zip(first[:-1], first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]


@settings(max_examples=100, deadline=None)
@given(TEXTS)
def test_equal_hash_means_equal_word(texts):
    raw, offsets = common.text_buffer(pa.array(texts, pa.string()))
    starts, ends, _ = common.words(raw, offsets)
    plain = [fold(raw[a:b].tobytes().decode()) for a, b in zip(starts, ends)]
    hashes = common.word_hashes(raw, starts, ends, fold_case=True)
    assert len(set(plain)) == len(set(zip(plain, hashes.tolist()))) == len(set(hashes.tolist()))


def test_hash_of_a_word_does_not_depend_on_its_place():
    long = "x" * 200_000
    raw, offsets = common.text_buffer(pa.array([f"abc {long} abc", "y " * 100_000 + "abc " + long]))
    starts, ends, _ = common.words(raw, offsets)
    hashes = common.word_hashes(raw, starts, ends)
    assert hashes[0] == hashes[2] == hashes[-2] and hashes[1] == hashes[-1] and hashes[0] != hashes[1]


def test_batches_keep_every_row_and_bound_their_text():
    texts = ["a" * n for n in (0, 5, 100, 3, 3, 3, 50)] + [None]
    records = pa.table({"text": texts, "k": list(range(8))}).to_batches(max_chunksize=3)
    found = list(common.batches(records, target=10))
    assert [k for t in found for k in t.column("k").to_pylist()] == list(range(8))
    assert all(sum(len(x or "") for x in t.column("text").to_pylist()[:-1]) < 10 for t in found)


def test_components_equal_a_plain_union(spark):
    rng = np.random.default_rng(3)
    links = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 60, (50, 2))] + [("n70", f"n{i}") for i in range(80, 120)] + [(f"p{i}", f"p{i + 1}") for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {x: find(x) for a, b in links if a != b for x in (a, b)}
    assert common.components(spark.createDataFrame([], "a string, b string")).count() == 0
