from __future__ import annotations

import hashlib

import numpy as np
import pytest

from pairloom.llm import exact_dedup, ngram_join, substring_dedup
from tests.llm.helpers import SCHEMA, WORD, fold, frame, prose, with_clashes


def exact_plain(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(fold(t), []).append(i)
    out = []
    for i, t in rows:
        ids = groups[fold(t)]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(fold(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", [exact_dedup.digest, lambda c: bytes([len(c) % 3])], ids=["digest", "clashing digest"])
def test_exact_groups_equal_plain(spark, name):
    rng = np.random.default_rng(1)
    long = prose(rng, 30_000)
    rows = [(0, "Ab"), (1, "aB"), (2, None), (3, ""), (4, long), (5, long.upper()), (6, long + "!"), (7, "É"), (8, "é"), (9, "ab "), (None, "AB"), (9, "ab "), (10, "x" * 200_000)]
    got = exact_dedup.exact_groups(with_clashes(frame(spark, rows), "keep_id", "recipe", "kept"), name)
    assert sorted(map(tuple, got.collect()), key=str) == exact_plain(rows)


def test_chunk_ends_depend_on_near_bytes_only():
    data = np.frombuffer(np.random.default_rng(2).bytes(200_000), np.uint8)
    ends = exact_dedup.boundaries(data)
    moved = exact_dedup.boundaries(np.concatenate([data[:1000], data]))
    assert set((ends[ends > 32] + 1000).tolist()) <= set(moved.tolist()) and ends[-1] == len(data)
    assert np.diff(exact_dedup.boundaries(np.zeros(300_000, np.uint8)), prepend=0).max() <= exact_dedup.MAX_CHUNK


def test_exact_stage_keeps_the_largest_id_and_all_columns(spark):
    docs = with_clashes(frame(spark, [(1, "a"), (2, "A"), (3, None), (4, ""), (5, "b"), (5, "b"), (5, "B")]), "kept", "__n")
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5]
    assert exact_dedup.drop_duplicates(docs.limit(0)).count() == 0


def near_plain(rows):
    sets = []
    for _i, t in rows:
        w = WORD.findall(fold(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    least = {}
    for g, (i, _t) in zip(group, rows):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted([(i, len(s), least.get(g)) for (i, _t), s, g in zip(rows, sets, group)], key=str)


def test_near_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows, base = [], [prose(rng, n) for n in (7, 12, 60, 60, 300)]
    passage = prose(rng, 40)
    for i in range(220):
        words = base[rng.integers(5)].split()
        for _ in range(rng.integers(0, 5)):
            words[rng.integers(len(words))] = f"v{rng.integers(10_000)}"
        rows.append((i, " ".join(words) if rng.random() < 0.8 else passage + " " + prose(rng, int(rng.integers(1, 40)))))
    # A chain in which neighbours are linked and ends are not.
    line = prose(rng, 200, 10_000).split()
    rows += [(300 + k, " ".join(line[6 * k : 6 * k + 100])) for k in range(12)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "one two"), (404, "ONE two"), (405, "one"), (406, "a b c d e"), (406, "a b c d e"), (None, "a b c d e"), (None, None)]
    got = ngram_join.near_groups(with_clashes(frame(spark, rows), "node", "component_id", "n_shingles"))
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect()), key=str) == near_plain(rows)


def test_links_of_near_copies_are_all_counted(spark):
    rng = np.random.default_rng(15)
    base, line = prose(rng, 150), prose(rng, 200, 10_000).split()
    rows = []
    for i in range(90):
        words = base.split()
        for _ in range(rng.integers(0, 5)):
            words[rng.integers(len(words))] = f"v{rng.integers(10_000)}"
        rows.append((i, " ".join(words)))
    rows += [(200 + k, " ".join(line[6 * k : 6 * k + 100])) for k in range(12)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, ""), (304, "one"), (304, "one"), (None, base)]
    sets = []
    for _i, t in rows:
        w = WORD.findall(fold(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    want = [sum(1 for b, y in enumerate(sets) if a != b and x and y and 100 * len(x & y) >= 80 * len(x | y)) for a, x in enumerate(sets)]
    for cell in (1 << 20, 20_000):
        got = ngram_join.linked_groups(with_clashes(frame(spark, rows), "n_links", "weight"), cell)
        assert sorted(((r.doc_id, r.n_links) for r in got.collect()), key=str) == sorted(((i, n) for (i, _t), n in zip(rows, want)), key=str)


def test_near_stage_keeps_one_of_each_class(spark):
    rng = np.random.default_rng(6)
    base = prose(rng, 80)
    docs = with_clashes(frame(spark, [(3, base), (1, base + " end"), (2, prose(rng, 80)), (9, None), (8, ""), (2000, base), (1, base + " end")]), "node", "n")
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 8, 9]
    assert ngram_join.drop_near_duplicates(docs.limit(0)).count() == 0


def passages_plain(rows):
    windows = {}
    words = [WORD.findall(t or "") for _i, t in rows]
    rank = lambda i: (i is None, i or 0)
    for (i, _t), w in zip(rows, words):
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            windows[key] = min(rank(i), windows.get(key, rank(i)))
    out = []
    for (i, _t), w in zip(rows, words):
        gone = {p for k in range(len(w) - 12) if windows[tuple(w[k : k + 13])] < rank(i) for p in range(k, k + 13)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def test_repeated_passages_equal_plain(spark):
    rng = np.random.default_rng(8)
    shared = [prose(rng, n) for n in (13, 14, 60, 12)]
    rows = [(int(i), " ".join([prose(rng, int(rng.integers(0, 30))), shared[rng.integers(4)], prose(rng, 5), shared[rng.integers(4)]])) for i in rng.permutation(60)]
    rows += [(100, None), (101, ""), (102, "a " * 30), (103, "A " * 30), (103, "a " * 30), (None, shared[2]), (None, shared[2]), (104, shared[0] + "\x0b" + shared[2])]
    for parts in (1, 7):
        docs = with_clashes(frame(spark, rows).repartition(parts), "factors", "batch", "n_words")
        got = substring_dedup.duplicate_spans(docs).drop("factors")
        assert sorted(map(tuple, got.collect()), key=str) == passages_plain(rows)
    assert substring_dedup.duplicate_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def test_factors_name_their_source(spark):
    rng = np.random.default_rng(9)
    a, b = prose(rng, 20), prose(rng, 15)
    got = substring_dedup.duplicate_spans(frame(spark, [a, b, f"x {b} y y {a}"])).where("doc_id = 2").first().factors
    assert [tuple(f) for f in got] == [(1, 15, 1, 0), (18, 20, 0, 0)]


def parse_plain(rows, window=13):
    """Factors of each document, taken left to right along the first places of its windows."""
    words = {i: WORD.findall(t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), (i, k))
    out = {}
    for i, own in words.items():
        place = [first[tuple(own[k : k + window])] for k in range(len(own) - window + 1)]
        out[i], k, end = [], 0, 0
        while k < len(place):
            if place[k][0] >= i:
                k += 1
                continue
            size = 1
            while k + size < len(place) and place[k + size] == (place[k][0], place[k][1] + size):
                size += 1
            taken = max(0, end - k)
            out[i].append((k + taken, size - 1 + window - taken, place[k][0], place[k][1] + taken))
            k, end = k + size, k + size - 1 + window
    return words, out


@pytest.mark.parametrize("blocks", [3_000_000, 200])
def test_factors_are_a_greedy_parse_and_copies_word_for_word(spark, blocks):
    rng = np.random.default_rng(14)
    shared = [prose(rng, n) for n in (13, 16, 40, 90)]
    rows = [(int(i), " ".join([prose(rng, int(rng.integers(0, 9))), shared[rng.integers(4)], shared[rng.integers(4)], prose(rng, 3), shared[rng.integers(4)]])) for i in rng.permutation(70)]
    long = rows[5][1].split() * 2000
    rows += [(200, " ".join(long)), (201, "b " * 40), (202, "x " + "b " * 30), (203, shared[2][: len(shared[2]) // 2] + " z " + shared[3])]
    words, want = parse_plain(rows)
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in substring_dedup.duplicate_spans(frame(spark, rows).repartition(5), block_windows=blocks).collect()}
    assert got == want and sum(map(len, want.values())) > 100
    for i, parsed in got.items():
        end = 0
        for start, size, source, there in parsed:
            assert source < i and start >= end and words[i][start : start + size] == words[source][there : there + size]
            end = start + size
