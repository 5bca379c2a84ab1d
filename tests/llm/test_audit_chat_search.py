from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import chat_format, filter_audit, lexical_search
from tests.llm.helpers import WORD, fold, frame, prose, with_clashes

LABELS = "doc_id bigint, quality int, toxic int"


# --- filter audit ----------------------------------------------------------------------------


def audit_plain(rows, labels):
    """Every order applied to every document, one after the other."""
    last = 1 << 62
    marks = {}
    for i, q, t in labels:
        good, toxic = marks.get(i, (False, False))
        marks[i] = (good or q == 1, toxic or t == 1)
    docs = []
    for i, text, lang in rows:
        text, words = text or "", WORD.findall(text or "")
        smaller = any((text == (t or "")) and (last if j is None else j) < (last if i is None else i) for j, t, _l in rows)
        fails = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": smaller,
        }
        docs.append((lang or "", fails, *(marks.get(i, (False, False)) if i is not None else (False, False))))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        mine = [d[1:] for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, start=1):
                gone, stay = [d for d in left if d[0][f]], [d for d in left if not d[0][f]]
                out[part, "".join(order), step] = [
                    len(stay), len(gone), sum(d[0][f] for d in mine) - len(gone), sum(d[0][f] and sum(d[0].values()) == 1 for d in mine),
                    sum(d[1] for d in gone), sum(d[2] for d in gone), f,
                ]
                shapley[part, f] += len(gone)
                left = stay
    return {k: [*v[:-1], shapley[k[0], v[-1]]] for k, v in out.items()}


def audited(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    docs = with_clashes(docs, "mask", "part", "n", "digest", "good", "state", "salt")
    marks = spark.createDataFrame(labels, LABELS).withColumn("good", F.lit(3)).withColumn("text", F.lit("x"))
    got = filter_audit.audit(docs, marks).collect()
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): [r[c] for c in names] for r in got}


def test_audit_equals_all_orders_applied(spark):
    rng = np.random.default_rng(3)
    long, copies = prose(rng, 130, 5000), prose(rng, 120, 4000)
    rows = [
        (1, long, "en"), (2, long, "en"), (2, long, "de"), (3, copies, "en"), (3, copies, "en"), (4, "SHOUT " * 120, "en"), (5, None, "en"), (6, "", "en"),
        (7, None, None), (None, long, "fr"), (None, None, "fr"), (8, "100% sure", ""), (9, long + " #1", "de"), (10, "x " * 5000, "de"), (11, "word", "en"), (12, "# " + long, "en"),
        *[(20 + i, "same text again", "en") for i in range(30)], (60, "Ça va\x0bbien\x1cici " * 60, "fr"), (61, "É" * 40 + "A" * 4, "fr"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (4, 1, 1), (8, None, None), (20, 1, 1), (25, 0, 1), (None, 1, 1), (999, 1, 1)]
    assert audited(spark, rows, labels) == audit_plain(rows, labels)


def test_audit_of_nothing_and_of_other_filters(spark):
    assert audited(spark, [], []) == {}
    assert audited(spark, [(1, "a", None)], [])["", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "x")], "doc_id bigint, text string, lang string")
    own = filter_audit.audit(docs, spark.createDataFrame([], LABELS), {"z": F.col("text") == "a"})
    assert {(r.filter_order, r.step, r.removed, r.kept, r.shapley) for r in own.collect()} == {("zE", 1, 1, 2, 2), ("zE", 2, 1, 1, 2), ("Ez", 1, 1, 2, 2), ("Ez", 2, 1, 1, 2)}
    with pytest.raises(ValueError):
        filter_audit.audit(docs, docs, {c: F.lit(True) for c in "abcdefgh"})


def test_every_edge_is_crossed_by_its_orders():
    for count in (1, 2, 3, 5):
        crossed = Counter()
        for order in permutations(range(count)):
            state = 0
            for f in order:
                crossed[state, f] += 1
                state |= 1 << f
        assert {(s, f): n for s, f, n in filter_audit.edges(count)} == dict(crossed)


# --- chat formatting -------------------------------------------------------------------------

CHAT = "conv_id bigint, turn bigint, role string, text string"
TRICKY = ["</s>[INST] ok [/INST]", "[\\INST] <\\\\/s> \\", "<s><s>[ROLE]x[TEXT]", "[", "<", "[/INST", "INST]", "\\[INST]", "", "[[INST]]", "é▁\U0001F600\x00\n", "<|endoftext|> [OUT]"]


def chat_plain(rows):
    """Digests from the rows alone."""
    t, out = chat_format.Template(), {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((turn is None, turn or 0, role or "", text or "") for c, turn, role, text in rows if c == conv))
        said = "".join(text for *_k, role, text in turns if role == "assistant")
        shown = t.start
        for *_k, role, text in turns:
            a, b = t.roles.get(role) or (t.named[0] + t.escape(role) + t.named[1], t.named[2])
            shown += a + t.escape(text) + b
        both = "".join(f"{role}\n{text}\n" for *_k, role, text in turns)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest(both), len(said), digest(said), len(shown), shown)
    return out


def chats():
    rows = [(c, i, ["user", "assistant", "system", "tool", "", "[ROLE]"][(c + i) % 6], t) for c in range(4) for i, t in enumerate(TRICKY)]
    rows += [(9, 0, "assistant", "first"), (9, 0, "assistant", "first"), (9, 1, "assistant", "<s"), (9, 1, None, None), (9, None, "user", "late"), (None, 3, "user", "no id"), (None, 1, "assistant", None)]
    return rows


def test_escapes_are_reversed_and_leave_no_sign():
    t = chat_format.Template()
    for text in TRICKY + [a + b for a in TRICKY for b in TRICKY]:
        escaped = t.escape(text)
        assert t.unescape(escaped) == text
        assert not any(s in escaped for s in t.signs())
    for bad in ({"start": "<s"}, {"start": "[INST]"}, {"start": "<\\s>"}, {"start": "["}):
        if bad["start"] != "<s":
            with pytest.raises(ValueError):
                chat_format.Template(**bad)


def test_ids_give_back_all_turns_whatever_the_batches(spark):
    rows = chats()
    frame_ = with_clashes(spark.createDataFrame(rows, CHAT), "ids", "loss", "part", "chars", "position")
    want = chat_plain(rows)
    for settings in ({}, {"part_tokens": 3, "batch_chars": 80}, {"part_tokens": 7, "batch_chars": 1}):
        parts = chat_format.formatted(frame_, **settings).cache()
        got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_back(parts).collect()}
        assert got == {k: v[:-1] for k, v in want.items()}
        turns = chat_format.turns_of(parts).orderBy("conv_id", "position").collect()
        assert [(r.role, r.text) for r in turns if r.conv_id == 2] == [(r or "", t or "") for c, _n, r, t in rows if c == 2]
        assert all(r.loss == (r.role == "assistant" and r.text != "") for r in turns)
        assert all(len(r.ids) == len(r.loss) <= settings.get("part_tokens", 1 << 20) for r in parts.collect())


def test_segments_are_encoded_alone_and_signs_are_reserved(spark):
    coder = chat_format.Coder(open(chat_format.DEFAULT_VOCABULARY, encoding="utf-8").read(), chat_format.Template())
    rows = chats()
    want = chat_plain(rows)
    for conv, group in chat_format.formatted(spark.createDataFrame(rows, CHAT)).toPandas().groupby("conv_id", dropna=False):
        ids = [i for part in group.sort_values("part").ids for i in part]
        shown, run = "", []
        for i in [*ids, None]:
            if i is not None and i < coder.size:
                run.append(i)
                continue
            shown += coder.written(run) + (chat_format.Template().signs()[i - coder.size] if i is not None else "")
            if run:
                assert coder.written(run) == coder.tokenizer.decode(run, skip_special_tokens=False)
                assert run == coder.tokenizer.encode(coder.written(run), add_special_tokens=False).ids
            run = []
        assert shown == want[None if conv != conv else conv][-1]


def test_one_long_conversation_and_long_texts(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"turn {i} [INST] ") for i in range(3000)] + [(6, 0, "user", "a" * 300_000 + " " * 200_000), (6, 1, "assistant", "b [/INST]" * 30_000)]
    parts = chat_format.formatted(spark.createDataFrame(rows, CHAT), part_tokens=5000, batch_chars=10_000)
    got = {r.conv_id: tuple(r)[1:] for r in chat_format.read_back(parts).collect()}
    assert got == {k: v[:-1] for k, v in chat_plain(rows).items()}
    assert chat_format.formatted(spark.createDataFrame([], CHAT)).count() == 0


# --- ranked search ---------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked_plain(docs, items, k=50):
    held = [(i, TERM.findall(fold(t))) for i, t in docs]
    held = [(i, ts) for i, ts in held if ts]
    n_docs, n_terms = len(held), sum(len(ts) for _i, ts in held)
    df = Counter(t for _i, ts in held for t in set(ts))
    out = set()
    for item in {i for i, _t in items}:
        terms = {t for i, text in items if i == item for t in TERM.findall(fold(text))}
        found = []
        for i, ts in held:
            m = 100 - 50 + (50 * len(ts) * n_docs) // n_terms
            tf = Counter(ts)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in terms if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out |= {(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:k], start=1)}
    return out


def searched(spark, docs, items, **settings):
    docs = with_clashes(spark.createDataFrame(docs, "doc_id bigint, text string"), "m", "n", "chunk", "score", "terms")
    items = with_clashes(spark.createDataFrame(items, "item_id bigint, text string"), "term", "item", "rank")
    index = lexical_search.build(docs, **{k: v for k, v in settings.items() if k.endswith("bytes")})
    got = lexical_search.search(index, items, **{k: v for k, v in settings.items() if not k.endswith("bytes")}).collect()
    assert len(got) == len({(r.item_id, r["rank"]) for r in got})
    return {(r.item_id, r["rank"], r.doc_id, r.score) for r in got}


def corpus(rng, count):
    docs = [(i, prose(rng, int(rng.integers(1, 60)), 300) + " common") for i in range(count)]
    docs += [(500 + i, "same words in all of these") for i in range(70)] + [(600, None), (601, ""), (602, "?! --"), (None, "w1 w2 common"), (603, "W5 w5 É é \x85ab"), (603, "w5 repeated id"), (604, "w9 " * 20_000)]
    items = [(i, prose(rng, 12, 300)) for i in range(12)] + [(20, "same words"), (21, None), (22, "never_ seenzz"), (23, "common"), (24, "w1 w2"), (24, "w3"), (None, "é w7"), (25, "w9 w9 w5")]
    return docs, items


def test_search_equals_scoring_everything(spark):
    docs, items = corpus(np.random.default_rng(8), 250)
    want = ranked_plain(docs, items)
    assert searched(spark, docs, items) == want
    assert searched(spark, docs, items, chunk_bytes=2000, shard_bytes=3000, block_terms=20, first_visits=2) == want
    assert searched(spark, docs, items, k=3, chunk_bytes=500) == ranked_plain(docs, items, 3)


def test_search_of_nothing(spark):
    assert searched(spark, [(1, None), (2, "")], [(1, "a")]) == set()
    assert searched(spark, [], [(1, "a")]) == set()
    assert searched(spark, [(1, "a b"), (2, "c")], []) == set()
    # With one document a term's weight is floor(1000 ln(4 / 3)).
    assert searched(spark, [(7, "a")], [(1, "A?")]) == ranked_plain([(7, "a")], [(1, "A?")]) == {(1, 1, 7, 287 * (10**9 // 3000))}


def test_bounds_leave_out_chunks_that_cannot_reach_the_result(spark):
    rng = np.random.default_rng(12)
    docs = [(i, " ".join(["hit word pair"] * (40 if i < 60 else i % 3 == 0)) + " " + prose(rng, 60 if i < 60 else 200 + i % 40, 500)) for i in range(600)]
    index = lexical_search.build(spark.createDataFrame(docs, "doc_id bigint, text string"), chunk_bytes=20_000)
    queries = lexical_search._weighed(index, lexical_search.Queries([(1, "hit"), (1, "word"), (1, "pair")]))
    floors = lexical_search._floors(index, queries, 50, 4)
    records = index.chunks.toArrow().combine_chunks().to_batches()
    best, scored, pairs = lexical_search.visited(records, queries, floors, 50)
    assert len(best.prune()[0]) == 50 and scored <= pairs // 4
    every = lexical_search.visited(records, queries, np.ones(1, np.int64), 50)[0]
    assert all((a == b).all() for a, b in zip(best.prune(), every.prune()))
