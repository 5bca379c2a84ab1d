from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import decontaminate, licenses, pieces, pseudonyms, toxicity
from tests.llm.helpers import SCHEMA, frame, prose, with_clashes


def edit_plain(item: str, text: str) -> int:
    """Least edit distance of ``item`` to any substring of ``text``."""
    row = [0] * (len(text) + 1)
    for c in item:
        new = [row[0] + 1]
        for j, d in enumerate(text, start=1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=80), st.text(alphabet="abc", max_size=90))
def test_bit_parallel_distance_equals_plain(item, text):
    assert decontaminate.nearest(decontaminate.make_item(0, item, 0), text)[0] == edit_plain(item, text)


def test_leaks_equal_all_comparisons(spark):
    rng = np.random.default_rng(4)
    items = [prose(rng, 20) for _ in range(6)] + ["abc", "", None]
    rows = []
    for i in range(60):
        text = list(items[rng.integers(6)])
        for _ in range(rng.integers(0, 16)):
            text[rng.integers(len(text))] = "zyx "[rng.integers(4)]
        rows.append((i, prose(rng, 10) + "\n " + "".join(text).upper() + " " + prose(rng, 10)))
    rows += [(90, None), (91, ""), (92, "AbC"), (92, "AbC")]
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id bigint, text string")
    want = sorted(
        (i, k, edit_plain(decontaminate.normal(x), decontaminate.normal(t)))
        for i, t in rows for k, x in enumerate(items)
        if x and edit_plain(decontaminate.normal(x), decontaminate.normal(t)) <= int(0.08 * len(decontaminate.normal(x)))
    )
    docs = with_clashes(frame(spark, rows), "item_id", "distance")
    for block in (1 << 20, 200):
        got = decontaminate.leaks(docs, bench, block_chars=block)
        assert sorted((r.doc_id, r.item_id, r.distance) for r in got.collect()) == want
        kept = decontaminate.drop_leaks(docs, bench, block_chars=block)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in {w[0] for w in want})
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


def test_each_block_is_searched_with_its_own_items():
    class Block:
        """Made anew at each reading, as by a worker that has dropped it."""

        def __init__(self, k):
            self.k = k

        @property
        def value(self):
            return [(self.k, f"item {self.k}")]

    assert [decontaminate._finder(Block(k), 0.08).items[0].item_id for k in range(200)] == list(range(200))
    rows = Block(1).value
    shared = type("Shared", (), {"value": rows})
    assert decontaminate._finder(shared, 0.08) is decontaminate._finder(shared, 0.08)


@pytest.fixture(scope="module")
def machine():
    return pieces.load()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t.,-=#aeinorstThé▁0123")), st.characters(codec="utf-8")), max_size=60))
def test_shortest_path_equals_the_library(machine, library, text):
    ids = machine.encode(text)
    assert ids == library.encode(text)
    assert "▁" in text or machine.decode(ids) == text


def test_score_models_take_the_cheapest_path():
    model = pieces.Machine({"▁": 0, "a": 1, "b": 2, "ab": 3, "▁a": 4}, [-1.0, -2.0, -2.0, -2.5, -4.0], [b"\xe2\x96\x81", b"a", b"b", b"ab", b"\xe2\x96\x81a"] + [bytes([i]) for i in range(256)], list(range(5, 261)), False, True).compile()
    assert model.encode("ab") == [0, 3] and model.decode(model.encode("abé b")) == "abé b"


def test_encoded_documents(spark, library):
    texts = ["Hello  world\n", None, "", "x" * 30_000 + " 漢字", "Hello  world\n"]
    got = sorted(pieces.encode_documents(with_clashes(frame(spark, texts), "ids", "decoded")).collect())
    assert [r.ids for r in got] == [library.encode(t or "") for t in texts] and [r.decoded for r in got] == [t or "" for t in texts]
    first = pieces.digests(pieces.encode_documents(frame(spark, texts))).where("doc_id = 0").first()
    assert first.ids_sha256 == hashlib.sha256(" ".join(map(str, library.encode(texts[0]))).encode()).hexdigest()
    assert pieces.encode_documents(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(size):
    net = pseudonyms.Feistel(b"k")
    image = [net.permute(v, size, "t") for v in range(size)]
    assert sorted(image) == list(range(size)) and [net.permute(v, size, "t", undo=True) for v in image] == list(range(size))
    assert size < 97 or image != [pseudonyms.Feistel(b"other").permute(v, size, "t") for v in range(size)]


VALUES = "4111 1111 1111 1111|+1 (017) 555-7713|DE89 3704 0044 0532 0130 00|123-45-6789|2024-02-29|31.12.1999|02/28/2001|97.51.17.173|jo.x2@mail.example.com|04dbebab91ab85687d33eeaaf9ac699e1188f962".split("|")


@pytest.mark.parametrize("value", VALUES)
def test_pseudonyms_keep_format_and_validity_and_can_be_undone(value):
    made, back = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", undo=True)
    new, counts = made.replace(f"a {value}, b {value}.")
    assert sum(counts.values()) == 2 and value not in new and back.replace(new)[0] == f"a {value}, b {value}."
    shape = lambda t: "".join("9" if c.isdigit() else c for c in t)
    first = new[2 : new.index(", b ")]
    assert new == f"a {first}, b {first}." and ("@" in value or "." in value or len(value) == 40 or shape(first) == shape(value))
    assert made.replace(first)[1] == counts | {k: 1 for k in counts}


@pytest.mark.parametrize("text", ["4111 1111 1111 1112", "2023-02-29", "999.1.1.1", "DE89 3704 0044 0532 0130 03", "000-12-3456", "v1.2.3.4.5", "plain", "", None])
def test_invalid_values_stay(text):
    assert pseudonyms.Pseudonyms(b"k").replace(text) == (text, {})


@pytest.mark.parametrize("value", ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "BE68 5390 0754 7034"])
@pytest.mark.parametrize("tail", [" 12/26", " 123", "-123", " EUR"])
def test_values_before_more_digits_are_found(value, tail):
    made = pseudonyms.Pseudonyms(b"k")
    if value[0] == "4" and tail[1:].isdigit():
        assert made.card(value + tail) is None
    kind = "card" if value[0] == "4" else "iban"
    new, counts = made.replace(f"a {value}{tail} b")
    assert new == f"a {getattr(made, kind)(value)}{tail} b" and counts == {kind: 1}


def test_pseudonym_rows(spark):
    docs = with_clashes(frame(spark, ["a 97.51.17.173", None, "", "b 97.51.17.173 " + "x" * 100_000]), "found", "text_sha256")
    got = sorted(pseudonyms.report(docs, b"k").collect())
    assert [r.n_ip for r in got] == [1, 0, 0, 1] and got[0].text.split()[1] == got[3].text.split()[1] and got[1].text is None
    assert pseudonyms.report(docs.limit(0), b"k").count() == 0


def test_spellings_of_mail_and_secrets_keep_their_format_and_are_undone():
    made, undo = pseudonyms.Pseudonyms(b"k"), pseudonyms.Pseudonyms(b"k", undo=True)
    a, b = made.replace("Jo.Smith+X1@Example.com")[0], made.replace("jo.smith+x1@Example.com")[0]
    assert a != b and a.lower() == b.lower() and [c.isupper() for c in a] == [c.isupper() for c in "Jo.Smith+X1@Example.com"]
    rng = np.random.default_rng(1)
    texts = ["Jo.Smith+X1@Example.com", "ALL.CAPS@x.org", "9" * 32, "0123456789" * 4, "deadbeef" * 4, "DEADBEEF" * 8, "0" * 31 + "a"]
    texts += ["".join(rng.choice(list("0123456789abcdef"), 32)) for _ in range(50)]
    seen = {}
    for text in texts:
        new = made.replace(text)[0]
        assert undo.replace(new)[0] == text and new != text and seen.setdefault(new, text) == text
        assert new.isdigit() == text.isdigit() and new.isupper() == text.isupper() and len(new) == len(text)


def test_licenses_are_found_by_their_words(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        rows.append((k, f"{prose(rng, 60)}\n{text}\n{prose(rng, 60)}"))
    changed = licenses.TEMPLATES["MIT"].replace("free of charge", "without any fee", 1)
    rows += [(50, prose(rng, 40) + " " + changed), (51, "The license of a driver and its copyright."), (52, None), (53, ""), (54, prose(rng, 5000))]
    got = licenses.scan(with_clashes(frame(spark, rows), "license", "start")).collect()
    best = {r.doc_id: r.license for r in sorted(got, key=lambda r: r.saved_share)}
    assert {k: best.get(k) for k in range(len(licenses.TEMPLATES))} == dict(enumerate(sorted(licenses.TEMPLATES)))
    assert best.get(50) == "MIT" and not {51, 52, 53, 54} & set(best)
    one = next(r for r in got if r.doc_id == 50)
    assert one.words_changed > 0 and dict(rows)[50][one.start : one.stop].startswith("Permission")
    twice = licenses.notices("Released under the MIT License. word word Released under the MIT License.", licenses.compile_templates(licenses.TEMPLATES))
    assert [(n[0], n[4], n[5]) for n in sorted(twice, key=lambda n: n[4])] == [("MIT notice", 0, 30), ("MIT notice", 42, 72)]
    assert licenses.scan(frame(spark, [], SCHEMA)).count() == 0


@pytest.mark.parametrize("name", ["MIT", "Apache-2.0 header", "GPL-3.0 header"])
def test_a_changed_notice_is_found_behind_a_fragment(name):
    compiled = licenses.compile_templates(licenses.TEMPLATES)
    words = next(t.words for t in compiled.templates if t.name == name)
    notice = [f"other{k}" if k % 9 == 4 else w for k, w in enumerate(words)]
    text = " ".join([*words[:20], *["calm"] * 30, *notice, *["calm"] * 30, *words[-20:]])
    found = [n for n in licenses.notices(text, compiled) if n[0] == name]
    assert [(n[3], text[n[4] : n[5]]) for n in found] == [(sum(a != b for a, b in zip(words, notice)), " ".join(notice))]


def planted(template, rng, share):
    """Words of a notice with some of them, never the first or last, replaced."""
    words = list(template.words)
    for k in rng.choice(np.arange(1, len(words) - 1), int(share * len(words)), replace=False) if len(words) > 3 else []:
        words[k] = f"other{k}"
    return words


@pytest.mark.parametrize("around", [0, 20, 300, 1000, 3000, 20_000])
def test_no_notice_is_lost_in_long_texts(around):
    compiled = licenses.compile_templates(licenses.TEMPLATES)
    rng = np.random.default_rng(around)
    for template in compiled.templates:
        notice = planted(template, rng, 0.1)
        # A cue word every 60 words makes one block of the whole text.
        filler = [f"w{rng.integers(400)}" if k % 60 else "license" for k in range(2 * around)]
        text = " ".join([*filler[:around], *notice, *filler[around:]])
        found = [n for n in licenses.notices(text, compiled) if n[0] == template.name]
        assert [text[n[4] : n[5]] for n in found] == [" ".join(notice)], (template.name, around)


def test_notices_are_those_of_every_template_at_every_place():
    """Replaced words only, so a place can be judged by comparing word for word."""
    compiled = licenses.compile_templates({"a": "one two three four five six seven", "b": "alpha beta gamma", "c": " ".join(f"t{k}" for k in range(40))})
    rng = np.random.default_rng(6)
    for round_ in range(30):
        words = [str(rng.choice(["x", "y", "one", "two", "beta", "t3", "t9"])) for _ in range(200)]
        for at in rng.choice(np.arange(0, 150, 50), 2, replace=False):
            template = compiled.templates[rng.integers(3)]
            words[at : at + len(template.words)] = planted(template, rng, 0.1)
        want = {
            (t.name, i) for t in compiled.templates for i in range(len(words) - len(t.words) + 1)
            if sum(x != y for x, y in zip(t.words, words[i:])) <= t.limit
        }
        text = " ".join(words)
        got = {(n[0], len(text[: n[4]].split())) for n in licenses.notices(text, compiled)}
        # A notice may be found a word later or earlier where its own first or last word is among those that differ.
        assert {n for n, _i in got} == {n for n, _i in want} and all(any(n == m and abs(i - j) <= 6 for m, j in got) for n, i in want), round_


def test_ties_are_ranked_by_name_and_other_cases_hold(spark):
    same = {"zeta": "a notice of equal words", "beta": "a notice of equal words"}
    assert [n[0] for n in licenses.notices("x A notice of equal words y", licenses.compile_templates(same))] == ["beta"]
    own = {"own": "All rights reserved by the publisher", "turkish": "\u0130zmir lisans metni burada"}
    rows = [(1, "So: all rights RESERVED by the publisher."), (1, "So: all rights RESERVED by the publisher."), (2, "\u0130zmir lisans metni burada"), (3, "\u0130 all rights reserved by the publisher")]
    got = licenses.scan(frame(spark, rows), own).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(1, "own"), (1, "own"), (2, "turkish"), (3, "own")]
    assert licenses.scan(frame(spark, rows), {}).count() == 0
    with pytest.raises(ValueError):
        licenses.compile_templates({"none": " ?! "})


def test_network_gradient_equals_differences():
    net = toxicity.train(["good day to you all", "bad awful day"] * 4, [0, 1] * 4, 0.5, epochs=1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    for layer in (net.chars, net.words):
        layer.p = net.p
    column, y, w = pa.array(["good awful " * 30, "day a"]), np.array([1.0, 0.0]), np.array([0.5, 0.5])
    grads = toxicity.gradients(net, column, y, w)

    def loss():
        p = toxicity.scores(net, column)
        return -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    for name in ("out", "word.U", "char.U", "char.v", "word.b"):
        at = tuple(0 for _ in net.p[name].shape)
        before = net.p[name][at]
        net.p[name][at] = before + 1e-3
        up = loss()
        net.p[name][at] = before - 1e-3
        down = loss()
        net.p[name][at] = before
        assert abs((up - down) / 2e-3 - grads[name][at]) < 1e-4 + 0.02 * abs(grads[name][at])


def test_windows_cover_every_word():
    for n in (0, 1, 31, 32, 33, 56, 57, 200):
        windows = toxicity.Windows(pa.array(["w " * n]))
        covered = {k for b, s in zip(windows.begin, windows.size) for k in range(b, b + s)}
        assert covered == set(range(n)) and (len(windows.size) > 1) == (n > 32)


def test_toxic_rows_are_learned_and_scored_wherever_they_stand(spark):
    rng = np.random.default_rng(12)
    rows = [(i, prose(rng, 60) + (" vile insult " if i % 4 == 0 else " ") + prose(rng, 10)) for i in range(240)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i, _ in rows], "doc_id bigint, quality int, toxic int")
    more = [(300, None), (301, ""), (302, prose(rng, 3000) + " vile insult"), (302, prose(rng, 3000) + " vile insult"), (None, "calm")]
    docs = with_clashes(frame(spark, rows + more), "score", "held_out")
    net = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.scored(docs, net).collect()}
    assert np.mean([got[i].predicted == int(i % 4 == 0) for i, _ in rows if got[i].held_out]) > 0.9
    assert got[302].predicted == 1 and got[300].score == got[301].score and got[None].held_out is False
    kept = toxicity.drop_toxic(docs, net)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows + more if not got[i].predicted)
    assert toxicity.scored(docs.limit(0), net).count() == 0 and toxicity.fit(docs, labels.limit(0)) is not None
