from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairloom.functions import text as T

WHITESPACE = [0x9, 0xA, 0xB, 0xC, 0xD, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
NOT_WHITESPACE = [0x1C, 0x1D, 0x1E, 0x1F, 0x200B, 0xFEFF]


def one(spark, value, *columns):
    return tuple(spark.createDataFrame([(value,)], "t string").select(*columns).first())


@pytest.mark.parametrize(
    "raw, ascii_clean, markup_clean",
    [
        ("Hello, WORLD! https://example.com/test?x=1", "hello world", "hello world"),
        (" A   b\tc\n\rd ", "a b c d", "a b c d"),
        ("see (https://x.org) <b>Now</b>", "see https x org b now b", "see now"),
        ("HTTP://X y", "y", "y"),
        ("Kttp://a http://b c", "ttp a c", None),
        ("a http://x b", "a b", "a b"),
        ("https://a https://b", "", ""),
        ("", "", ""),
    ],
)
def test_clean(spark, raw, ascii_clean, markup_clean):
    got = one(spark, raw, T.clean_ascii(F.col("t")), T.clean_markup(F.col("t")))
    assert got[0] == ascii_clean
    if markup_clean is not None:
        assert got[1] == markup_clean


def test_words_split_on_unicode_whitespace_only(spark):
    rows = [(c, f"a{chr(c)}b") for c in WHITESPACE + NOT_WHITESPACE]
    got = spark.createDataFrame(rows, "c int, t string").select("c", F.size(T.words(F.col("t"))).alias("n")).collect()
    assert {r["c"]: r["n"] for r in got} == {c: 2 if c in WHITESPACE else 1 for c in WHITESPACE + NOT_WHITESPACE}


@pytest.mark.parametrize("raw, a, b", [("What now?", True, True), ("What now", False, False), ("What now? ", True, False), ("What now? \n", True, False)])
def test_question_mark(spark, raw, a, b):
    assert one(spark, raw, T.asks_question(F.col("t")), T.asks_question(F.col("t"), "markup")) == (a, b)


def test_question_filter_keeps_and_drops(spark):
    clean = T.clean_ascii(F.col("t"))
    keep = T.passes_filters(clean, 3, 2) & T.asks_question(F.col("t"))
    assert one(spark, "What now?", keep) == (True,)
    assert one(spark, "What now", keep) == (False,)


@pytest.mark.parametrize("raw, a, b", [("1", 1, 1), (" 1 ", 1, None), ("1.0", 0, None), ("x", 0, None), (None, 0, None), ("+7", 7, 7), ("3000000000", 3000000000, None)])
def test_labels(spark, raw, a, b):
    assert one(spark, raw, T.parse_label(F.col("t")), T.parse_label(F.col("t"), "markup")) == (a, b)


def test_filters_count_code_points_words_and_disallowed(spark):
    rows = [("deleted",), ("one two three",), ("one two",), ("removed by reddit",)]
    df = spark.createDataFrame(rows, "t string").where(T.passes_filters(F.col("t"), 7, 3, [" Removed by Reddit ", "", "deleted"]))
    assert [r["t"] for r in df.collect()] == ["one two three"]


def test_strip_wrapper_markers_are_optional(spark):
    body = "line one\nline two\n"
    start, end = T.WRAPPER_START + " X ***\n", T.WRAPPER_END + " X ***\nafter"
    for raw, want in [("before\n" + start + body + end, body), (body, body), (start + body, body), (body + end, body), (T.WRAPPER_START + " no line end", T.WRAPPER_START + " no line end")]:
        assert one(spark, raw, T.strip_wrapper(F.col("t"))) == (want,)


def test_query_keeps_every_third_long_word(spark):
    text = "It is a truth, universally acknowledged: that 99 single men d'un want wives"
    kept = [w for w in ["truth", "universally", "acknowledged", "that", "single", "men", "dun", "want", "wives"]][::3]
    assert one(spark, text, T.query_from_passage(F.col("t"))) == (" ".join(kept).upper(),)
    assert one(spark, "a 1 bc", T.query_from_passage(F.col("t"))) == ("empty",)
    many = " ".join(["word"] * 300)
    assert len(one(spark, many, T.query_from_passage(F.col("t")))[0].split()) == 32


def test_bare_words_keep_a_place_for_symbol_tokens(spark):
    assert one(spark, " Don't  -- stop Now! ", T.bare_words(F.col("t"))) == (["dont", "", "stop", "now"],)
    assert one(spark, " \n ", T.bare_words(F.col("t"))) == ([],)


def test_thresholds():
    from pairloom.plans.profiles import Profile, parse_profiles, standard_profiles

    p = Profile("p", "k", filters={"min_chars": 20})
    assert p.thresholds(None, None) == (20, 3)
    assert p.thresholds(0, 5) == (0, 5)
    assert p.thresholds(0, 5, "markup") == (20, 5)
    assert Profile("q", "k").thresholds(None, None) == (12, 3)
    assert sorted(standard_profiles()) == ["kaggle_questions_million", "quora_pairs"]
    parsed = parse_profiles('{"profiles": {"x": {"kind": "single_text_duplicate_mining", "columns": {"text": "title"}}}}')
    assert parsed["x"].name == "x" and parsed["x"].column("text") == "title"
    with pytest.raises(ValueError):
        parsed["x"].column("left")
