"""Cleaning, filtering, windows and query building as column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import bind

# The Unicode White_Space property, spelled out because the regex
# shorthand differs between engines.
WHITE_SET = (
    r"\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
WHITE = f"[{WHITE_SET}]"
NOT_WHITE = f"[^{WHITE_SET}]"
# The same characters except the plain space, as literal text for ``translate``.
ODD_SPACES = (
    "\t\n\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# A URL token counts only at the start of the text or after whitespace. The literal comes
# first so the scan skips to each ``h`` instead of testing the lookbehind at every character.
_URL_TOKEN = f"https?://(?<=(?:^|{WHITE})https?://){NOT_WHITE}*+"

# The two characters whose Unicode lowercase form contains an ASCII letter.
KELVIN_SIGN = "\u212a"
DOTTED_CAPITAL_I = "\u0130"

# Licence wrapper markers of the book corpus format.
WRAPPER_START = "*** START OF THE PROJECT GUTENBERG EBOOK"
WRAPPER_END = "*** END OF THE PROJECT GUTENBERG EBOOK"

DEFAULT_MIN_CHARS = 12
DEFAULT_MIN_WORDS = 3


def ascii_lower(text: Column) -> Column:
    """Lowercase that maps nothing but A-Z onto ASCII letters.

    ``lower`` is a fast byte loop on ASCII input; hiding the two leaking characters
    first is far cheaper than a per-character ``translate``.
    """
    hidden = text
    for leaking in (KELVIN_SIGN, DOTTED_CAPITAL_I):
        hidden = F.replace(hidden, F.lit(leaking), F.lit("~"))
    return F.lower(hidden)


def words(text: Column) -> Column:
    """Tokens between Unicode whitespace, none of them empty."""
    return F.array_remove(F.split(plain_spaced(text), " "), "")


def plain_spaced(text: Column) -> Column:
    """Every whitespace character as a plain space: cheaper than a regex split."""
    return F.translate(text, ODD_SPACES, " " * len(ODD_SPACES))


def clean_ascii(text: Column) -> Column:
    """Variant A: whole URL tokens out, everything but [a-z0-9] to single spaces."""
    no_url = F.regexp_replace(ascii_lower(text), _URL_TOKEN, " ")
    return F.trim(F.regexp_replace(no_url, "[^a-z0-9]++", " "))


def clean_markup(text: Column) -> Column:
    """Variant B: tags out, URLs out anywhere, then [a-z0-9] words with single spaces."""
    no_tags = F.regexp_replace(F.lower(text.cast("string")), "<[^>]+>", " ")
    no_url = F.regexp_replace(no_tags, f"https?://{NOT_WHITE}+", " ")
    return F.trim(F.regexp_replace(no_url, "[^a-z0-9]++", " "))


CLEANERS = {"ascii": clean_ascii, "markup": clean_markup}


def word_count(clean: Column) -> Column:
    """Words of an already single-spaced text."""
    spaces = F.length(clean) - F.length(F.replace(clean, F.lit(" "), F.lit("")))
    return F.when(clean == "", F.lit(0)).otherwise(spaces + 1)


def normalized_disallow(values: Iterable[str]) -> list[str]:
    return sorted({v.strip().lower() for v in values if v.strip()})


def passes_filters(
    clean: Column,
    min_chars: int | Column = DEFAULT_MIN_CHARS,
    min_words: int | Column = DEFAULT_MIN_WORDS,
    disallow: Iterable[str] = (),
) -> Column:
    """Long enough in characters and words and not a disallowed text."""
    min_chars = F.lit(min_chars) if isinstance(min_chars, int) else min_chars
    min_words = F.lit(min_words) if isinstance(min_words, int) else min_words
    ok = (F.length(clean) >= min_chars) & (word_count(clean) >= min_words)
    banned = normalized_disallow(disallow)
    return ok & ~clean.isin(banned) if banned else ok


def asks_question(raw: Column, variant: str = "ascii") -> Column:
    """Raw text ends in ``?``; variant A ignores trailing whitespace, B does not."""
    if variant == "ascii":
        return raw.rlike(rf"\?{WHITE}*+\z")
    return raw.endswith("?")


def parse_label(raw: Column, variant: str = "ascii") -> Column:
    """A: trimmed integer, anything else 0. B: integer or null."""
    if variant == "ascii":
        trimmed = F.regexp_replace(raw, rf"\A{WHITE}+|{WHITE}+\z", "")
        parsed = F.when(trimmed.rlike(r"\A[+-]?[0-9]+\z"), trimmed.try_cast("bigint"))
        return F.coalesce(parsed, F.lit(0).cast("bigint"))
    text = raw.cast("string")
    return F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("int")).cast("bigint")


def canonical_pair(left: Column, right: Column) -> tuple[Column, Column]:
    return F.least(left, right), F.greatest(left, right)


def normalize_newlines(raw: Column) -> Column:
    return F.replace(F.replace(raw, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def strip_wrapper(text: Column) -> Column:
    """Text after the line of the start marker and before the end marker, either optional."""
    start = F.locate(WRAPPER_START, text)
    line_end = F.when(start > 0, F.call_function("locate", F.lit("\n"), text, start)).otherwise(F.lit(0))
    end = F.locate(WRAPPER_END, text)
    stop = F.when(end > 0, end).otherwise(F.length(text) + 1)
    return F.substring(text, line_end + 1, F.greatest(stop - line_end - 1, F.lit(0)))


def window_starts(n_words: Column, window: int, stride: int, max_windows: int | None = None) -> Column:
    """Zero-based first words of all full windows; an empty array for short texts."""
    count = F.floor((n_words - window) / stride) + 1
    if max_windows is not None:
        count = F.least(count, F.lit(max_windows))
    count = count.cast("int")
    return F.when((n_words >= window) & (count > 0), F.sequence(F.lit(0), (count - 1) * stride, F.lit(stride))).otherwise(
        F.array().cast("array<int>")
    )


def query_from_passage(passage: Column, step: int = 3, limit: int = 32, spaced: bool = False) -> Column:
    """Every third letters-only word of three or more letters, at most 32, in capitals.

    Non-letters go in one pass over the passage, not word by word. ``spaced`` says that plain spaces
    are the only whitespace.
    """
    # One folded range: the same class as two ranges and a space is matched eight times slower.
    letters = F.regexp_replace(passage if spaced else plain_spaced(passage), "(?i)[^a-z ]++", "")
    long_enough = F.filter(F.split(letters, " "), lambda w: F.length(w) >= 3)
    stepped = F.filter(long_enough, lambda _w, i: i % step == 0)
    picked = F.upper(F.array_join(F.slice(stepped, 1, limit), " "))
    return bind(picked, lambda q: F.when(q == "", F.lit("empty")).otherwise(q))


def bare_words(text: Column) -> Column:
    """The ASCII letters and digits of each token, lowercase; a token without any is empty.

    Spaces are squeezed first, so that after the other characters are gone from the whole text at
    once, an empty piece can only be a token that had nothing to keep.
    """
    single = F.trim(F.regexp_replace(plain_spaced(text), " {2,}", " "))
    kept = F.split(F.lower(F.regexp_replace(single, "[^A-Za-z0-9 ]++", "")), " ")
    return F.when(single == "", F.array().cast("array<string>")).otherwise(kept)
