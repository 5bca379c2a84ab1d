"""Format-preserving pseudonyms for personal numbers and dates.

What a pattern finds is validated (check digits, calendar, ranges) and then permuted inside its own format by a keyed Feistel
network over exactly the values of that format: a card number becomes another valid card number of the same length, a
date another date written the same way. A permutation gives equal values equal pseudonyms in all documents and
different values different ones, and the holder of the key can undo it. Separators and the text around stay. The spellings of a mail address in capitals and
small letters get one pseudonym, each in its own spelling. Phone numbers are those with a country code; national forms are left alone.

Defined cases: null stays null and counts nothing; text without a valid value stays as it is; of overlapping
finds the leftmost counts; what looks like a value but fails its validation is left alone. Where the longest find fails, its shorter
ends at borders of digit groups are tried from the same start, the longest first, so a card number is found before its expiry or
CVV. A number whose neighbour makes the longer find valid by chance is permuted, and undone, as that longer one; if only the
pseudonym makes it valid, undoing reads it otherwise.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

ROUNDS = 8
CACHE = 100_000
KINDS = ("email", "iban", "phone", "ssn", "date", "ip", "card", "secret")
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){1,4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\d/-])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d]|-\d)",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
}
_FINDER = re.compile("|".join(f"(?P<{k}>{_PATTERNS[k]})" for k in KINDS))
_ALONE = {k: re.compile(_PATTERNS[k]) for k in ("iban", "phone", "card")}
_BORDER = re.compile(r"(?<=\w)[ .-]")
_HINT = re.compile(r"[0-9@]|[a-f]{32}|[A-F]{32}")
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
_DIGITS, _LETTERS = "0123456789", "abcdefghijklmnopqrstuvwxyz"


class Feistel:
    """Keyed permutation of 0..size-1 for any size, by cycle walking in the next even power of two."""

    def __init__(self, key: bytes):
        self.key = key

    def _half(self, tweak: str, turn: int, value: int, bits: int) -> int:
        width = (bits + 7) // 8
        data = b"%s|%d|" % (tweak.encode(), turn) + value.to_bytes(width, "big")
        out, block = b"", 0
        while len(out) < width:
            out += hashlib.blake2b(data + bytes([block]), key=self.key, digest_size=32).digest()
            block += 1
        return int.from_bytes(out[:width], "big") & ((1 << bits) - 1)

    def permute(self, value: int, size: int, tweak: str, undo: bool = False) -> int:
        if size < 2:
            return value
        bits = (max(2, (size - 1).bit_length()) + 1) // 2
        mask = (1 << bits) - 1
        while True:
            left, right = value >> bits, value & mask
            if undo:
                for turn in range(ROUNDS - 1, -1, -1):
                    left, right = right ^ self._half(tweak, turn, left, bits), left
            else:
                for turn in range(ROUNDS):
                    left, right = right, left ^ self._half(tweak, turn, right, bits)
            value = left << bits | right
            if value < size:
                return value


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return str(-total % 10)


def iban_check(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _fill(shape: str, symbols: str, wanted: Callable[[str], bool] = str.isdigit) -> str:
    """``shape`` with its wanted characters replaced in order."""
    rest = iter(symbols)
    return "".join(next(rest) if wanted(c) else c for c in shape)


class Pseudonyms:
    def __init__(self, key: bytes, undo: bool = False):
        self.feistel, self.undo, self.known = Feistel(key), undo, {}

    def _number(self, digits: str, tweak: str) -> str:
        value = self.feistel.permute(int(digits), 10 ** len(digits), f"{tweak}{len(digits)}", self.undo)
        return str(value).zfill(len(digits))

    def _mixed(self, text: str, tweak: str) -> str:
        """Letters to letters of the same case and digits to digits, as one mixed-radix number; the rest stays."""
        radix = [10 if c in _DIGITS else 26 if c.lower() in _LETTERS else 1 for c in text]
        value, size = 0, 1
        for c, n in zip(text, radix):
            if n > 1:
                value, size = value * n + (_DIGITS if n == 10 else _LETTERS).index(c.lower()), size * n
        shape = "".join("9" if n == 10 else "a" if n == 26 else c for c, n in zip(text, radix))
        value = self.feistel.permute(value, size, f"{tweak}{shape}", self.undo)
        out = []
        for c, n in zip(reversed(text), reversed(radix)):
            if n > 1:
                value, digit = divmod(value, n)
                new = (_DIGITS if n == 10 else _LETTERS)[digit]
                c = new.upper() if c.isupper() else new
            out.append(c)
        return "".join(reversed(out))

    # Each gives the pseudonym, or None where the find is not valid.

    def email(self, text: str) -> str | None:
        local, _, domain = text.partition("@")
        return self._mixed(local, "email") + "@" + domain

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return None
        account = self._mixed(plain[4:], f"iban{plain[:2]}")
        return _fill(text, plain[:2] + iban_check(plain[:2], account) + account, str.isalnum)

    def phone(self, text: str) -> str | None:
        digits = _digits(text)
        if not 8 <= len(digits) <= 15:
            return None
        country = len(re.match(r"\+(\d+)", text).group(1))
        country = min(country, 3, len(digits) - 4)
        return _fill(text, digits[:country] + self._number(digits[country:], f"phone{digits[:country]}"))

    def ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        index = area - 1 - (area > 666)
        value = self.feistel.permute((index * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, "ssn", self.undo)
        value, serial = divmod(value, 9999)
        index, group = divmod(value, 99)
        return f"{index + 1 + (index >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def date(self, text: str) -> str | None:
        mark = text[4] if text[4] == "-" else text[2]
        a, b, c = map(int, text.split(mark)) if text.count(mark) == 2 else (0, 0, 0)
        year, month, day = (a, b, c) if mark == "-" else (c, b, a) if mark == "." else (c, a, b)
        try:
            ordinal = datetime.date(year, month, day).toordinal()
        except ValueError:
            return None
        if not _FIRST_DAY <= ordinal <= _LAST_DAY:
            return None
        size = _LAST_DAY - _FIRST_DAY + 1
        new = datetime.date.fromordinal(_FIRST_DAY + self.feistel.permute(ordinal - _FIRST_DAY, size, "date", self.undo))
        if mark == "-":
            return new.isoformat()
        return f"{new.day:02d}.{new.month:02d}.{new.year}" if mark == "." else f"{new.month:02d}/{new.day:02d}/{new.year}"

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        value = self.feistel.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", self.undo)
        return ".".join(map(str, value.to_bytes(4, "big")))

    def card(self, text: str) -> str | None:
        digits = _digits(text)
        if luhn_digit(digits[:-1]) != digits[-1]:
            return None
        body = self._number(digits[:-1], "card")
        return _fill(text, body + luhn_digit(body))

    def secret(self, text: str) -> str | None:
        if text.isdigit():
            return self._number(text, "secret")
        value = int(text, 16)
        while True:
            # Walked on until it has a letter again, as a string of digits alone is another format.
            value = self.feistel.permute(value, 16 ** len(text), f"secret{len(text)}", self.undo)
            new = f"{value:x}".zfill(len(text))
            if not new.isdigit():
                return new.upper() if text.isupper() else new

    def _of(self, kind: str, text: str) -> str | None:
        at = (kind, text)
        if at not in self.known:
            if len(self.known) >= CACHE:
                self.known.clear()
            self.known[at] = getattr(self, kind)(text)
        return self.known[at]

    def _shorter(self, text: str, kind: str, start: int, end: int) -> tuple[str | None, int]:
        """(pseudonym, end) of the longest valid find from ``start`` that ends before a separator of a failed one."""
        if kind in _ALONE:
            for stop in [m.start() for m in _BORDER.finditer(text, start, end)][::-1]:
                if _ALONE[kind].fullmatch(text, start, stop) and (new := self._of(kind, text[start:stop])) is not None:
                    return new, stop
        return None, end

    def replace(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """(text with pseudonyms, valid finds of each kind)."""
        if not text or not _HINT.search(text):
            return text, {}
        counts: dict[str, int] = {}
        parts, at, start = [], 0, 0
        while found := _FINDER.search(text, start):
            new, end = self._of(found.lastgroup, found.group()), found.end()
            if new is None:
                new, end = self._shorter(text, found.lastgroup, found.start(), end)
            if new is None:
                # Another kind may begin one character later.
                start = found.start() + 1
                continue
            counts[found.lastgroup] = counts.get(found.lastgroup, 0) + 1
            parts += [text[at : found.start()], new]
            at = start = end
        return "".join([*parts, text[at:]]), counts


def pseudonymised(docs: DataFrame, key: bytes, undo: bool = False) -> DataFrame:
    """The rows of ``docs`` with ``text`` replaced, and counts of each kind in a struct column ``found``."""
    fields = ", ".join(f"{k}: bigint" for k in KINDS)

    def run(records) -> Iterator[pa.RecordBatch]:
        made = Pseudonyms(key, undo)
        for record in records:
            at = record.schema.get_field_index("text")
            done = [made.replace(t) for t in record.column(at).to_pylist()]
            found = pa.StructArray.from_arrays([pa.array([c.get(k, 0) for _t, c in done], pa.int64()) for k in KINDS], names=list(KINDS))
            columns = [pa.array([t for t, _c in done], pa.string()) if i == at else record.column(i) for i in range(record.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, found], names=[*record.schema.names, "found"])

    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop("found").schema.fields]
    return common.map_arrow(docs.drop("found"), run, ", ".join([*rest, f"found struct<{fields}>"]))


def report(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, a count of each kind, the new text and its hash."""
    done = pseudonymised(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), key)
    return done.select("doc_id", *[F.col(f"found.{k}").alias(f"n_{k}") for k in KINDS], "text", F.sha2("text", 256).alias("text_sha256"))
