"""Dataset profiles: which columns to read, how to filter and what to mine."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import DEFAULT_MIN_CHARS, DEFAULT_MIN_WORDS

LABELED = "pair_binary_label"
DUPLICATES = "single_text_duplicate_mining"

# The two standard profiles.
STANDARD_PROFILES = {
    "quora_pairs": {
        "kind": LABELED,
        "csv_name": "train.csv",
        "columns": {"left": "question1", "right": "question2", "label": "is_duplicate"},
        "filters": {"min_chars": 12, "min_words": 3, "disallow_values": ["removed by reddit", "removed", "deleted"]},
        "options": {"positive_label": 1},
    },
    "kaggle_questions_million": {
        "kind": DUPLICATES,
        "csv_name": "one-million-reddit-questions.csv",
        "columns": {"text": "title"},
        "filters": {
            "min_chars": 20,
            "min_words": 4,
            "require_question_mark": True,
            "disallow_values": ["removed by reddit", "removed", "deleted"],
        },
        "options": {},
    },
}


@dataclass(frozen=True)
class Profile:
    name: str
    kind: str
    csv_name: str | None = None
    columns: dict[str, str] = field(default_factory=dict)
    filters: dict = field(default_factory=dict)
    options: dict = field(default_factory=dict)

    def column(self, role: str) -> str:
        if not self.columns.get(role):
            raise ValueError(f"profile {self.name} names no column for {role}")
        return self.columns[role]

    @property
    def positive_label(self) -> int:
        return int(self.options.get("positive_label", 1))

    @property
    def disallow(self) -> list[str]:
        return list(self.filters.get("disallow_values", []))

    @property
    def question_mark(self) -> bool:
        return bool(self.filters.get("require_question_mark", False))

    def thresholds(self, min_chars: int | None, min_words: int | None, variant: str = "ascii") -> tuple[int, int]:
        """Override, else profile, else default. Variant B treats an override of 0 as none."""
        if variant != "ascii":
            min_chars, min_words = min_chars or None, min_words or None
        pick = lambda given, key, default: given if given is not None else self.filters.get(key, default)
        return pick(min_chars, "min_chars", DEFAULT_MIN_CHARS), pick(min_words, "min_words", DEFAULT_MIN_WORDS)


def parse_profiles(text: str) -> dict[str, Profile]:
    """Profiles of a JSON document ``{"profiles": {name: {...}}}``; other fields are left out."""
    known = {f.name for f in fields(Profile)}
    found = json.loads(text)["profiles"]
    return {name: Profile(**{"name": name, **{k: v for k, v in body.items() if k in known}}) for name, body in sorted(found.items())}


def standard_profiles() -> dict[str, Profile]:
    return {name: Profile(name=name, **body) for name, body in STANDARD_PROFILES.items()}


def effective_threshold(override: Column, profile: Column, default: int, variant: str = "ascii") -> Column:
    """The same rule over columns."""
    given = override if variant == "ascii" else F.nullif(override, F.lit(0))
    return F.coalesce(given, profile, F.lit(default))
