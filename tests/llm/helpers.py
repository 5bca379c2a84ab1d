"""Small frames with every awkward row, and plain versions of the rules."""

from __future__ import annotations

import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, texts, schema: str = SCHEMA):
    """Documents 0.. with the given texts; (id, text) pairs set their own id."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)


def with_clashes(docs, *names):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F

    for name in names:
        docs = docs.withColumn(name, F.lit("x"))
    return docs


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, words: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.integers(vocabulary)}" for _ in range(words))
