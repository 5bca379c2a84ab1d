"""Mining positive pairs and negative pools from raw text rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .layout import computed_once

# Copies of one text are emitted in slices of this size, so one hot text cannot fill one task.
COPY_SLICE = 100_000


def clean_pairs(df: DataFrame, left: str, right: str, label: str, variant: str = "ascii") -> DataFrame:
    """Cleaned (left, right, label) rows where both sides are non-empty."""
    clean = T.CLEANERS[variant]
    cleaned = computed_once(
        df.select(left, right, label),
        l_text=clean(F.col(left)),
        r_text=clean(F.col(right)),
        l_label=T.parse_label(F.col(label), variant),
    )
    return cleaned.where((F.col("l_text") != "") & (F.col("r_text") != "")).select("l_text", "r_text", "l_label")


def pairs_accepted(min_chars: int, min_words: int, disallow: Iterable[str] = ()) -> Column:
    """Both sides pass the text filters."""
    left, right = [T.passes_filters(F.col(c), min_chars, min_words, disallow) for c in ("l_text", "r_text")]
    return left & right


def filter_pairs(cleaned: DataFrame, min_chars: int, min_words: int, disallow: Iterable[str] = ()) -> DataFrame:
    return cleaned.where(pairs_accepted(min_chars, min_words, disallow))


def labeled_positives(accepted: DataFrame, positive_label: int = 1, variant: str = "ascii") -> DataFrame:
    """Distinct canonical pairs of rows with the positive label; variant B keeps self pairs."""
    anchor, positive = T.canonical_pair(F.col("l_text"), F.col("r_text"))
    pairs = accepted.where(F.col("l_label") == positive_label)
    if variant == "ascii":
        pairs = pairs.where(F.col("l_text") != F.col("r_text"))
    return pairs.select(anchor.alias("anchor"), positive.alias("positive")).distinct()


def labeled_negatives(accepted: DataFrame, positive_label: int = 1) -> DataFrame:
    """Distinct right texts of rows with another label and two different sides."""
    other = (F.col("l_label") != positive_label) & (F.col("l_text") != F.col("r_text"))
    return accepted.where(other).select(F.col("r_text").alias("negative")).distinct()


def clean_texts(df: DataFrame, text: str, variant: str = "ascii") -> DataFrame:
    """(raw, clean) rows whose cleaned text is not empty."""
    raw = F.coalesce(F.col(text), F.lit("")) if variant == "ascii" else F.col(text).cast("string")
    cleaned = computed_once(df.select(raw.alias("raw")), clean=T.CLEANERS[variant](F.col("raw")))
    return cleaned.where(F.col("clean") != "")


def texts_accepted(
    min_chars: int, min_words: int, disallow: Iterable[str] = (), question_mark: bool = False, variant: str = "ascii"
) -> Column:
    """The cleaned text passes the filters and, if asked for, the raw text is a question."""
    ok = T.passes_filters(F.col("clean"), min_chars, min_words, disallow)
    return ok & T.asks_question(F.col("raw"), variant) if question_mark else ok


def filter_texts(cleaned: DataFrame, *settings, **named) -> DataFrame:
    return cleaned.where(texts_accepted(*settings, **named))


def text_counts(accepted: DataFrame) -> DataFrame:
    """(clean, n): counting combines on the map side, so a text that fills a third of the rows
    reaches its reducer as one row per task."""
    return accepted.groupBy("clean").agg(F.count("*").alias("n"))


def repeat_pairs(counts: DataFrame) -> DataFrame:
    """(t, t) once for every repeat of a text beyond the first, numbered by ``copy``.

    The many copies of a hot text are emitted from slices spread over the cluster.
    """
    counts = counts.where(F.col("n") > 1)
    few = counts.where(F.col("n") <= COPY_SLICE).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n") - 1)))
    slices = counts.where(F.col("n") > COPY_SLICE).withColumn(
        "_slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 2) / COPY_SLICE)))
    )
    first = F.col("_slice") * COPY_SLICE + 1
    many = (
        slices.repartition("clean", "_slice")
        .withColumn("copy", F.explode(F.sequence(first, F.least(first + COPY_SLICE - 1, F.col("n") - 1))))
        .drop("_slice")
    )
    both = few.unionByName(many)
    return both.select(F.col("clean").alias("anchor"), F.col("clean").alias("positive"), "copy")


def repeat_pairs_distinct(counts: DataFrame) -> DataFrame:
    """One (t, t) per repeated text: what pairing each row with its next equal one and removing
    repeats leaves, without sorting any group."""
    return counts.where(F.col("n") > 1).select(F.col("clean").alias("anchor"), F.col("clean").alias("positive"))


def duplicate_pairs(accepted: DataFrame) -> DataFrame:
    return repeat_pairs(text_counts(accepted))


def duplicate_pairs_distinct(accepted: DataFrame) -> DataFrame:
    return repeat_pairs_distinct(text_counts(accepted))


def labeled_groups(cleaned: DataFrame, accept: Column, positive_label: int, variant: str) -> DataFrame:
    """(kind, anchor, positive, n) of all cleaned rows in one pass and one shuffle.

    Kind ``pair`` holds the distinct canonical pairs, ``pool`` the distinct right texts of the other
    rows as ``positive``, ``rest`` counts what neither takes.
    """
    left, right, label = F.col("l_text"), F.col("r_text"), F.col("l_label")
    differs = left != right
    is_pair = accept & (label == positive_label) & (differs if variant == "ascii" else F.lit(True))
    is_pool = accept & (label != positive_label) & differs
    kind = F.when(is_pair, "pair").when(is_pool, "pool").otherwise("rest")
    low, high = T.canonical_pair(left, right)
    anchor = F.when(F.col("kind") == "pair", low)
    positive = F.when(F.col("kind") == "pair", high).when(F.col("kind") == "pool", right)
    keyed = cleaned.withColumn("kind", kind).select("kind", anchor.alias("anchor"), positive.alias("positive"))
    return keyed.groupBy("kind", "anchor", "positive").agg(F.count("*").alias("n"))


def text_groups(cleaned: DataFrame, accept: Column) -> DataFrame:
    """(kind, clean, n): accepted texts with their counts, and the count of the rest."""
    ok = F.coalesce(accept, F.lit(False))
    keyed = cleaned.select(F.when(ok, "text").otherwise("rest").alias("kind"), F.when(ok, F.col("clean")).alias("clean"))
    return keyed.groupBy("kind", "clean").agg(F.count("*").alias("n"))


def text_pool(accepted: DataFrame) -> DataFrame:
    return accepted.select(F.col("clean").alias("negative")).distinct()


def pool_of_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct texts of both sides; fewer than two is an error for the trainer."""
    return pairs.select(F.explode(F.array("anchor", "positive")).alias("negative")).distinct()
