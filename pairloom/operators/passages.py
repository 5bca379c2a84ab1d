"""Word-window passages, their numbering, and text batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import window_starts, words
from ..session import materialize
from .layout import computed_once
from .ordering import prefix_offsets

WINDOW = 80
STRIDE = 40


def _with_starts(df, text, window, stride, max_windows):
    tokens = computed_once(df, _tokens=words(F.col(text)))
    return tokens.withColumn("_starts", window_starts(F.size("_tokens"), window, stride, max_windows))


def sliding_passages(
    df: DataFrame, text: str, window: int = WINDOW, stride: int = STRIDE, max_windows: int | None = None
) -> DataFrame:
    """Full word windows of each text with their number; texts shorter than a window give none."""
    others = [c for c in df.columns if c != text]
    return (
        _with_starts(df, text, window, stride, max_windows)
        .select(*others, "_tokens", F.posexplode("_starts").alias("window", "_start"))
        .select(
            *others,
            F.col("window").cast("bigint").alias("window"),
            F.array_join(F.slice("_tokens", F.col("_start") + 1, window), " ").alias("passage"),
        )
    )


def count_windows(
    df: DataFrame, key: str, text: str, window: int = WINDOW, stride: int = STRIDE, max_windows: int | None = None
) -> DataFrame:
    """Number of full windows per text: a small table that numbering works on."""
    sized = _with_starts(df, text, window, stride, max_windows)
    return sized.select(key, F.size("_starts").cast("bigint").alias("n_windows"))


def leading_passages(
    df: DataFrame, key: str, text: str, needed: int, window: int = WINDOW, stride: int = STRIDE, max_windows: int | None = None
) -> tuple[DataFrame, int]:
    """The first ``needed`` passages in (key, window) order, numbered from 0, or all there are, and how many that is.

    The keys alone say which texts come first; only texts up to a bound are read, which the key's statistics cut down to their files, and the
    bound moves on in growing steps while their passages are too few. What is returned is at most ``needed`` rows, held by the driver.
    """
    keyed = df.select(key, text).where(F.col(key).isNotNull())
    order = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    texts = max(needed, 1)
    while True:
        first = keyed.select(key).orderBy(key).limit(texts).agg(F.max(key).alias("last"), F.count("*").alias("n")).first()
        head = keyed.where(F.col(key) <= F.lit(first["last"])) if first["n"] else keyed.limit(0)
        # Texts that are too short give no row; the running sum is over bounded many.
        sized = _with_starts(head, text, window, stride, max_windows).select(key, "_tokens", "_starts", F.size("_starts").cast("bigint").alias("_n")).where("_n > 0")
        placed = sized.withColumn("_first", F.coalesce(F.sum("_n").over(order), F.lit(0))).where(F.col("_first") < needed)
        rows = placed.select(key, "_tokens", "_first", F.posexplode("_starts").alias("_w", "_start"))
        numbered = rows.select(
            (F.col("_first") + F.col("_w")).alias("passage_id"), key, F.col("_w").cast("bigint").alias("window"),
            F.array_join(F.slice("_tokens", F.col("_start") + 1, window), " ").alias("passage"),
        ).where(F.col("passage_id") < needed)
        found = numbered.toArrow()
        if found.num_rows >= needed or first["n"] < texts:
            return df.sparkSession.createDataFrame(found, numbered.schema), found.num_rows
        texts *= 4


def number_windows(
    df: DataFrame, key: str, text: str, window: int = WINDOW, stride: int = STRIDE, max_windows: int | None = None
) -> tuple[DataFrame, int]:
    """(passage_id, key, window) of every passage, without the texts, and how many there are."""
    sizes = materialize(count_windows(df, key, text, window, stride, max_windows).where(F.col("n_windows") > 0))
    offsets = prefix_offsets(sizes, key, "n_windows", "first_id")
    ids = offsets.select(key, "first_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_windows") - 1)).alias("window"))
    return ids.select((F.col("first_id") + F.col("window")).alias("passage_id"), key, "window"), sizes.agg(F.sum("n_windows")).first()[0] or 0


def number_passages(
    df: DataFrame, key: str, text: str, window: int = WINDOW, stride: int = STRIDE, max_windows: int | None = None
) -> DataFrame:
    """Passages with ``passage_id`` counted from 0 in (key, window) order.

    Only one row per text (its window count) goes through the numbering; the passages follow by
    adding their window number.
    """
    sizes = materialize(count_windows(df, key, text, window, stride, max_windows).where(F.col("n_windows") > 0))
    offsets = prefix_offsets(sizes, key, "n_windows", "first_id")
    texts = df.select(key, text).join(offsets.select(key, "first_id"), key)
    passages = sliding_passages(texts, text, window, stride, max_windows)
    return passages.select((F.col("first_id") + F.col("window")).alias("passage_id"), key, "window", "passage")


def corpus_stats(df: DataFrame, passage: str = "passage") -> DataFrame:
    """Passage count, mean bytes and mean words."""
    return df.agg(
        F.count("*").alias("passage_count"),
        F.avg(F.octet_length(passage)).alias("mean_bytes"),
        F.avg(F.size(words(F.col(passage)))).alias("mean_words"),
    )


def cycle_texts(numbered: DataFrame, idx: str, size: int, total: int) -> DataFrame:
    """Exactly ``total`` rows, row i a copy of the text at i mod ``size``.

    Each text emits its own copies, so no range is joined; the positions come out as
    idx, idx + size, idx + 2 size and so on.
    """
    return numbered.where(F.col(idx) < total).withColumn(
        "position", F.explode(F.sequence(F.col(idx), F.lit(total - 1), F.lit(size)))
    )


def chunk_rows(df: DataFrame, key: str, size: int) -> DataFrame:
    """Batch number of each row in ``key`` order; the last batch may be short."""
    placed = prefix_offsets(df, key, name="position")
    return placed.withColumn("batch", F.floor(F.col("position") / size).cast("bigint"))
