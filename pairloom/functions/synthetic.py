"""Synthetic texts of a given length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashing import hash60


def word_pool(words: DataFrame, column: str, size: int) -> Column:
    """Array of ``size`` distinct words of a corpus, those with the smallest hashes, as a scalar."""
    picked = words.select(column).distinct().orderBy(hash60(F.col(column)), column).limit(size)
    entries = F.array_sort(F.collect_list(F.struct(hash60(F.col(column)).alias("h"), F.col(column).alias("w"))))
    return picked.agg(entries.alias("e")).select(F.transform("e", lambda e: e["w"])).scalar()


def synthetic_text(row_key: Column, seq_len: Column, seed: int, pool: Column) -> Column:
    """Exactly ``seq_len`` words of the array ``pool`` drawn by keyed hash; the seed shifts by 101 per length."""
    seed_key = (F.lit(seed) + seq_len * 101).cast("string")
    draw = lambda i: hash60(F.concat_ws("|", seed_key, F.lit("synth"), row_key.cast("string"), i.cast("string")))
    words = F.transform(F.sequence(F.lit(1), seq_len), lambda i: F.get(pool, (draw(i) % F.size(pool)).cast("int")))
    return F.when(seq_len > 0, F.array_join(words, " ")).otherwise(F.lit(""))
