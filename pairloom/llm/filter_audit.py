"""What text filters do to each other, by counting paths through the lattice of filter subsets.

A document's failures are one bit per filter. A state of the lattice is the set of filters applied so far, an edge applies one more. Forward
counts say in how many ways a state is reached, backward counts in how many ways the rest can follow; their product is the number of orders
that cross an edge. An edge removes the documents that fail its filter and none of the state's, whatever the order of those: so the
steps of all n! orders are read from the n * 2^(n-1) edges, and a filter's removals over all orders are its edges' removals times their weights.

Texts are read once, where they lie. What moves is one narrow row per document (id, digest of the text, failures) and, from there on, counts. Equal texts
are told by their SHA-256; a text held by any share of the rows is counted before it moves.

Defined cases: a null text is the empty text, a null part the empty string. A null id is larger than all others and carries no label. Rows that
repeat an id are documents of their own; equal texts under one id fail the copy filter only if a smaller id has the text too. Repeated labels
of an id count if any of them says so. A table without rows gives no row.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

# n filters have n! orders: 5040 for 7.
MOST_FILTERS = 7
COPY = "E"
SPREAD = 1024
_LAST_ID = int(common.NO_ID)


def text_filters(text: Column) -> dict[str, Column]:
    """What makes a text fail, by filter name; the copy filter looks at the whole table and has no expression."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    capitals = F.regexp_count(text, F.lit("[A-Z]"))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("bigint") < 80 * F.size(words).cast("bigint"),
        "C": 100 * capitals.cast("bigint") > 10 * F.char_length(text).cast("bigint"),
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame, filters: dict[str, Column], part: str = "lang", text: str = "text") -> DataFrame:
    """(doc_id, part, digest, mask, n): the rows of ``docs`` that agree in all of these; bit i is the i-th filter."""
    mask = F.lit(0)
    for i, fails in enumerate(filters.values()):
        mask = mask + F.when(fails, 1 << i).otherwise(0)
    return (
        docs.select(
            F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST_ID)).alias("doc_id"),
            F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
            F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
            mask.alias("mask"),
        )
        .groupBy("doc_id", "part", "digest", "mask")
        .agg(F.count("*").alias("n"))
    )


def labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """With ``good`` and ``toxic``, whether any label of the id says so."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(says("quality")("good"), says("toxic")("toxic"))
    # Rows without an id meet no label; they are spread over keys of their own.
    spread = F.when(F.col("doc_id") == _LAST_ID, 1 + F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(0)
    joined = failed.withColumn("salt", spread).join(marks.withColumn("salt", F.lit(0).cast("bigint")), ["doc_id", "salt"], "left")
    return joined.drop("salt").fillna(False, ["good", "toxic"])


def counted(failed: DataFrame, copy_bit: int) -> DataFrame:
    """(part, mask, n, good, toxic): documents by failures, copies of a smaller id's text included as ``copy_bit``.

    Rows of one text, part and label are one row before they move: how many, and how many of them have the smallest id.
    """
    kinds = ["digest", "part", "mask", "good", "toxic"]
    alike = failed.groupBy(*kinds).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("low"))
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    both = alike.withColumn("first", first).withColumn("own", F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0))
    split = both.select("part", "good", "toxic", F.inline(F.array(
        F.struct("mask", F.col("own").alias("n")), F.struct((F.col("mask") + copy_bit).alias("mask"), (F.col("n") - F.col("own")).alias("n"))
    )))
    when = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), when("good"), when("toxic"))


def edges(count: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders that cross) of every edge of the lattice of ``count`` filters."""
    states = range(1 << count)
    forward, backward = [0] * len(states), [0] * len(states)
    forward[0] = backward[-1] = 1
    steps = [(s, f) for s in states for f in range(count) if not s >> f & 1]
    for s, f in steps:
        forward[s | 1 << f] += forward[s]
    for s, f in reversed(steps):
        backward[s] += backward[s | 1 << f]
    return [(s, f, forward[s] * backward[s | 1 << f]) for s, f in steps]


def edge_counts(counts: DataFrame, count: int) -> DataFrame:
    """(part, state, filter, crossing, kept, removed, redundant, unique_fails, good_lost, toxic_lost): what each edge does in each part."""
    lattice = F.array(*[
        F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit"), F.lit(w).cast("bigint").alias("crossing")) for s, f, w in edges(count)
    ])
    fails, passed = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("state")) == 0
    total = lambda c, on, name: F.sum(F.when(on, F.col(c)).otherwise(0)).cast("bigint").alias(name)
    return counts.select("*", F.inline(lattice)).groupBy("part", "state", "filter", "crossing").agg(
        total("n", passed & ~fails, "kept"),
        total("n", passed & fails, "removed"),
        total("n", ~passed & fails, "redundant"),
        total("n", F.col("mask") == F.col("bit"), "unique_fails"),
        total("good", passed & fails, "good_lost"),
        total("toxic", passed & fails, "toxic_lost"),
    )


def orders(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """(filter_order, step, state, filter): the edges that each order of the filters takes. At most n! * n rows."""
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, start=1):
            rows.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, state int, filter int")


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, part: str = "lang") -> DataFrame:
    """One row per part, order of the filters and step, with counts of documents and the filter's removals over all orders.

    The filters are those of ``text_filters`` or the caller's own, and after them the copy filter. Names are single characters.
    """
    filters = text_filters(F.col("text")) if filters is None else filters
    names = [*filters, COPY]
    if len(names) > MOST_FILTERS:
        raise ValueError(f"{len(names)} filters have too many orders; at most {MOST_FILTERS} are audited")
    if len(set(names)) < len(names) or any(len(n) != 1 for n in names):
        raise ValueError(f"filter names must be different single characters, and {COPY!r} is the copy filter")
    counts = counted(labelled(failures(docs, filters, part), labels), 1 << len(filters))
    # Of parts x states rows; read twice.
    done = common.written(edge_counts(counts, len(names)), "edges")
    shapley = done.groupBy("part", "filter").agg(F.sum(F.col("crossing") * F.col("removed")).alias("shapley"))
    steps = F.broadcast(orders(docs.sparkSession, names))
    return done.join(shapley, ["part", "filter"]).join(steps, ["state", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
