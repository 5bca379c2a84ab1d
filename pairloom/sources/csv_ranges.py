"""CSV records of large files, read in parallel although quoted fields may hold line ends.

Spark splits a text file at line ends only. Whether a line end closes a record depends on all quotes before it, so a range of a file cannot be
read alone. But at a line end only one thing is unknown, whether a quoted field is open. A first pass therefore runs every range from both answers and keeps, for each,
the answer at the range's end. These are functions of two values; composing them in file order (one small row per range) tells
each range how it really begins. What stands in front of the first record border of a range is its head and belongs to a record that began in an earlier one; the
first pass keeps it, and a head that is too long to keep on suspicion is read again once it is known to be one. The second pass cuts the records of every range,
skips its head and completes its last record with the heads behind it.

Quotes count only where the field rules give them a meaning: a field is quoted if it begins with a quote, and ends at the next quote that is not
doubled; whatever follows up to the separator, and quotes inside unquoted fields, are plain characters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.layout import BROADCAST_LIMIT_BYTES
from ..session import ship_package, written

_SUMMARY = "file string, start bigint, lines bigint, closed_to boolean, open_to boolean, through boolean, head binary"
_RECORD = "file string, start bigint, seq bigint, record binary"
# Bytes of records handed back at a time; of a range's head kept by the first pass; of a row that describes a range, besides texts.
_BATCH_BYTES = 4 << 20
HEAD_BYTES = 64 << 10
_RANGE_ROW_BYTES = 200
# Tasks a core that list folders.
_LISTING_TASKS = 4


def ends_open(line: bytes, opened: bool, separator: bytes = b",") -> bool:
    """Is a quoted field open at the end of the line, given that one was (not) at its start?"""
    at = 0
    while True:
        if not opened:
            if line[at : at + 1] != b'"':
                # The next quoted field begins right behind a separator.
                at = line.find(separator + b'"', at)
                if at < 0:
                    return False
                at += 1
            at += 1
        quote = line.find(b'"', at)
        while quote >= 0 and line[quote + 1 : quote + 2] == b'"':
            quote = line.find(b'"', quote + 2)
        if quote < 0:
            return True
        opened = False
        at = line.find(separator, quote + 1) + 1
        if at == 0:
            return False


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """While files are listed: of many small folders a task lists many, instead of one task a folder up to 10,000."""
    listing, tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism", _LISTING_TASKS * spark.sparkContext.defaultParallelism
    before = spark.conf.get(listing)
    spark.conf.set(listing, str(min(int(before), tasks)))
    try:
        yield
    finally:
        spark.conf.set(listing, before)


def range_lines(spark: SparkSession, path: str, sized: bool = False, where: Column | None = None) -> DataFrame:
    """(file, start, line): the lines of each range in order, without the line end; ``sized`` adds the ``length`` of the file in bytes, ``where`` chooses files by ``_metadata``."""
    with few_listing_tasks(spark):
        text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    text = text if where is None else text.where(where)
    length = [F.col("_metadata.file_size").alias("length")] if sized else []
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), *length, F.col("value").cast("binary").alias("line"))


def stretches(records: Iterable[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[tuple, bool, list[bytes]]]:
    """(values of ``columns``, whether the range begins here, lines): stretches of equal values."""
    before = None
    for record in records:
        keys = [record.column(record.schema.get_field_index(c)) for c in columns]
        lines = record.column(record.schema.get_field_index("line")).to_pylist()
        turns = np.zeros(max(0, len(lines) - 1), dtype=bool)
        for k in keys:
            turns |= _changes(k)
        low = 0
        for i in [*(np.flatnonzero(turns) + 1).tolist(), *([len(lines)] if lines else [])]:
            key = tuple(k[low].as_py() for k in keys)
            yield key, key != before, lines[low:i]
            before, low = key, i


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before it; nulls are equal."""
    after, ahead = column.slice(1), column.slice(0, max(0, len(column) - 1))
    differ = pc.fill_null(pc.not_equal(after, ahead), False).to_numpy(zero_copy_only=False)
    if not column.null_count:
        return differ
    return differ | pc.xor(after.is_null(), ahead.is_null()).to_numpy(zero_copy_only=False)


def arrow_rows(rows: list, schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_n, k) in zip(zip(*rows), fields)], names=[n for n, _k in fields])


def range_ends(spark: SparkSession, path: str, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(file, start, lines, closed_to, open_to, through, head) of each range.

    ``closed_to`` and ``open_to`` say whether a field is open at its end if none, or one, was at its start. ``head`` is what an open field's record takes
    of the range, null if that is longer than ``head_bytes``; ``through`` if it takes all.
    """

    def run(records) -> Iterator[pa.RecordBatch]:
        found: list[list] = []
        for (file, start), fresh, lines in stretches(records, ("file", "start")):
            if fresh:
                found.append([file, start, 0, False, True, True, []])
                size = 0
            row = found[-1]
            row[2] += len(lines)
            closed, opened = row[3], row[4]
            for line in lines:
                in_head = row[5]
                if b'"' in line:
                    # Once both answers agree they stay one.
                    same = closed == opened
                    closed = ends_open(line, closed)
                    opened = closed if same else ends_open(line, opened)
                if in_head and row[6] is not None:
                    size += len(line)
                    row[6] = [*row[6], line] if size <= head_bytes and len(row[6]) < 1000 else None
                row[5] = in_head and opened
            row[3], row[4] = closed, opened
        if found:
            yield arrow_rows([[*r[:6], None if r[6] is None else b"\n".join(r[6])] for r in found], _SUMMARY)

    ship_package(spark)
    return range_lines(spark, path).mapInArrow(run, _SUMMARY)


def range_starts(ends: DataFrame) -> DataFrame:
    """With ``opened`` instead of the two answers: whether a quoted field is open where the range begins.

    A range either fixes the answer at its end or hands on (or turns) the one it got. So the answer is that of the last range before
    that fixes it, turned once for each range in between that turns it; no row is visited twice. A turn happens where an odd number
    of plain quotes follows.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    fixes = F.col("closed_to") == F.col("open_to")
    turns = F.when(~fixes & F.col("closed_to"), 1).otherwise(0)
    marked = ends.withColumn("_fixed", F.when(fixes, F.col("closed_to").cast("int"))).withColumn("_turned", F.sum(turns).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(F.col("_fixed").isNotNull(), F.struct("_fixed", F.col("_turned").alias("_at"))), ignorenulls=True).over(before)
    reached = F.coalesce(F.lag("_turned").over(Window.partitionBy("file").orderBy("start")), F.lit(0))
    answered = marked.withColumn("_last", last).withColumn("_reached", reached)
    value = F.coalesce(F.col("_last._fixed"), F.lit(0)) + F.col("_reached") - F.coalesce(F.col("_last._at"), F.lit(0))
    return answered.select("file", "start", "lines", "through", "head", (value % 2 == 1).alias("opened"))


def _long_heads(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """(file, start, head) of the open ranges whose head the first pass did not keep; only their lines go through."""

    def run(records) -> Iterator[pa.RecordBatch]:
        key, held, open_ = None, [], False
        for own, fresh, lines in stretches(records, ("file", "start")):
            if fresh:
                if key is not None:
                    yield arrow_rows([(*key, b"\n".join(held))], "file string, start bigint, head binary")
                key, held, open_ = own, [], True
            for line in lines:
                if open_:
                    held.append(line)
                    open_ = ends_open(line, True) if b'"' in line else True
        if key is not None:
            yield arrow_rows([(*key, b"\n".join(held))], "file string, start bigint, head binary")

    return _placed(range_lines(spark, path), ranges.select("file", "start"), 0).mapInArrow(run, "file string, start bigint, head binary")


def _placed(lines: DataFrame, ranges: DataFrame, text_bytes: int) -> DataFrame:
    """Lines with what is known of their range, still in the order of the file."""
    rows = ranges.count()
    if rows * _RANGE_ROW_BYTES + text_bytes <= BROADCAST_LIMIT_BYTES:
        return lines.join(F.broadcast(ranges), ["file", "start"])
    numbered = lines.withColumn("_at", F.monotonically_increasing_id())
    return numbered.join(ranges, ["file", "start"]).sortWithinPartitions("file", "start", "_at").drop("_at")


def described_ranges(spark: SparkSession, path: str, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(file, start, lines, opened, through, rest): how each range begins, and what completes the record that is open at its end."""
    own = ["file", "start"]
    ranges = written(range_starts(range_ends(spark, path, head_bytes)), "ranges")
    heads = ranges.where("opened and head is not null").select(*own, "head")
    missing = ranges.where("opened and head is null")
    if not missing.isEmpty():
        heads = heads.unionByName(written(_long_heads(spark, path, missing), "heads"))
    # A range that an open record takes whole hands on to the next; all others end the record before them and may begin one.
    order = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    through = F.col("opened") & F.col("through")
    counted = ranges.drop("head").withColumn("through", through).withColumn("_own", F.sum(F.when(through, 0).otherwise(1)).over(order))
    began = F.when(F.col("through"), F.col("_own")).otherwise(F.col("_own") - 1)
    pieces = counted.where("opened").withColumn("_own", began).join(heads, own)
    joined = F.expr("unhex(array_join(transform(array_sort(collect_list(struct(start, head))), p -> hex(p.head)), '0A'))")
    rests = pieces.groupBy("file", "_own").agg(joined.alias("rest"))
    return counted.join(rests.withColumn("through", F.lit(False)), ["file", "_own", "through"], "left").select(*own, "lines", "opened", "through", "rest")


def csv_records(spark: SparkSession, path: str, head_bytes: int = HEAD_BYTES) -> DataFrame:
    """(file, start, seq, record): every record of the CSV files below ``path`` as text, quotes and inner line ends kept.

    ``start`` and ``seq`` order the records of a file; the first one is (0, 0). Records end with a line feed, which may follow a carriage return;
    empty lines are none.
    """
    ranges = written(described_ranges(spark, path, head_bytes), "ranges")
    texts = ranges.agg(F.sum(F.octet_length("rest"))).first()[0] or 0

    def run(records) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        held, open_, head, seq, left = [], False, False, 0, 0
        for (file, start, lines_left, opened, through, rest), fresh, lines in stretches(records, ("file", "start", "lines", "opened", "through", "rest")):
            if through:
                continue
            if fresh:
                if left:
                    raise RuntimeError("the input was cut into other ranges than before; the session's settings or the files changed")
                held, open_, head, seq, left = [], opened, opened, 0, lines_left
            for line in lines:
                held.append(line)
                left -= 1
                open_ = ends_open(line, open_) if b'"' in line else open_
                if not open_ or left == 0:
                    if open_ and rest is not None:
                        held.append(rest)
                    record = b"\n".join(held)
                    record = record[:-1] if record.endswith(b"\r") else record
                    if record and not head:
                        out.append((file, start, seq, record))
                        seq, size = seq + 1, size + len(record) + 64
                    held, head = [], False
                    if size > _BATCH_BYTES:
                        yield arrow_rows(out, _RECORD)
                        out, size = [], 0
        if left:
            raise RuntimeError("the input was cut into other ranges than before; the session's settings or the files changed")
        if out:
            yield arrow_rows(out, _RECORD)

    ship_package(spark)
    found = _placed(range_lines(spark, path), ranges, texts).mapInArrow(run, _RECORD)
    return found.select("file", "start", "seq", F.make_valid_utf8(F.col("record").cast("string")).alias("record"))
