"""Texts of whole files that may be larger than a task's memory, read by ranges.

A file that one task reads at once anyway, within a piece and a split, is one row that is cut where it is read. Of larger files
a range's lines become pieces of bounded size that end at line ends, so a marker, which stands in one line, is in one piece. A first pass notes where the first start
and the first end marker of each file stand, one small row per file; the second pass reads the pieces again and cuts them by these places. Line ends are
line feeds, carriage returns or both; whether a file ends with one is told by its size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WRAPPER_END, WRAPPER_START, normalize_newlines, strip_wrapper
from ..operators.layout import broadcast_within, computed_once
from ..session import ship_package, written
from .csv_ranges import arrow_rows, few_listing_tasks, range_lines, stretches

PIECE_BYTES = 1 << 20
_PIECE = "file string, start bigint, part bigint, text string"
_MARK = "file string, start bigint, length bigint, bytes bigint, last bigint, chars bigint, first_part bigint, first_line_end bigint, end_part bigint, end_at bigint"
_FILE_ROW_BYTES = 300
# Names of files that only the reader of lines unpacks.
_COMPRESSED = r"(?i)\.(deflate|gz|bz2|snappy|lz4|zst)$"
# Of many small files a task reads so many bytes, where that leaves each core so many tasks.
_TASK_BYTES, _CORE_TASKS = 16 << 20, 4


def _pieces(records: Iterable[pa.RecordBatch], piece_bytes: int, own: tuple[str, ...] = ("file", "start")) -> Iterator[tuple]:
    """(values of ``own``, part, text, bytes, whether the range begins) of each piece; line ends are line feeds, the last one included."""
    part = 0
    for key, fresh, lines in stretches(records, own):
        part = 0 if fresh else part
        held, size = [], 0
        for i, line in enumerate(lines, start=1):
            held.append(line)
            size += len(line) + 1
            if size >= piece_bytes or i == len(lines):
                text = (b"\n".join(held) + b"\n").decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
                yield *key, part, text, size, fresh
                held, size, part, fresh = [], 0, part + 1, False


def _marks(lines: DataFrame, piece_bytes: int) -> DataFrame:
    """One row per range: its bytes, its last piece and that one's length, and the pieces and places of its first markers."""

    def run(records) -> Iterator[pa.RecordBatch]:
        found: list[list] = []
        for file, start, length, part, text, size, fresh in _pieces(records, piece_bytes, ("file", "start", "length")):
            if fresh:
                found.append([file, start, length, 0, 0, 0, None, None, None, None])
            row = found[-1]
            row[3], row[4], row[5] = row[3] + size, part, len(text)
            if row[6] is None and (at := text.find(WRAPPER_START)) >= 0:
                row[6], row[7] = part, text.find("\n", at) + 1
            if row[8] is None and (at := text.find(WRAPPER_END)) >= 0:
                row[8], row[9] = part, at
        if found:
            yield arrow_rows(found, _MARK)

    return lines.mapInArrow(run, _MARK)


def corpus_pieces(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(file, start, part, text): the texts of all files below ``path`` in pieces, which (start, part) orders, without newline variants and licence wrapper.

    A file's text is what follows the line of the first start marker and stands before the first end marker, either optional. A piece ends with a line, but
    one line is never cut. Files without any line give no row.
    """
    ship_package(spark)
    whole = min(piece_bytes, _split_bytes(spark))
    lines = range_lines(spark, path, sized=True, where=~_read_whole(whole))
    place = lambda part, at: F.min(F.when(F.col(part).isNotNull(), F.struct("start", F.col(part).alias("part"), F.col(at).alias("at"))))
    ranges = _marks(lines, piece_bytes).groupBy("file").agg(
        F.max("length").alias("length"), F.sum("bytes").alias("bytes"), F.max(F.struct("start", F.col("last").alias("part"), "chars")).alias("tail"),
        place("first_part", "first_line_end").alias("first"), place("end_part", "end_at").alias("end"),
    )
    # Counted with a line end that the file does not have.
    files = ranges.withColumn("unended", F.col("bytes") > F.col("length"))
    # A start marker whose line has no end cuts nothing.
    endless = F.col("unended") & (F.col("first") == F.struct("tail.start", "tail.part", F.col("tail.chars").alias("at")))
    marks = written(files.withColumn("first", F.when(~F.coalesce(endless, F.lit(False)), F.col("first"))).select("file", "unended", "tail", "first", "end"), "marks")

    def run(records) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for file, start, part, text, size, _fresh in _pieces(records, piece_bytes):
            out.append((file, start, part, text))
            held += size
            if held >= 4 * piece_bytes:
                yield arrow_rows(out, _PIECE)
                out, held = [], 0
        if out:
            yield arrow_rows(out, _PIECE)

    pieces = lines.drop("length").mapInArrow(run, _PIECE)
    both = pieces.join(broadcast_within(marks, marks.count(), _FILE_ROW_BYTES), "file")
    here = F.struct("start", "part")
    at = lambda mark: F.struct(f"{mark}.start", f"{mark}.part")
    length = F.char_length("text") - F.when(F.col("unended") & (here == at("tail")), 1).otherwise(0)
    low = F.when(F.col("first").isNotNull() & (here == at("first")), F.col("first.at")).otherwise(0).cast("int")
    high = F.when(F.col("end").isNotNull() & (here == at("end")), F.col("end.at")).otherwise(length).cast("int")
    inside = (F.col("first").isNull() | (here >= at("first"))) & (F.col("end").isNull() | (here <= at("end")))
    cut = both.where(inside).select("file", "start", "part", F.substring(F.col("text"), low + 1, F.greatest(high - low, F.lit(0))).alias("text"))
    return cut.where("text <> ''").unionByName(_whole_files(spark, path, whole))


def _split_bytes(spark: SparkSession) -> int:
    """The most bytes of a file that one task reads."""
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))


def _read_whole(most: int) -> Column:
    """Whether a listed file is read whole; the listing decides, and no other file is opened for it."""
    return (F.col("_metadata.file_size") <= most) & ~F.col("_metadata.file_name").rlike(_COMPRESSED)


def _whole_files(spark: SparkSession, path: str, most: int) -> DataFrame:
    """(file, start, part, text) of the files of at most ``most`` bytes, one row each and read once."""
    with few_listing_tasks(spark):
        # The text reader copies the session's Hadoop settings for each file, which costs more than a small file.
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    # A file counts as several megabytes when files are dealt out, so that a task would read a handful of small ones.
    tasks = max(_CORE_TASKS * spark.sparkContext.defaultParallelism, int(str(found._jdf.queryExecution().analyzed().stats().sizeInBytes())) // _TASK_BYTES)
    value = F.make_valid_utf8(F.col("content").cast("string")).alias("value")
    read = found.where(_read_whole(most)).select(F.col("_metadata.file_path").alias("file"), value).coalesce(tasks)
    # As the reader of lines does, without a byte order mark.
    plain = F.when(F.col("value").startswith("\ufeff"), F.expr("substring(value, 2)")).otherwise(F.col("value"))
    texts = computed_once(computed_once(read, value=normalize_newlines(plain)), text=strip_wrapper(F.col("value")))
    return texts.where("text <> ''").select("file", F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("part"), "text")
