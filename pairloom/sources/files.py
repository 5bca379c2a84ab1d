"""CSV, text, parquet and JSON sources and sinks."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_newlines, strip_wrapper
from ..session import ship_package
from . import csv_ranges

# Files of ``write_key_files`` in one folder.
FOLDER_FILES = 1000
# One result record per task file; only the first test split entry is used.
_SCORES = "main_score double, ndcg_at_10 double, map_at_10 double, recall_at_10 double, mrr_at_10 double"
IR_SCHEMA = (
    "task_name string, dataset_revision string, evaluation_time double, "
    f"scores struct<test: array<struct<{_SCORES.replace(' double', ': double')}>>>"
)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file, read from its first record only."""
    # Without partition folders, whose values would count as fields.
    row = _csv_reader(spark).option("header", "false").option("recursiveFileLookup", "true").csv(path).limit(1).collect()
    return [v or "" for v in row[0]] if row else []


_CSV_OPTIONS = {
    "multiLine": "true", "escape": '"', "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "maxCharsPerColumn": "-1",
}


def _csv_reader(spark: SparkSession):
    return spark.read.options(**_CSV_OPTIONS)


def read_csv_text(spark: SparkSession, path: str, columns: Sequence[str] | None = None, ranged: bool = True) -> DataFrame:
    """CSV with a header as all-string rows; ragged rows allowed, a missing field is empty.

    Names match exactly and case-sensitively, the first of equal names wins; an unknown name raises. Files of one
    path must agree in their header: one with other names or another order raises when it is read.

    Files are read by ranges (``csv_ranges``), in parallel although quoted fields may hold line ends, and such line ends come back as they are. Without
    ``ranged`` Spark's own multi-line reader takes a file whole in one task: one pass less for many small files, but in a file
    whose records end with a carriage return and a line feed it turns those inside quotes into line feeds.
    """
    header = csv_header(spark, path)
    wanted = list(columns) if columns is not None else header
    for name in wanted:
        if name not in header:
            raise ValueError(f"{path} has no column {name!r}")
    # Headers can be compared file by file only where the names tell columns apart.
    plain = all(header) and len({n.lower() for n in header}) == len(header)
    if ranged:
        raw = _parsed_ranges(spark, path, header, plain)
    else:
        schema = T.StructType([T.StructField(n if plain else f"_c{i}", T.StringType()) for i, n in enumerate(header)])
        raw = _csv_reader(spark).option("header", "true").option("enforceSchema", str(not plain).lower()).schema(schema).csv(path)
        raw = raw.select(*[F.col(f"`{f.name}`").alias(f"_c{i}") for i, f in enumerate(schema.fields)])
    return raw.select(*[F.coalesce(F.col(f"_c{header.index(n)}"), F.lit("")).alias(n) for n in wanted])


def _parsed_ranges(spark: SparkSession, path: str, header: list[str], plain: bool) -> DataFrame:
    """Columns _c0, _c1, ... of the records cut by ranges, parsed as the whole-file reader does."""
    schema = ", ".join(f"_c{i} string" for i in range(len(header)))
    records = csv_ranges.csv_records(spark, path)
    # Records are whole; a named line end keeps the parser from guessing one inside quotes.
    row = F.from_csv("record", schema, {**_CSV_OPTIONS, "lineSep": "\n"}).alias("row")
    parsed = records.select("start", "seq", row).select("start", "seq", "row.*")
    first = (F.col("start") == 0) & (F.col("seq") == 0)
    same = F.lit(True)
    for i, name in enumerate(header if plain else []):
        same = same & F.col(f"_c{i}").eqNullSafe(F.lit(name))
    refuse = F.raise_error(f"a file below {path} has another header than {header}").cast("boolean")
    return parsed.where(F.when(first, F.when(same, False).otherwise(refuse)).otherwise(True)).drop("start", "seq")


def write_csv_text(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = (
        df.write.option("header", "true")
        .option("escape", '"')
        .option("quoteAll", "true")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
    )
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def discover_csv(spark: SparkSession, root: str, csv_name: str | None = None) -> str:
    """First path, by its parts, named ``csv_name`` below ``root``, else the first that ends in ``.csv``.

    Only the listing is read; no file content is.
    """
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    for wanted in ([name == csv_name] if csv_name else []) + [name.endswith(".csv")]:
        found = listing.where(wanted).agg(F.min_by("path", parts)).first()[0]
        if found:
            return found
    raise FileNotFoundError(f"{root} holds no CSV file")


def read_corpus(spark: SparkSession, path: str, record_sep: str | None = None) -> DataFrame:
    """Corpus texts without newline variants and licence wrapper.

    A whole file is one text; with ``record_sep`` a file holds many, so large files still split.
    """
    lines = spark.read.text(path, wholetext=True) if record_sep is None else spark.read.text(path, lineSep=record_sep)
    return lines.select(strip_wrapper(normalize_newlines(F.col("value"))).alias("text"))


def write_key_files(df: DataFrame, key: str, path: str) -> None:
    """One text file for each value of ``key`` that a task holds, with its rows of that value as lines; the last ``key=...`` of a file's path names the value.

    Hadoop's local file system starts processes for each file it creates, some 35 ms of a core, which counts where a value has few rows. There
    tasks write their files themselves, in order of the key, ``key=....txt`` in folders of ``FOLDER_FILES``, each under a hidden name first. On other file systems
    it is Spark's partitioned table, a folder a value.
    """
    spark = df.sparkSession
    root = _local_path(spark, path)
    value = next(c for c in df.columns if c != key)
    if root is None:
        df.write.partitionBy(key).text(path)
        return
    ship_package(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        written, last, out, hidden, final = 0, None, None, "", ""
        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None or own != last:
                    if out is not None:
                        out.close()
                        os.replace(hidden, final)
                    folder, name = os.path.join(root, f"part-{task.partitionId():05d}-{written // FOLDER_FILES:05d}"), f"{key}={_path_name(own)}.txt"
                    os.makedirs(folder, exist_ok=True)
                    hidden, final = os.path.join(folder, f".{name}.{task.taskAttemptId()}"), os.path.join(folder, name)
                    out, last, written = open(hidden, "wb"), own, written + 1
                out.write((text or "").encode() + b"\n")
        if out is not None:
            out.close()
            os.replace(hidden, final)
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["files"])

    os.makedirs(root)
    rows = df.select(F.nullif(F.col(key).cast("string"), F.lit("")).alias("own"), F.col(value).alias("value")).sortWithinPartitions("own")
    rows.mapInArrow(run, "files bigint").agg(F.sum("files")).collect()


def _local_path(spark: SparkSession, path: str) -> str | None:
    """The path on the local file system, which a scratch folder there shares with all executors; None on another one."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return system.makeQualified(at).toUri().getPath() if system.getUri().getScheme() == "file" else None


def _path_name(value: str | None) -> str:
    """As Spark writes a partition value in a path."""
    if value is None:
        return "__HIVE_DEFAULT_PARTITION__"
    return re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value)


def _present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    keep = F.lit(True)
    for c in columns:
        keep = keep & F.col(c).isNotNull() & (F.col(c) != "")
    return df.select(*columns).where(keep)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return _present(spark.read.parquet(path), ["anchor", "positive"])


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    return _present(spark.read.parquet(path), ["anchor", "positive", "negative"])


def write_pairs(df: DataFrame, path: str) -> None:
    df.select("anchor", "positive").write.parquet(path)


def write_triplets(df: DataFrame, path: str) -> None:
    df.select("anchor", "positive", "negative").write.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """One-row report as JSON; the single row makes a single file right."""
    df.coalesce(1).write.json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_ir_results(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """First test entry of each result JSON for the expected tasks; a missing file is an error row."""
    raw = (
        spark.read.schema(IR_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true").json(path)
    )
    first = F.element_at("scores.test", 1)
    rows = raw.select(
        "task_name",
        "dataset_revision",
        *[first[c].alias(c) for c in ("main_score", "ndcg_at_10", "map_at_10", "recall_at_10", "mrr_at_10")],
        F.col("evaluation_time").alias("evaluation_time_s"),
        F.lit(True).alias("_found"),
    )
    joined = expected.select("task_name").join(rows, "task_name", "left")
    return joined.withColumn("error", F.when(F.col("_found").isNull(), F.lit("result_json_not_found"))).drop("_found")
