"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def local_session(cpus: int | str = 8, app: str = "pairloom", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names; a temporary one only for a local master.

    A machine-local folder would be invisible to other executors, so a cluster without
    ``spark.checkpoint.dir`` is an error and not a silent fallback.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CHECKPOINT_KEY} to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="pairloom-")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir() or root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the scratch root, never reused."""
    return os.path.join(scratch_root(spark), f"{name}-{uuid.uuid4().hex}")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the scratch folder, whose size the planner knows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """While tables are written: what was shuffled for one goes when it is there, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextmanager
def scratch_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """``written`` for tables that are read within the block only and are deleted where it ends."""
    paths = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        paths.append(scratch_path(spark, name))
        with dropped_shuffles(spark):
            df.write.parquet(paths[-1])
        return spark.read.schema(df.schema).parquet(paths[-1])

    try:
        yield keep
    finally:
        for path in paths:
            forget(spark, path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage through a reliable checkpoint, which outlives lost executors."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch_root(spark))
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application.

    Arrow functions are pickled by module name, so executors need the module even where it is not
    installed. Spark distributes the archive itself.
    """
    context = spark.sparkContext
    if getattr(context, "_pairloom_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="pairloom-code-"), "pairloom_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _dirs, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(package)))
    context.addPyFile(archive)
    context._pairloom_shipped = True
