"""Stages of a job that can be gone on with: what a stage was made from, and where its output is, is written next to it.

A stage is known by a digest of its name, options and inputs, where an earlier stage counts with its own digest. Its manifest gets a row when an attempt begins and
another when it is done, so an attempt that broke off leaves a row without an end: its output is never read, and the next attempt writes to a path of its own. Only the
first unfinished stage and what follows it runs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Done:
    """A finished stage: its digest, the path of its output and what it reports."""

    key: str
    path: str
    report: dict


def content_key(df: DataFrame) -> str:
    """A digest of the rows of a frame whatever their order; repeated rows count."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    found = df.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("h")).first()
    return f"{df.schema.simpleString()}|{found['n']}|{found['h']}"


def _rows(spark: SparkSession, out: str, name: str) -> list[dict]:
    try:
        found = spark.read.text(f"{out}/manifest/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    # A few rows per attempt.
    return [json.loads(r["value"]) for r in found.collect()]


def _note(spark: SparkSession, out: str, name: str, row: dict) -> None:
    spark.range(1).select(F.lit(json.dumps(row, sort_keys=True)).alias("value")).coalesce(1).write.mode("append").text(f"{out}/manifest/{name}")


def finished(spark: SparkSession, out: str, name: str) -> list[Done]:
    """The finished attempts of a stage."""
    return [Done(r["key"], r["path"], r["report"]) for r in _rows(spark, out, name) if r["state"] == "done"]


def stage(spark: SparkSession, out: str, name: str, inputs: list[str], options: dict, base: str, run: Callable[[str], dict]) -> Done:
    """The finished stage, from its manifest if there; else ``run(path)`` writes it below ``path`` and returns a report of plain values.

    The first attempt writes to ``base``, later ones to paths numbered after it.
    """
    key = hashlib.sha256(json.dumps([name, inputs, options], sort_keys=True).encode()).hexdigest()
    rows = _rows(spark, out, name)
    for row in rows:
        if row["state"] == "done" and row["key"] == key:
            return Done(key, row["path"], row["report"])
    attempt = 1 + sum(r["state"] == "begun" for r in rows)
    path = base if attempt == 1 else f"{out}/{name}-{attempt}"
    _note(spark, out, name, {"state": "begun", "key": key, "path": path})
    report = run(path)
    _note(spark, out, name, {"state": "done", "key": key, "path": path, "report": report, "options": options, "inputs": inputs})
    return Done(key, path, report)
