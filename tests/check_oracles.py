"""Run registered queries and their SQL side by side: ``python tests/check_oracles.py [sf] [key ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from pairloom.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)]
    rows = frame.astype(object).where(frame.notna(), None)
    return rows.sort_values(by=list(rows.columns), key=lambda c: c.astype(str)).reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None if equal, else what differs first."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    kinds = {c: (got[c].dtype.kind, want[c].dtype.kind) for c in got.columns if got[c].dtype.kind != want[c].dtype.kind}
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        differs = [i for i, (x, y) in enumerate(zip(a[c], b[c])) if x != y and not (x is None and y is None)]
        if differs:
            i = differs[0]
            return f"{c}: {len(differs)} of {len(a)} differ, e.g. {str(a[c][i])[:60]!r} vs {str(b[c][i])[:60]!r}; dtypes {kinds}"
    return f"dtypes {kinds}" if kinds else None


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sf_dir = sf if os.path.isdir(sf) else f"/root/testdata/{sf}"
    queries, sql = entry.queries(), entry.oracle_sql()
    keys = sys.argv[2:] or list(queries)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = []
    for name in keys:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            took = time.time() - start
            start = time.time()
            if name not in sql:
                print(f"{name:32s} no SQL   spark {took:6.2f}s rows {len(got)}", flush=True)
                continue
            want = con.execute(sql[name]).df()
            problem = compare(got, want)
        except Exception as error:  # noqa: BLE001
            problem, took, got = f"{type(error).__name__}: {str(error)[:1500]}", time.time() - start, []
        print(f"{name:32s} {'ok' if not problem else 'FAIL'}  spark {took:6.2f}s sql {time.time() - start:6.2f}s rows {len(got)} {problem or ''}", flush=True)
        if problem:
            bad.append(name)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
