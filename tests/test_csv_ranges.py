"""Large CSV files read by ranges give the rows of the whole-file reader."""

from __future__ import annotations

import csv
import io
import random

import pytest

from pairloom.sources import csv_ranges, files

HEADER = ["id", "a", "b"]


def opened_plain(line: bytes, opened: bool) -> bool:
    """One character at a time."""
    state = "quoted" if opened else "start"
    for i, c in enumerate(line.decode()):
        if state == "start":
            state = "quoted" if c == '"' else ("start" if c == "," else "plain")
        elif state == "plain":
            state = "start" if c == "," else "plain"
        elif state == "quoted":
            state = "closing" if c == '"' else "quoted"
        elif state == "closing":
            state = "quoted" if c == '"' else ("start" if c == "," else "plain")
    return state == "quoted"


def test_a_line_leaves_a_field_open_as_the_rules_say():
    rng = random.Random(5)
    for _ in range(20_000):
        line = "".join(rng.choice('"",a\r ') for _ in range(rng.randrange(12))).encode()
        for opened in (False, True):
            assert csv_ranges.ends_open(line, opened) == opened_plain(line, opened), (line, opened)


@pytest.fixture
def small_splits(spark):
    """Ranges of a few hundred bytes."""
    key = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"
    before = {k: spark.conf.get(k, None) for k in key}
    for k, v in zip(key, ("600b", "1", "1")):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def field(rng) -> str:
    return rng.choice(["", "x", "plain text", 'say "hi"', "two\nlines", "a,b", '\n"\n', "\r\n", "a\rb", "é", "long " * rng.randrange(40), "\n" * rng.randrange(30), '""', " lead", "trail "])


def write(path, rows, end="\n", last=True):
    text = io.StringIO()
    writer = csv.writer(text, lineterminator=end)
    writer.writerow(HEADER)
    for row in rows:
        writer.writerow(row)
    content = text.getvalue()
    path.write_bytes((content if last else content[: -len(end)]).encode())


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed,end,last", [(1, "\n", True), (2, "\n", False), (3, "\r\n", True), (4, "\r\n", False)])
def test_ranges_give_the_written_rows(spark, small_splits, tmp_path, seed, end, last):
    rng = random.Random(seed)
    rows = [(str(i), field(rng), field(rng)) for i in range(400)]
    for name, part in (("one.csv", rows[:300]), ("two.csv", rows[300:])):
        write(tmp_path / name, part, end, last)
    want = sorted(rows)
    whole = rows_of(files.read_csv_text(spark, str(tmp_path), HEADER, ranged=False))
    assert whole == (want if end == "\n" else [tuple(v.replace("\r\n", "\n") for v in row) for row in want])
    assert rows_of(files.read_csv_text(spark, str(tmp_path), HEADER)) == want
    ranges = csv_ranges.described_ranges(spark, str(tmp_path)).collect()
    assert len(ranges) > 20 and any(r.opened for r in ranges)
    # No head is kept on suspicion: all that are heads are read again.
    starved = csv_ranges.csv_records(spark, str(tmp_path), head_bytes=0)
    assert rows_of(starved) == rows_of(csv_ranges.csv_records(spark, str(tmp_path)))


def test_a_record_longer_than_ranges(spark, small_splits, tmp_path):
    rows = [("1", "x", "y"), ("2", "line\n" * 2000, 'quote " here'), ("3", "", ""), ("4", "\n" * 3000, "end")]
    write(tmp_path / "long.csv", rows)
    ranges = csv_ranges.described_ranges(spark, str(tmp_path)).collect()
    assert sum(r.through for r in ranges) > 10
    assert rows_of(files.read_csv_text(spark, str(tmp_path), HEADER)) == sorted(rows)


def test_without_broadcast_the_order_of_lines_is_kept(spark, small_splits, tmp_path, monkeypatch):
    rng = random.Random(9)
    rows = [(str(i), field(rng), field(rng)) for i in range(200)]
    write(tmp_path / "one.csv", rows)
    monkeypatch.setattr(csv_ranges, "BROADCAST_LIMIT_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert rows_of(files.read_csv_text(spark, str(tmp_path), HEADER)) == sorted(rows)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stray_quotes_ragged_rows_and_empty_lines(spark, small_splits, tmp_path):
    lines = ["id,a,b", 'un"quoted,x,y"', "", '1,"closed" tail,2', "short", "1,2,3,4,5", '"",,""', ' "not quoted,2', 'a,"b,""c""",d', " ,\t,x"] * 1
    body = "\n".join(lines[:1] + lines[1:] * 40) + "\n"
    (tmp_path / "odd.csv").write_text(body)
    got = rows_of(files.read_csv_text(spark, str(tmp_path), HEADER))
    assert got == rows_of(files.read_csv_text(spark, str(tmp_path), HEADER, ranged=False)) and len(got) == 8 * 40


def test_other_headers_are_refused_and_empty_files_read(spark, small_splits, tmp_path):
    write(tmp_path / "a.csv", [("1", "2", "3")] * 100)
    assert len(rows_of(files.read_csv_text(spark, str(tmp_path), ["b"], ranged=True))) == 100
    (tmp_path / "b.csv").write_text("id,b,a\n" + "1,2,3\n" * 100)
    with pytest.raises(Exception, match="header"):
        files.read_csv_text(spark, str(tmp_path), HEADER, ranged=True).collect()
    (tmp_path / "none").mkdir()
    write(tmp_path / "none" / "c.csv", [])
    assert rows_of(files.read_csv_text(spark, str(tmp_path / "none"), HEADER, ranged=True)) == []
