"""Large corpus files read in pieces give the text of the whole file."""

from __future__ import annotations

import gzip
import random

import pytest
from pyspark.sql import functions as F

from pairloom.functions.text import WRAPPER_END, WRAPPER_START
from pairloom.sources import corpus_ranges, files
from tests.test_csv_ranges import small_splits  # noqa: F401


def whole(raw: str) -> str:
    text = raw.replace("\r\n", "\n").replace("\r", "\n")
    at = text.find(WRAPPER_START)
    start = text.find("\n", at) + 1 if at >= 0 else 0
    end = text.find(WRAPPER_END)
    return text[start : max(start, end) if end >= 0 else len(text)]


def read(spark, path, piece):
    found = {}
    for r in corpus_ranges.corpus_pieces(spark, str(path), piece).collect():
        found.setdefault(r.file.rsplit("/", 1)[1], []).append((r.start, r.part, r.text))
    return {name: "".join(t for _s, _p, t in sorted(parts)) for name, parts in found.items()}, sum(map(len, found.values()))


@pytest.mark.parametrize("piece", [1, 150, 1 << 20])
def test_pieces_are_the_whole_text(spark, small_splits, tmp_path, piece):  # noqa: F811
    rng = random.Random(3)
    line = lambda: rng.choice(["", "words of a line", "é" * 30, "x\ry", "\r", "*** START", "long " * 60])
    lines = lambda n: rng.choice(["\n", "\r\n"]).join(line() for _ in range(n))
    start, end = WRAPPER_START + " A ***", WRAPPER_END + " A ***"
    texts = {
        "both": lines(80) + f"\n{start}\r\n" + lines(120) + f"\n{end}\n" + lines(60), "start": f"{start}\n" + lines(50), "end": lines(50) + f"\nmid {end} of a line\n" + lines(30),
        "none": lines(100) + "\n", "bare": lines(100) + "z", "twice": f"{start}\na\n{start}\nb\n{end}\nc\n{end}", "same": f"x {start} y {end}\nrest", "turned": f"a\n{end}\nb\n{start}\nc\n",
        "endless": "first\n" + start, "endless2": "first\n" * 200 + start + " end", "last": f"{start}\n", "mac": f"a\r{start}\rb\rc\r{end}\rd", "open": "text\n" * 300 + f"{start}\nq",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "empty").write_bytes(b"")
    got, pieces = read(spark, tmp_path, piece)
    want = {name: whole(text) for name, text in texts.items()}
    assert got == {name: text for name, text in want.items() if text}
    assert pieces > len(texts)
    for name in ("both", "none", "mac"):
        assert files.read_corpus(spark, str(tmp_path / name)).first()["text"] == want[name]


def test_small_files_are_read_whole_and_by_few_tasks(spark, tmp_path):
    texts = {f"f{i}": f"before\r\n{WRAPPER_START} A ***\r\na {i}\r\nb é\r{WRAPPER_END} A ***\r\nafter" for i in range(300)}
    texts |= {"long": "line of a long file\n" * 200_000}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "mark").write_bytes(b"\xef\xbb\xbfmarked\n")
    (tmp_path / "bad").write_bytes(b"a\xff\xfeb")
    (tmp_path / "packed.gz").write_bytes(gzip.compress(b"packed\r\nlines\n"))
    (tmp_path / "_hidden").write_bytes(b"not read")
    context, key = spark.sparkContext, "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "16m")
    try:
        context.setJobGroup("small", "files")
        got, _ = read(spark, tmp_path, 1 << 20)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set(key, before)
    rest = {"mark": "marked\n", "bad": "a��b", "packed.gz": "packed\nlines\n"}
    assert got == {name: whole(text) for name, text in texts.items()} | rest
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("small") for s in tracker.getJobInfo(j).stageIds]
    # A file counts as 4 MB when files are dealt out: 300 files used to be 76 tasks, twice.
    assert stages and max(s.numTasks for s in stages if s) <= 40


def test_files_by_key_hold_what_a_partitioned_table_holds(spark, tmp_path):
    rows = [("a", "one\r\ntwo"), ("b", ""), ("a", "three"), (None, "none"), ("", "empty"), ("x/y=%:é {z}", "odd"), ("b", None), ("c" * 40, "é\n" * 9)]
    df = spark.createDataFrame(rows, "k string, v string").coalesce(1)
    df.write.partitionBy("k").text(str(tmp_path / "spark"))
    files.write_key_files(df, "k", str(tmp_path / "ours"))
    files.write_key_files(df, "k", f"file://{tmp_path}/named")

    def laid(root):
        found = {}
        for f in root.rglob("k=*"):
            if f.is_file():
                found.setdefault(f.name.removesuffix(".txt"), []).append(f.read_bytes())
        return {k: sorted(v) for k, v in found.items()}

    want = {p.name: sorted(f.read_bytes() for f in p.glob("part-*")) for p in (tmp_path / "spark").glob("k=*")}
    assert laid(tmp_path / "ours") == laid(tmp_path / "named") == want and len(want) == 5
    assert want["k=a"] == [b"one\r\ntwo\nthree\n"] and not [f for f in (tmp_path / "ours").rglob(".*")]
    # Files of the same key from several tasks stand beside each other.
    files.write_key_files(spark.createDataFrame(rows, "k string, v string").repartition(3), "k", str(tmp_path / "dealt"))
    assert {k: sorted(b"".join(v)) for k, v in laid(tmp_path / "dealt").items()} == {k: sorted(b"".join(v)) for k, v in want.items()}
    # A key of whole numbers, many of them; a table without rows.
    many = spark.range(2100).select(F.col("id").alias("k"), F.lit("x").alias("v")).coalesce(1)
    files.write_key_files(many, "k", str(tmp_path / "numbers"))
    files.write_key_files(many.limit(0), "k", str(tmp_path / "none"))
    assert laid(tmp_path / "numbers") == {f"k={i}": [b"x\n"] for i in range(2100)} and laid(tmp_path / "none") == {}
    assert sorted(len(list(p.iterdir())) for p in (tmp_path / "numbers").iterdir()) == [100, 1000, 1000]
    with pytest.raises(FileExistsError):
        files.write_key_files(many, "k", str(tmp_path / "numbers"))
