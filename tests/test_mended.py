"""Inputs the tables do not hold."""

from __future__ import annotations

import numpy as np
import pytest

from pairloom.operators import negatives, retrieve, stats, table, train
from pairloom.sources import files, models

CONFIG = table.ModelConfig(vocab_size=40, embedding_dim=4, max_seq_len=None)


def vectors(df):
    return {r["id"]: [round(x, 9) for x in r["embedding"]] for r in df.collect()}


def test_null_texts_are_zero_and_whole_texts_are_used(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, " "), (4, "x " * 9000 + "y")], "id int, text string")
    start = table.init_token_table(spark, CONFIG, 1)
    found = vectors(table.embed_table(rows, ["id"], "text", start, CONFIG))
    assert found[2] == found[3] == [0.0] * 4
    assert vectors(table.embed_batches(rows, "text", start, CONFIG)) == found


def test_large_tables_are_embedded_by_joins(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "a b"), (4, "c")], "id int, text string")
    start = table.init_token_table(spark, CONFIG, 1)
    want = vectors(table.embed_batches(rows, "text", start, CONFIG))
    monkeypatch.setattr(table, "BROADCAST_LIMIT_BYTES", 10)
    assert vectors(table.embed_batches(rows, "text", start, CONFIG)) == want


def test_pairs_that_hold_the_separator_keep_apart(spark):
    pairs = train.with_pair_key(spark.createDataFrame([("x|x", "x"), ("x", "x|x")], "anchor string, positive string"))
    assert pairs.select("pkey").distinct().count() == 2


@pytest.mark.parametrize("pool, pairs", [(["a", "b"], 0), (["a", "b", "c"], 30), (["a", "c"], 30), (["c", "d"], 30)])
def test_draws_find_what_the_pool_holds(spark, pool, pairs):
    indexed = negatives.index_pool(spark.createDataFrame([(p,) for p in pool], "negative string"), 3)
    rows = train.with_pair_key(spark.createDataFrame([("a", "b", k) for k in range(30)], "anchor string, positive string, copy bigint"))
    found = negatives.draw_rejecting(rows, indexed, 3, train.PAIR_KEYS).collect()
    assert len(found) == pairs and {r["negative"] for r in found} <= set(pool) - {"a", "b"}


def test_bootstrap_numbers_repeats_with_gaps(spark):
    rows = spark.createDataFrame([("g", k, float(k)) for k in (0, 1, 3)], "g string, k bigint, v double")
    found = stats.bootstrap_median_ci(rows, ["g"], "v", 300, 0.95, 5).first()
    assert found["samples"] == 300 and found["ci_high"] == 3.0


def test_a_doubled_row_is_no_valid_model(spark):
    rows = table.init_token_table(spark, CONFIG, 1)
    broken = rows.where("token_id <> 5").unionByName(rows.where("token_id = 6"))
    assert models.check_model(rows, CONFIG).first()["valid"] and not models.check_model(broken, CONFIG).first()["valid"]


def test_csv_files_that_disagree_raise(spark, tmp_path):
    (tmp_path / "a.csv").write_text("q1,q2\n1,2\n")
    (tmp_path / "b.csv").write_text("q1,q2\n3,4\n")
    assert sorted(map(tuple, files.read_csv_text(spark, str(tmp_path), ["q2"]).collect())) == [("2",), ("4",)]
    (tmp_path / "c.csv").write_text("q2,q1\n5,6\n")
    with pytest.raises(Exception, match="header|CSV"):
        files.read_csv_text(spark, str(tmp_path), ["q1", "q2"]).collect()


def test_files_are_ordered_by_path_parts_and_names_are_no_patterns(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name in ("a/b.csv", "a-b.csv", "x[1].csv"):
        (tmp_path / name).write_text("q\n1\n")
    assert files.discover_csv(spark, str(tmp_path)).endswith("/a/b.csv")
    assert files.discover_csv(spark, str(tmp_path), "a-b.csv").endswith("/a-b.csv")
    assert files.discover_csv(spark, str(tmp_path), "[ax]*.csv").endswith("/a/b.csv")
    with pytest.raises(FileNotFoundError):
        files.discover_csv(spark, str(tmp_path / "a"), "none.csv") if (tmp_path / "a" / "b.csv").unlink() is None else None


@pytest.mark.parametrize("hold", ["queries", "corpus"])
@pytest.mark.parametrize("block", [1 << 26, 4 * 8 * 7])
def test_retrieval_skips_broken_vectors_in_any_number_of_blocks(spark, monkeypatch, hold, block):
    monkeypatch.setattr(retrieve, "HELD_BLOCK_BYTES", block)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(40)]
    broken = [(50, None), (51, [1.0]), (52, [1.0, None, 0.0, 9.0])]
    corpus = spark.createDataFrame(rows + broken, "id bigint, v array<double>")
    got = retrieve.top_k(corpus.withColumnRenamed("id", "q"), "q", corpus, ["id"], "v", retrieve.dense_encoding(4), 3, hold, skip_self=True)
    want = []
    for q, a in rows:
        best = sorted((-float(np.dot(a, b)), i) for i, b in rows if i != q)[:3]
        want += [(q, i, -s) for s, i in best]
    assert sorted((r["q"], r["id"], r["score"]) for r in got.collect()) == sorted(want)
