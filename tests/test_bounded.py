"""What a task holds and a step costs stays bounded, with the results of plain versions."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairloom.llm import pieces
from pairloom.operators import retrieve, table, tokens, train, vector_index
from pairloom.session import scratch_tables
from pairloom.sources import corpus_ranges, csv_ranges

CONFIG = table.ModelConfig(vocab_size=50, embedding_dim=3, max_seq_len=None)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_slices_of_texts_are_bounded_and_whole():
    texts = ["ab" * 40, None, "", "c" * 500, "d", "e" * 99, None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "t": pa.array(texts), "u": pa.array(["x"] * 7)})
    parts = list(tokens.text_slices(batch, [1, 2], 100))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    sizes = [sum(len(t or "") + 1 for t in p.column(1).to_pylist()) for p in parts]
    assert len(parts) > 2 and all(s <= 100 or p.num_rows == 1 for s, p in zip(sizes, parts))
    assert [p.num_rows for p in tokens.text_slices(batch.slice(0, 0), [1], 100)] == [0]


def test_tokens_are_counted_without_a_table_of_all_tokens(spark):
    texts = ["a b a c", "", None, "!!! a", "b " * 300, "a b a c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    counts = table.token_counts(df, ["id"], "t", CONFIG)
    assert "Aggregate" not in plan(counts)
    ids = {r["id"]: r["i"] for r in table.with_ids(df, {"i": "t"}, CONFIG).collect()}
    want = {(k, len(v), token, n) for k, v in ids.items() for token, n in Counter(v).items()}
    rows = [tuple(r) for r in counts.select("id", "length", "token_id", "count").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert dict(counts.dtypes) == {"id": "bigint", "length": "int", "token_id": "bigint", "count": "bigint"}


def test_rows_that_share_a_key_are_pooled_as_one_text(spark):
    start = table.init_token_table(spark, CONFIG, 4)
    pool = lambda rows: {r["id"]: r["embedding"] for r in table.mean_pool(spark.createDataFrame(rows, "id long, t string"), ["id"], "t", start, CONFIG).collect()}
    split, whole = pool([(1, "a b a"), (1, "a c d"), (None, "e"), (None, "f")]), pool([(1, "a b a a c d"), (None, "e f")])
    assert split.keys() == whole.keys() == {1, None}
    for key in whole:
        assert split[key] == pytest.approx(whole[key], abs=1e-12)


@pytest.mark.parametrize("dim", [3, 70])
def test_masked_means_of_few_dimensions_are_plain_sums(spark, dim):
    rng = np.random.default_rng(1)
    rows = [(int(i % 5), int(rng.integers(0, 2)) if i % 5 else 0, int(rng.integers(1, 4)), rng.normal(size=dim).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, mask int, n long, vec array<double>")
    for count in (None, "n"):
        found = table.masked_mean_pool(df, ["id"], "mask", dim, count)
        assert ("ObjectHashAggregate" in plan(found)) == (dim > 64)
        got = {r["id"]: r["embedding"] for r in found.collect()}
        for key in range(5):
            mine = [(r[2] if count else 1, np.array(r[3])) for r in rows if r[0] == key and r[1]]
            want = sum(w * v for w, v in mine) / sum(w for w, _ in mine) if mine else np.zeros(dim)
            assert got[key] == pytest.approx(want.tolist(), abs=1e-12)


def test_texts_that_nobody_reads_again_do_not_come_back(spark):
    df = spark.createDataFrame([(1, "a b", "c", "d")], "tid long, anchor string, positive string, negative string")
    assert train.tokenize(df, CONFIG).columns == ["tid", "anchor_ids", "positive_ids", "negative_ids"]
    mapped = next(line for line in plan(train.tokenize(df, CONFIG)).splitlines() if "MapInArrow" in line)
    assert "string" not in mapped and mapped.count("_ids") >= 3 and "], [tid" not in mapped


def test_training_with_a_table_that_goes_along_is_training_with_a_dealt_one(spark, monkeypatch):
    pairs = train.with_pair_key(spark.createDataFrame([(f"a{i} b{i % 3}", f"c{i} a{i % 5}") for i in range(20)], "anchor string, positive string"))
    options = train.TrainOptions(epochs=2, learning_rate=0.3, margin=0.5, seed=5, batch_size=7)
    start = table.init_token_table(spark, CONFIG, 9)
    ends = []
    for limit, files in ((0, 1024), (1 << 20, 1024), (1 << 20, 0.5)):
        monkeypatch.setattr(train, "HELD_TABLE_BYTES", limit)
        monkeypatch.setattr(train, "FILE_TRIPLETS", files)
        if files < 1:
            # Sums by token before the driver gets them, several files a batch.
            monkeypatch.setattr(train, "BATCH_FILES", 3)
        final, history = train.train_epochs(pairs, start, CONFIG, options)
        ends.append((table.table_matrix(final, CONFIG), [tuple(r) for r in history.orderBy("epoch").collect()], final.schema, final.count()))
    for weights, rows, schema, count in ends[1:]:
        assert weights == pytest.approx(ends[0][0], abs=1e-12) and count == ends[0][3] == 50
        assert [r[:3] for r in rows] == [r[:3] for r in ends[0][1]] and [r[3] for r in rows] == pytest.approx([r[3] for r in ends[0][1]], abs=1e-12)
        assert schema.simpleString() == ends[0][2].simpleString()


def test_a_step_of_a_small_batch_is_one_job(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"a{i} b", f"c{i}", "d") for i in range(64)], "tid long, anchor string, positive string, negative string")
    path = str(tmp_path / "batch")
    train.tokenize(rows, CONFIG).coalesce(1).write.parquet(path)
    batch = spark.read.schema(train.tokenize(rows, CONFIG).schema).parquet(path)
    matrix = table.table_matrix(table.init_token_table(spark, CONFIG, 1), CONFIG)
    context = spark.sparkContext
    context.setJobGroup("one-step", "a step")
    counts, updates = train.held_step(batch, matrix, CONFIG, 0.3, 0.5, True)
    context.setLocalProperty("spark.jobGroup.id", None)
    assert len(context.statusTracker().getJobIdsForGroup("one-step")) == 1
    assert counts[0] == 64 and np.abs(updates).sum() > 0


def test_a_run_of_small_batches_is_one_job(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    text = lambda most: " ".join(f"w{i}" for i in rng.integers(0, 60, rng.integers(0, most)))
    rows = spark.createDataFrame([(int(i), text(9), text(30), text(9)) for i in rng.permutation(90)], "tid long, anchor string, positive string, negative string")
    part = train.tokenize(rows, CONFIG)
    part.repartition(3).write.parquet(str(tmp_path / "run"))
    part = spark.read.schema(part.schema).parquet(str(tmp_path / "run"))
    start = table.table_matrix(table.init_token_table(spark, CONFIG, 1), CONFIG)
    matrix, counts = start, np.zeros(3)
    for low in range(0, 90, 7):
        found, updates = train.held_step(part.where((F.col("tid") >= low) & (F.col("tid") < low + 7)), matrix, CONFIG, 0.3, 0.5, True)
        matrix, counts = matrix - updates, counts + found
    context, rows_each = spark.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_each)
    # Batches of training, here of 7, run over those of Arrow; the plain way where counts are not held.
    for records, cells in ((10_000, 1 << 20), (5, 1 << 20), (4, 1)):
        spark.conf.set(rows_each, str(records))
        monkeypatch.setattr(train, "_COUNT_CELLS", cells)
        context.setJobGroup(f"run-{records}", "a run")
        got, new = train.held_run(part, start, CONFIG, 0.3, 0.5, 7)
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set(rows_each, before)
        assert len(context.statusTracker().getJobIdsForGroup(f"run-{records}")) == 1
        assert new == pytest.approx(matrix, abs=1e-12) and got == pytest.approx(counts, abs=1e-9)
    assert counts[0] == 90 and np.abs(matrix - start).sum() > 0


def test_pairs_find_their_texts_in_the_pool(spark):
    rows = [("a b", "c"), ("c", "a b"), (None, "d e"), ("d e", ""), ("f a a", "c"), ("f a a", "c")]
    pairs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "anchor string, positive string, copy long")
    keyed = train.with_pair_key(pairs)
    with scratch_tables(spark) as keep:
        pool, placed = train._placed_pairs(keyed, CONFIG, 5, keep)
        pool, placed = pool.collect(), {r["pkey"]: (r["anchor"], r["positive"]) for r in placed.collect()}
    want = train.index_pool(train.pool_of_pairs(keyed), 5)
    tokenized = train.with_ids(want, {"ids": "negative"}, CONFIG).collect()
    assert {r["pool_idx"]: sorted(r["ids"]) for r in pool} == {r["pool_idx"]: sorted(r["ids"]) for r in tokenized}
    place = {r["negative"]: r["pool_idx"] for r in tokenized if r["negative"] is not None}
    assert placed == {r["pkey"]: (place.get(r["anchor"]), place[r["positive"]]) for r in keyed.collect()}
    options = train.TrainOptions(epochs=1, seed=5, batch_size=2)
    drawn = train.epoch_triplets(keyed, want, options, 1).count()
    _final, history = train.train_epochs(keyed, table.init_token_table(spark, CONFIG, 1), CONFIG, options)
    assert history.first()["steps"] == drawn


def test_the_index_sends_a_query_to_a_bundle_of_clusters_once(spark):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, rng.normal(size=6).tolist()) for i in range(400)], "id long, v array<double>")
    coding = retrieve.dense_encoding(6)
    index = vector_index.build(rows, ["id"], "v", coding, cells=40)
    asked = rows.withColumnRenamed("id", "q")
    sent = vector_index._floored_visits(index, asked, "q", 5, True)
    cells = sent.select("q", F.explode("cells").alias("cell"))
    # Clusters without structure: a query wants many, all of which lie in one bundle.
    assert sent.count() == 400 and cells.count() > 3000 and cells.distinct().count() == cells.count()
    key = lambda found: sorted((r["q"], r["rank"], r["id"], r["score"]) for r in found.collect())
    assert key(vector_index.search(index, asked, "q", 5, True)) == key(retrieve.top_k(asked, "q", rows, ["id"], "v", coding, 5, skip_self=True))


def test_large_clusters_have_bundles_of_their_own():
    cells = vector_index.Cells(np.zeros((5, 1)), np.zeros(5), np.array([3, 90, 4, 2, 6]), np.array([1, 4, 1, 1, 1]))
    first = cells.first_bundles(1, 8).tolist()
    assert first == [0, 2, 0, 1, 1]


def test_candidates_are_bounded_by_the_best_rows_seen():
    coding = retrieve.dense_encoding(3)
    rng = np.random.default_rng(5)
    q, rows = rng.normal(size=(7, 3)), rng.normal(size=(4000, 3)).round(1)
    best, taken = retrieve._Best(7, 4, coding), 0
    for start in range(0, 4000, 500):
        best.add(0, coding.score(q, rows[start : start + 500]), [np.arange(start, start + 500)])
        taken = best.waiting
    scores = np.round(q @ rows.T, 12)
    query, score, key = best.prune()
    for i in range(7):
        want = sorted(range(4000), key=lambda j: (-scores[i, j], j))[:4]
        assert key[query == i].tolist() == want and score[query == i].tolist() == scores[i, want].tolist()
    # Later blocks add only what reaches the floor of the earlier ones; without it each would add four a query.
    assert taken < 8 * 4 * 7


def test_many_folders_are_listed_once_and_by_few_tasks(spark, tmp_path):
    for i in range(150):
        (tmp_path / f"d={i}").mkdir()
        (tmp_path / f"d={i}" / "f").write_text(f"a {i}\nb")
    context = spark.sparkContext
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    context.setJobGroup("listing", "folders")
    found = corpus_ranges.corpus_pieces(spark, str(tmp_path)).collect()
    context.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r["text"] for r in found) == sorted(f"a {i}\nb" for i in range(150))
    tracker = context.statusTracker()
    jobs = [tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup("listing")]
    stages = [tracker.getStageInfo(s) for j in jobs if j for s in j.stageIds]
    # 150 folders used to be 150 tasks, three times.
    assert stages and max(s.numTasks for s in stages if s) <= 32
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before


def test_stretches_of_equal_keys_with_nulls():
    rest = pa.array([None, None, b"x", b"x", b"y", None], pa.binary())
    batch = pa.RecordBatch.from_pydict({"file": ["a", "a", "a", "b", "b", "b"], "rest": rest, "line": pa.array([b"0", b"1", b"2", b"3", b"4", b"5"])})
    found = list(csv_ranges.stretches([batch.slice(0, 0), batch, batch.slice(5)], ("file", "rest")))
    assert found == [(("a", None), True, [b"0", b"1"]), (("a", b"x"), True, [b"2"]), (("b", b"x"), True, [b"3"]), (("b", b"y"), True, [b"4"]), (("b", None), True, [b"5"]), (("b", None), False, [b"5"])]


def test_a_worker_keeps_no_machine_beyond_its_broadcast():
    assert not [name for name, value in vars(pieces).items() if isinstance(value, dict) and not name.startswith("__")]
