from __future__ import annotations

import json
import os

import pytest

from pairloom import session
from pairloom.operators import table, train
from pairloom.plans import jobs
from pairloom.plans.profiles import DUPLICATES, LABELED, Profile
from pairloom.sources import files

FILTERS = {"min_chars": 3, "min_words": 1}
PAIRS = Profile("pairs", LABELED, columns={"left": "q1", "right": "q2", "label": "dup"}, filters=FILTERS)
TEXTS = Profile("texts", DUPLICATES, columns={"text": "title"}, filters={**FILTERS, "require_question_mark": True})


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text.encode())
    return str(path)


def test_csv_quotes_newlines_and_ragged_rows(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'q1,q2,dup\n"He said ""hi, you"" now","two\nlines",1\nshort row,only\n"x","y",1.0\n')
    rows = files.read_csv_text(spark, path).collect()
    assert [tuple(r) for r in rows] == [('He said "hi, you" now', "two\nlines", "1"), ("short row", "only", ""), ("x", "y", "1.0")]
    assert files.read_csv_text(spark, path, ["dup"]).columns == ["dup"]
    with pytest.raises(ValueError, match="Dup"):
        files.read_csv_text(spark, path, ["Dup"])


def test_discovery_prefers_the_name_then_the_first_csv(spark, tmp_path):
    for name in ("b/train.csv", "a/other.csv", "a/notes.txt"):
        write(tmp_path / name, "x\n1\n")
    assert files.discover_csv(spark, str(tmp_path), "train.csv").endswith("b/train.csv")
    assert files.discover_csv(spark, str(tmp_path), "absent.csv").endswith("a/other.csv")
    assert files.discover_csv(spark, str(tmp_path)).endswith("a/other.csv")
    empty = tmp_path / "a" / "empty"
    empty.mkdir()
    with pytest.raises(FileNotFoundError):
        files.discover_csv(spark, str(empty))


def test_whole_file_corpus(spark, tmp_path):
    path = write(tmp_path / "book.txt", "intro\r\n*** START OF THE PROJECT GUTENBERG EBOOK B ***\r\nbody\rend\n*** END OF THE PROJECT GUTENBERG EBOOK B ***\n")
    assert files.read_corpus(spark, path).first()["text"] == "body\nend\n"


def test_result_files_and_missing_task(spark, tmp_path):
    body = {"task_name": "SciFact", "dataset_revision": "r", "evaluation_time": 2.5, "scores": {"test": [{"main_score": 0.5, "ndcg_at_10": 0.4}, {"main_score": 9}]}}
    write(tmp_path / "m" / "SciFact.json", json.dumps(body, indent=1))
    expected = spark.createDataFrame([("SciFact",), ("FiQA2018",)], "task_name string")
    got = {r["task_name"]: r for r in files.read_ir_results(spark, str(tmp_path), expected).collect()}
    assert got["SciFact"]["main_score"] == 0.5 and got["SciFact"]["error"] is None and got["SciFact"]["map_at_10"] is None
    assert got["FiQA2018"]["error"] == "result_json_not_found"


def labeled(spark):
    rows = [(f"text number {i}", f"other text {i % 5}", "1" if i % 3 else " 0") for i in range(30)] + [("same here", "SAME here!", "1"), ("", "x", "1")]
    return spark.createDataFrame(rows, "q1 string, q2 string, dup string")


def test_prepare_job_writes_consistent_outputs(spark, tmp_path):
    out = str(tmp_path / "out")
    meta = jobs.prepare_job(spark, labeled(spark), PAIRS, out, jobs.PrepareOptions(max_train_pairs=12, max_eval_triplets=5, seed=1), "mem").first()
    assert (meta["rows_after_cleaning"], meta["train_pairs"], meta["eval_triplets"]) == (31, 12, 5)
    assert meta["positive_pairs"] == 20 and meta["negative_pool_size"] == 5
    kept = {tuple(r) for r in files.read_pairs(spark, f"{out}/train_pairs").collect()}
    triplets = files.read_triplets(spark, f"{out}/eval_triplets").collect()
    assert len(kept) == 12 and all((t["anchor"], t["positive"]) in kept for t in triplets)
    assert all(t["negative"] not in (t["anchor"], t["positive"]) for t in triplets)


def test_markup_variant_keeps_self_pairs(spark):
    a, b = (jobs.mine(labeled(spark), PAIRS, 3, 1, v).positives.where("anchor = positive").count() for v in ("ascii", "markup"))
    assert (a, b) == (0, 1)


def test_duplicate_profile_and_errors(spark, tmp_path):
    asked = spark.createDataFrame([("Why so late?",)] * 3 + [("why so  late? ",), ("why so late",), ("Who is it?",)], "title string")
    mined = jobs.mine(asked, TEXTS, 3, 1)
    assert mined.positives.count() == 3 and mined.pool.count() == 2
    markup = jobs.mine(asked, TEXTS, 3, 1, "markup")
    assert markup.positives.count() == 1
    with pytest.raises(ValueError, match="unknown kind"):
        jobs.mine(asked, Profile("x", "other"), 3, 1)
    with pytest.raises(ValueError, match="no positive pair"):
        jobs.prepare_job(spark, asked.distinct().limit(1), TEXTS, str(tmp_path / "e"), jobs.PrepareOptions())


def test_pipeline_job_and_reuse_of_its_model(spark, tmp_path):
    config = table.ModelConfig(vocab_size=64, embedding_dim=8, max_seq_len=16)
    prepare = jobs.PrepareOptions(max_train_pairs=12, max_eval_triplets=5, seed=1)
    first = jobs.pipeline_job(spark, labeled(spark), PAIRS, str(tmp_path / "one"), config, prepare, train.TrainOptions(epochs=1)).first()
    again = jobs.pipeline_job(
        spark, labeled(spark), PAIRS, str(tmp_path / "two"), config, prepare, train.TrainOptions(), True, str(tmp_path / "one" / "model")
    ).first()
    assert tuple(first) == pytest.approx(tuple(again), abs=1e-9)
    assert 0.0 <= first["triplet_accuracy"] <= 1.0
    assert first["mean_margin"] == pytest.approx(first["mean_positive_similarity"] - first["mean_negative_similarity"])


def test_a_finished_chain_leaves_no_scratch_tables(spark, tmp_path, monkeypatch):
    config = table.ModelConfig(vocab_size=64, embedding_dim=8, max_seq_len=16)
    prepare, options = jobs.PrepareOptions(seed=1), train.TrainOptions(epochs=2, batch_size=4)
    monkeypatch.setattr(session, "scratch_root", lambda _spark: str(tmp_path / "scratch"))
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key, None)
    jobs.pipeline_job(spark, labeled(spark), PAIRS, str(tmp_path / "chain"), config, prepare, options, source_key="x")
    # Pairs, pools and triplets used to stay.
    assert [name.split("-")[0] for name in os.listdir(tmp_path / "scratch")] == ["trained"]
    assert spark.conf.get(key, None) == setting
    used_up = spark.createDataFrame([("one text", "two text", "1"), ("third", "two text", "0")], labeled(spark).schema)
    with pytest.raises(ValueError, match="uses up the negative pool"):
        jobs.prepare_job(spark, used_up, PAIRS, str(tmp_path / "none"), prepare)
    assert not (tmp_path / "none" / "eval_triplets").exists()


def test_both_ways_of_evaluating_a_model_agree(spark, monkeypatch):
    config = table.ModelConfig(vocab_size=64, embedding_dim=8, max_seq_len=16)
    start = table.init_token_table(spark, config, 3)
    rows = [("a b", "b c", "x y")] * 3 + [("q r", "s", "t u"), (" ", "b", "c")]
    triplets = spark.createDataFrame(rows, "anchor string, positive string, negative string")
    narrow = tuple(jobs.evaluate_model(triplets, start, config).first())
    monkeypatch.setattr(jobs, "fits_broadcast", lambda _config: False)
    assert tuple(jobs.evaluate_model(triplets, start, config).first()) == pytest.approx(narrow, abs=1e-12)


def test_retrieval_quality_on_a_tiny_corpus_wraps_around(spark):
    words = [f"{c}{d}word" for c in "abcdefghij" for d in "klmnopqrst"]
    docs = spark.createDataFrame([(i, " ".join(words[i * 20 : i * 20 + 20])) for i in range(5)] + [(9, "short")], "id long, body string")
    got = jobs.retrieval_quality(docs, "id", "body", query_count=32, window=10, stride=10).first()
    assert got["eval_count"] == 10 and got["top1_accuracy"] == 1.0
    assert got["separation"] == pytest.approx(got["mean_positive_similarity"] - got["mean_negative_similarity"])


def test_a_broken_run_goes_on_at_the_first_unfinished_stage(spark, tmp_path, monkeypatch):
    config = table.ModelConfig(vocab_size=64, embedding_dim=8, max_seq_len=16)
    prepare, options = jobs.PrepareOptions(max_eval_triplets=5, seed=1), train.TrainOptions(epochs=2, batch_size=8)
    run = lambda out, **more: tuple(jobs.pipeline_job(spark, labeled(spark), PAIRS, str(tmp_path / out), config, prepare, more.pop("options", options), **more).first())
    whole = run("whole")

    def broken(*args, **kwargs):
        # Leaves half an output behind.
        files.write_report(spark.range(1), f"{args[3]}/model/token_embeddings")
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(jobs, "train_job", broken)
        with pytest.raises(RuntimeError, match="lost"):
            run("again")
    with monkeypatch.context() as patch:
        patch.setattr(jobs, "prepare_job", broken)
        assert run("again") == pytest.approx(whole, abs=1e-9)
        assert [d.path for d in jobs.stages.finished(spark, str(tmp_path / "again"), "train")] == [f"{tmp_path}/again/train-2"]
        patch.setattr(jobs, "train_job", broken)
        assert run("again") == run("again", skip_train=True) == pytest.approx(whole, abs=1e-9)
        with pytest.raises(RuntimeError, match="lost"):
            run("again", options=train.TrainOptions(epochs=1))


def test_other_content_is_another_source(spark):
    one, two = spark.createDataFrame([("a", 1), ("b", None)], "x string, y int"), spark.createDataFrame([("b", None), ("a", 1)], "x string, y int")
    key = jobs.stages.content_key
    assert key(one) == key(two) != key(one.unionByName(two)) and key(one.limit(0)) != key(one)
