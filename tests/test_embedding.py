from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import vectors as V
from pairloom.operators import hashed, metrics, passages, retrieve, table, train
from pairloom.session import materialize
from pairloom.sources import models

SMALL = table.ModelConfig(vocab_size=128, embedding_dim=16, max_seq_len=16)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def embeddings(df):
    return {r["id"]: np.array(r["embedding"]) for r in df.collect()}


def test_hash_embedding_contract(spark):
    got = embeddings(hashed.hash_embed(frame(spark, ["Deterministic output", "deterministic  output", "", None, "normalization check"]), "text"))
    assert all(len(v) == 512 for v in got.values())
    assert np.array_equal(got[0], got[1])
    assert not got[2].any() and not got[3].any()
    assert np.linalg.norm(got[4]) == pytest.approx(1.0, abs=1e-6)


def test_wide_frame_shape(spark):
    wide = hashed.hash_embed_wide(frame(spark, ["first sample", "second sample"]), "text")
    assert wide.count() == 2 and len(wide.columns) == 513


def test_normalize_and_masked_pool(spark):
    row = spark.range(1).select(V.l2_normalize(F.array(F.lit(3.0), F.lit(4.0))).alias("v"), V.l2_normalize(F.array(F.lit(0.0))).alias("z")).first()
    assert row["v"] == pytest.approx([0.6, 0.8]) and row["z"] == [0.0]
    rows = [(1, 1, [1.0, 2.0]), (1, 0, [999.0, 999.0]), (1, 1, [5.0, 6.0]), (2, 0, [7.0, 7.0])]
    df = spark.createDataFrame(rows, "id long, m int, vec array<double>")
    got = embeddings(table.masked_mean_pool(df, ["id"], "m", 2))
    assert got[1].tolist() == [3.0, 4.0] and got[2].tolist() == [0.0, 0.0]


@pytest.mark.parametrize("plain_dims", [64, 1])
def test_batch_scoring_equals_relational_embedding(spark, monkeypatch, plain_dims):
    monkeypatch.setattr(table, "_PLAIN_SUM_DIMS", plain_dims)
    texts = ["what is rust ownership", "", "--- !!!", "a a a b", "w " * 40, "x y​z"]
    start = materialize(table.init_token_table(spark, SMALL, 19))
    relational = embeddings(table.embed_table(frame(spark, texts), ["id"], "text", start, SMALL))
    batched = embeddings(table.embed_batches(frame(spark, texts), "text", start, SMALL))
    assert relational.keys() == batched.keys()
    for key in relational:
        assert relational[key] == pytest.approx(batched[key], abs=1e-12)
    assert not relational[1].any()


def test_sequence_limit_and_unknown_tokens(spark):
    config = table.ModelConfig(vocab_size=50, embedding_dim=4, max_seq_len=3)
    got = table.token_ids(frame(spark, ["one -- Two three four", "  "]), "text", config).orderBy("position").collect()
    assert len(got) == 3 and got[1]["token_id"] == table.UNKNOWN_ID
    assert all(2 <= r["token_id"] < 50 for r in (got[0], got[2]))


def test_model_round_trip_and_checks(spark, tmp_path):
    start = materialize(table.init_token_table(spark, SMALL, 19))
    models.save_model(start, SMALL, str(tmp_path / "m"))
    loaded, config = models.load_model(spark, str(tmp_path / "m"))
    assert config == SMALL
    df = frame(spark, ["round trip test"])
    before, after = (embeddings(table.embed_table(df, ["id"], "text", t, SMALL))[0] for t in (start, loaded))
    assert np.array_equal(before, after)
    models.save_model(start.where("token_id <> 5"), SMALL, str(tmp_path / "short"))
    with pytest.raises(ValueError):
        models.load_model(spark, str(tmp_path / "short"))
    with pytest.raises(ValueError):
        table.ModelConfig(vocab_size=2)


def test_top_k_blocks_ties_and_orientation(spark, monkeypatch):
    rng = np.random.default_rng(2)
    vecs = rng.integers(-2, 3, (90, 6)).astype(float)
    rows = [(i, v.tolist()) for i, v in enumerate(vecs)]
    corpus = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    queries = corpus.where("id < 25").withColumnRenamed("id", "q")
    scores = vecs[:25] @ vecs.T
    want = {q: sorted(range(90), key=lambda j: (-scores[q, j], j))[:4] for q in range(25)}
    for block in (64 << 20, 400):
        monkeypatch.setattr(retrieve, "HELD_BLOCK_BYTES", block)
        for hold in ("queries", "corpus"):
            got = retrieve.top_k(queries, "q", corpus, ["id"], "v", retrieve.dense_encoding(6), 4, hold).orderBy("q", "rank").collect()
            found: dict[int, list[int]] = {}
            for r in got:
                found.setdefault(r["q"], []).append(r["id"])
            assert found == want
    alone = retrieve.top_k(queries, "q", corpus, ["id"], "v", retrieve.dense_encoding(6), 1, skip_self=True).collect()
    assert all(r["q"] != r["id"] for r in alone) and len(alone) == 25


def test_zero_score_queries_pick_the_first_passage(spark):
    corpus = spark.createDataFrame([(5, "alpha beta"), (3, "gamma delta"), (9, "epsilon")], "id long, t string")
    queries = spark.createDataFrame([(0, "")], "q long, t string")
    assert retrieve.top_k(queries, "q", corpus, ["id"], "t", retrieve.hashed_encoding(64), 1).first()["id"] == 3


def _numpy_step(weights, ids, rate, margin):
    def embed(tokens):
        mean = weights[tokens].mean(axis=0)
        size = np.linalg.norm(mean)
        return mean / size if size else mean

    a, p, n = (embed(t) for t in ids)
    loss = margin - a @ p + a @ n
    if loss <= 0:
        return weights, 0.0
    new = weights.copy()
    for tokens, grad in zip(ids, (n - p, -a, a)):
        for token in tokens:
            new[token] -= rate / len(tokens) * grad
    return new, loss


def test_training_in_batches_of_one_is_the_sequential_rule(spark):
    config = table.ModelConfig(vocab_size=40, embedding_dim=6, max_seq_len=8)
    pairs = spark.createDataFrame([("red fox runs", "fox runs home"), ("blue sky", "sky is blue"), ("cold tea", "hot tea tea")], "anchor string, positive string")
    options = train.TrainOptions(epochs=2, learning_rate=0.3, margin=0.5, batch_size=1, seed=3)
    keyed = materialize(train.with_pair_key(pairs))
    start = materialize(table.init_token_table(spark, config, 4))
    final, history = train.train_epochs(keyed, start, config, options)
    weights = table.table_matrix(start, config)
    pool = materialize(train.index_pool(train.pool_of_pairs(keyed), options.seed))
    for row in history.orderBy("epoch").collect():
        triplets = train.tokenize(train.epoch_triplets(keyed, pool, options, row["epoch"]), config).orderBy("tid").collect()
        losses = []
        for t in triplets:
            weights, loss = _numpy_step(weights, [t["anchor_ids"], t["positive_ids"], t["negative_ids"]], 0.3, 0.5)
            losses.append(loss)
        active = [x for x in losses if x > 0]
        assert (row["steps"], row["active_steps"]) == (3, len(active))
        assert row["mean_active_loss"] == pytest.approx(np.mean(active) if active else 0.0, abs=1e-9)
    assert table.table_matrix(final, config) == pytest.approx(weights, abs=1e-9)


def test_narrow_and_relational_steps_agree(spark, monkeypatch):
    config = table.ModelConfig(vocab_size=30, embedding_dim=5, max_seq_len=20)
    rng = np.random.default_rng(8)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 40, rng.integers(0, 12)))
    rows = [(i, text(), text(), text()) for i in range(50)]
    triplets = spark.createDataFrame(rows, "tid long, anchor string, positive string, negative string")
    start = materialize(table.init_token_table(spark, config, 4))

    def outcome():
        step = train.run_step(train.tokenize(triplets, config), start, config, 0.3, 0.5)
        losses = {r["tid"]: r["loss"] for r in step.losses.collect()}
        return losses, {r["token_id"]: r["delta"] for r in step.updates.collect()}

    monkeypatch.setattr(train, "SLICE_TOKENS", 25)
    narrow = outcome()
    monkeypatch.setattr(train, "fits_broadcast", lambda _config: False)
    relational = outcome()
    assert narrow[0].keys() == relational[0].keys() and narrow[1].keys() == relational[1].keys()
    assert any(narrow[0].values()) and not all(narrow[0].values())
    for one, two in zip(narrow, relational):
        for key in one:
            assert one[key] == pytest.approx(two[key], abs=1e-12)


def test_hard_triplet_has_loss_and_empty_text_has_none(spark):
    config = table.ModelConfig(vocab_size=128, embedding_dim=32, max_seq_len=16)
    rows = [(0, "what is rust ownership", "best chocolate cake recipe", "what is rust ownership"), (1, " ", "a b", "c d"), (2, " ", " ", " ")]
    df = spark.createDataFrame(rows, "tid long, anchor string, positive string, negative string")
    got = {r["tid"]: r["loss"] for r in train.triplet_loss(df, table.init_token_table(spark, config, 13), config, 0.2).collect()}
    assert got[0] > 0 and got[1] == 0 and got[2] == 0


def test_empty_metrics_are_zero(spark):
    none = spark.createDataFrame([], "positive_sim double, negative_sim double")
    assert tuple(metrics.triplet_metrics(none).first()) == (0.0, 0.0, 0.0, 0.0)
    empty = spark.createDataFrame([], "tid long, loss double")
    assert tuple(train.epoch_summary(empty).first()) == (0, 0, 0.0)


def test_ranking_metrics_by_hand(spark):
    ranked = spark.createDataFrame([("q", 1, 0), ("q", 2, 1), ("q", 3, 1), ("z", 1, 0)], "query string, rank long, relevant int")
    totals = spark.createDataFrame([("q", 3), ("z", 2), ("none", 0), ("missing", 1)], "query string, total_relevant long")
    got = {r["query"]: r for r in metrics.ir_metrics_per_query(ranked, totals, "query").collect()}
    assert set(got) == {"q", "z", "missing"}
    ideal = 1 + 1 / np.log2(3) + 0.5
    assert got["q"]["ndcg_at_10"] == pytest.approx((1 / np.log2(3) + 0.5) / ideal)
    assert got["q"]["map_at_10"] == pytest.approx((1 / 2 + 2 / 3) / 3)
    assert got["q"]["recall_at_10"] == pytest.approx(2 / 3) and got["q"]["mrr_at_10"] == 0.5
    assert got["z"]["mrr_at_10"] == 0 and got["missing"]["ndcg_at_10"] == 0


def test_inbatch_loss_matches_numpy(spark):
    rng = np.random.default_rng(5)
    a, p = rng.normal(size=(4, 3)), rng.normal(size=(4, 3))
    df = spark.createDataFrame([(0, x.tolist(), y.tolist()) for x, y in zip(a, p)], "batch long, a array<double>, p array<double>")
    logits = a @ p.T * 20
    want = np.mean(np.log(np.exp(logits - logits.max(1, keepdims=True)).sum(1)) + logits.max(1) - np.diag(logits))
    assert train.inbatch_rank_loss(df).first()["loss"] == pytest.approx(want)


def test_passage_windows(spark):
    text = " ".join(f"w{i}" for i in range(10))
    df = spark.createDataFrame([(1, text), (2, "too short"), (3, "a b c d")], "id long, text string")
    got = passages.sliding_passages(df, "text", 4, 3).orderBy("id", "window").collect()
    assert [(r["id"], r["window"], r["passage"].split()[0]) for r in got] == [(1, 0, "w0"), (1, 1, "w3"), (1, 2, "w6"), (3, 0, "a")]
    assert passages.sliding_passages(df, "text", 4, 3, 2).count() == 3
    numbered = passages.number_passages(df, "id", "text", 4, 3).orderBy("passage_id").collect()
    assert [(r["passage_id"], r["id"], r["window"]) for r in numbered] == [(0, 1, 0), (1, 1, 1), (2, 1, 2), (3, 3, 0)]
    head, found = passages.leading_passages(df, "id", "text", 4, 4, 3)
    assert found == 4 and head.count() == 4
