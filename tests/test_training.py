"""Training with a table that stays dealt, and the rule of one triplet after the other."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import table, train
from pairloom.session import materialize

TRIPLETS = "tid long, anchor string, positive string, negative string"


def some_triplets(spark, count, words, longest=12, seed=8):
    rng = np.random.default_rng(seed)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, words, rng.integers(0, longest)))
    return spark.createDataFrame([(i, text(), text(), text()) for i in range(count)], TRIPLETS)


def one_after_the_other(weights, triplets, rate, margin):
    """NumPy, a triplet at a time."""
    weights, losses = weights.copy(), []
    for t in triplets:
        roles = [np.asarray(t[f"{r}_ids"], dtype=int) for r in train.ROLES]
        if any(len(r) == 0 for r in roles):
            losses.append(0.0)
            continue
        means = [weights[r].mean(axis=0) for r in roles]
        a, p, n = [m / np.linalg.norm(m) if np.linalg.norm(m) else m for m in means]
        loss = margin - a @ p + a @ n
        losses.append(max(loss, 0.0))
        if loss > 0:
            for ids, gradient in zip(roles, (n - p, -a, a)):
                np.subtract.at(weights, ids, gradient * rate / len(ids))
    return weights, losses


@pytest.mark.parametrize("part", [256, 7])
def test_a_dealt_step_is_the_narrow_step(spark, monkeypatch, part):
    config = table.ModelConfig(vocab_size=40, embedding_dim=5, max_seq_len=20)
    triplets = train.tokenize(some_triplets(spark, 60, 50), config)
    start = materialize(table.init_token_table(spark, config, 4))
    monkeypatch.setattr(train, "PART_TRIPLETS", part)
    dealt = train.dealt_table(start, 4)
    outcomes = []
    for step in (train.run_step(triplets, start, config, 0.3, 0.5), train.dealt_step(triplets, dealt.rows, config, 0.3, 0.5)):
        outcomes.append(({r["tid"]: r["loss"] for r in step.losses.collect()}, {r["token_id"]: r["delta"] for r in step.updates.collect()}))
    dealt.forget()
    for one, two in zip(*outcomes):
        assert one.keys() == two.keys() and len(one) > 10
        for key in one:
            assert one[key] == pytest.approx(two[key], abs=1e-12)


def test_the_table_is_neither_moved_nor_broadcast(spark):
    config = table.ModelConfig(vocab_size=64, embedding_dim=4, max_seq_len=20)
    triplets = materialize(train.tokenize(some_triplets(spark, 30, 50), config))
    dealt = train.dealt_table(table.init_token_table(spark, config, 4), int(spark.conf.get("spark.sql.shuffle.partitions")))
    step = train.dealt_step(triplets, dealt.rows, config, 0.3, 0.5, materialize)
    for df in (train.dealt_step(triplets, dealt.rows, config, 0.3, 0.5).losses, train.apply_gradients(dealt.rows.hint("merge"), step.updates)):
        plan = df._jdf.queryExecution().sparkPlan().toString(), df._jdf.queryExecution().executedPlan().toString()
        assert "Bucketed: true" in plan[1] and "Broadcast" not in plan[1]
        lines = plan[1].splitlines()
        scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
        depth = [len(re.match(r"[ :+-]*", line).group()) for line in lines]
        # Nothing between the scan of the table and the join above it is an exchange.
        at, above = scan, []
        while "SortMergeJoin" not in lines[at]:
            at = max(i for i in range(at) if depth[i] < depth[at])
            above.append(lines[at])
        assert not any("Exchange" in line for line in above), above
    dealt.forget()


def test_levels_keep_the_order_of_what_shares_a_token(spark):
    config = table.ModelConfig(vocab_size=300, embedding_dim=4, max_seq_len=20)
    rows = train.conflict_levels(train.tokenize(some_triplets(spark, 80, 200, 5), config)).orderBy("tid").collect()
    used = [{t for r in train.ROLES for t in row[f"{r}_ids"]} for row in rows]
    for i, row in enumerate(rows):
        earlier = [rows[j].level for j in range(i) if used[i] & used[j]]
        assert row.level == 1 + max(earlier, default=0)
    assert train.conflict_levels(train.tokenize(some_triplets(spark, 80, 200, 5), config).limit(0)).count() == 0


def test_sequential_training_is_one_triplet_after_the_other(spark):
    config = table.ModelConfig(vocab_size=20_000, embedding_dim=6, max_seq_len=10)
    rng = np.random.default_rng(3)
    text = lambda: " ".join(f"w{i}" for i in rng.integers(0, 15_000, 4))
    pairs = train.with_pair_key(spark.createDataFrame([(text(), text()) for _ in range(300)], "anchor string, positive string"))
    options = train.TrainOptions(epochs=1, learning_rate=0.3, margin=0.5, seed=5, sequential=True)
    start = table.init_token_table(spark, config, 9)
    final, history = train.train_epochs(pairs, start, config, options)
    keyed = materialize(pairs)
    pool = materialize(train.index_pool(train.pool_of_pairs(keyed), options.seed))
    tokenized = train.tokenize(train.epoch_triplets(keyed, pool, options, 1), config)
    weights, losses = one_after_the_other(table.table_matrix(start, config), tokenized.orderBy("tid").collect(), 0.3, 0.5)
    assert table.table_matrix(final, config) == pytest.approx(weights, abs=1e-9)
    row, active = history.first(), [x for x in losses if x > 0]
    assert (row["steps"], row["active_steps"]) == (300, len(active)) and row["mean_active_loss"] == pytest.approx(np.mean(active), abs=1e-9)
    assert train.conflict_levels(tokenized).agg(F.max("level")).first()[0] <= 30


def test_sequential_windows_follow_each_other(spark, monkeypatch):
    config = table.ModelConfig(vocab_size=50, embedding_dim=3, max_seq_len=10)
    pairs = train.with_pair_key(spark.createDataFrame([(f"a{i} b{i % 3}", f"c{i}") for i in range(7)], "anchor string, positive string"))
    ends = []
    for rows in (3, 100):
        monkeypatch.setattr(train, "SEQUENCE_ROWS", rows)
        options = train.TrainOptions(epochs=1, learning_rate=0.3, margin=0.5, sequential=True)
        ends.append(table.table_matrix(train.train_epochs(pairs, table.init_token_table(spark, config, 2), config, options)[0], config))
    assert ends[0] == pytest.approx(ends[1], abs=1e-9)


def rank_loss_plain(a, p, scale=20.0, own=None):
    scores = a @ p.T * scale
    top = scores.max(axis=1)
    own = (a * p).sum(axis=1) if own is None else own
    return (np.log(np.exp(scores - top[:, None]).sum(axis=1)) + top - own * scale).mean()


def test_rank_loss_of_large_batches_is_merged_over_blocks(spark):
    rng = np.random.default_rng(4)
    batches = {b: (rng.normal(size=(n, 5)), rng.normal(size=(n, 5))) for b, n in ((0, 3), (1, 40), (2, 1), (3, 41))}
    batches[4] = (np.ones((50, 5)) * 30, np.ones((50, 5)) * -30)
    rows = [(b, x.tolist(), y.tolist()) for b, (a, p) in batches.items() for x, y in zip(a, p)]
    df = spark.createDataFrame(rows, "batch long, a array<double>, p array<double>")
    for settings in ({}, {"list_rows": 10, "block_bytes": 800}):
        got = {r["batch"]: (r["size"], r["loss"]) for r in train.inbatch_rank_loss(df, **settings).collect()}
        assert got == {b: (len(a), pytest.approx(rank_loss_plain(a, p), abs=1e-9)) for b, (a, p) in batches.items()}
    assert train.inbatch_rank_loss(df.limit(0)).count() == 0


def test_rank_loss_of_one_batch_of_fifty_thousand(spark):
    """Of few different vectors, so that the plain loss needs no 2.5 billion scores."""
    vector = lambda salt, kinds: F.array(*[(F.pmod(F.xxhash64(F.col("id") % kinds, F.lit(salt + i)), F.lit(2001)) - 1000) / 1000.0 for i in range(8)])
    df = materialize(spark.range(50_000).select(F.lit(7).alias("batch"), "id", vector(0, 40).alias("a"), vector(100, 50).alias("p")))
    got = train.inbatch_rank_loss(df.drop("id"), 3.0, block_bytes=1 << 20).first()
    rows = df.where("id < 200").orderBy("id").toArrow()
    a, p = (np.stack(rows.column(c).to_pylist()) for c in ("a", "p"))
    # Each of the 50 positives stands 1000 times, and the 200 rows are all pairs that occur.
    want = rank_loss_plain(a, p[:50], 3.0, (a * p).sum(axis=1)) + np.log(1000)
    assert got["size"] == 50_000 and got["loss"] == pytest.approx(want, rel=1e-9)
