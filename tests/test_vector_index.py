"""The clustered index gives the answers of scoring everything, and leaves most of it out where clusters allow."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import retrieve, vector_index

ROW = "id bigint, v array<double>"


def plain(queries, corpus, k, skip_self=False):
    out = set()
    for q, a in queries:
        found = sorted((-round(float(np.dot(a, b)), 12), i) for i, b in corpus if not (skip_self and i == q))
        out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(found[:k], start=1)}
    return out


def clustered(rng, count, groups, dim, width):
    centres = rng.normal(size=(groups, dim)) * 4
    return [(i, (centres[i % groups] + rng.normal(size=dim) * width).round(6).tolist()) for i in range(count)]


def searched(spark, corpus, queries, dim, k, **settings):
    skip = settings.pop("skip_self", False)
    coding = retrieve.dense_encoding(dim)
    index = vector_index.build(spark.createDataFrame(corpus, ROW), ["id"], "v", coding, **settings)
    asked = spark.createDataFrame(queries, ROW).withColumnRenamed("id", "q")
    found = {(r.q, r["rank"], r.id, r.score) for r in vector_index.search(index, asked, "q", k, skip).collect()}
    return index, asked, found


@pytest.mark.parametrize("width,block", [(0.05, 1 << 20), (3.0, 800)])
def test_index_equals_scoring_everything(spark, width, block):
    rng = np.random.default_rng(4)
    corpus = clustered(rng, 700, 12, 6, width)
    corpus += [(1000 + i, corpus[3][1]) for i in range(200)]
    queries = [(i, v) for i, v in corpus[:90]] + [(5000, [0.0] * 6), (5001, [1e6] * 6)]
    _index, _asked, got = searched(spark, corpus, queries, 6, 4, block_bytes=block)
    assert got == plain(queries, corpus, 4)
    _index, _asked, got = searched(spark, corpus, queries[:40], 6, 900, block_bytes=block, skip_self=True)
    assert got == plain(queries[:40], corpus, 900, True)


def test_clusters_that_cannot_reach_the_answer_are_left_out(spark):
    rng = np.random.default_rng(6)
    corpus = clustered(rng, 3000, 20, 8, 0.02)
    index, asked, got = searched(spark, corpus, corpus[:100], 8, 5, cells=40)
    assert got == plain(corpus[:100], corpus, 5)
    visits = vector_index.planned_visits(index, asked, "q", 5)
    rows = visits.groupBy("cell").count().collect()
    scored = sum(r["count"] * int(index.cells.rows[r["cell"]]) for r in rows)
    assert sum(index.cells.rows) == 3000 and scored < 0.15 * 100 * 3000


def test_many_queries_of_one_cluster_are_dealt_to_parts(spark, monkeypatch):
    rng = np.random.default_rng(2)
    corpus, queries = clustered(rng, 300, 3, 5, 0.1), [(i, [1.0, 2.0, 0.0, 0.0, float(i % 7)]) for i in range(500)]
    monkeypatch.setattr(vector_index, "BLOCK_BYTES", 400)
    _index, _asked, got = searched(spark, corpus, queries, 5, 2, block_bytes=400)
    assert got == plain(queries, corpus, 2)


def test_broken_and_missing_vectors(spark):
    coding = retrieve.dense_encoding(2)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [0.5, 0.5])], ROW)
    index = vector_index.build(rows, ["id"], "v", coding)
    found = vector_index.search(index, rows.withColumnRenamed("id", "q"), "q", 5).collect()
    assert {(r.q, r.id) for r in found} == {(1, 1), (1, 5), (5, 1), (5, 5)}
    none = vector_index.build(rows.limit(0), ["id"], "v", coding)
    assert vector_index.search(none, rows.withColumnRenamed("id", "q"), "q", 5).count() == 0
    assert vector_index.search(index, rows.limit(0).withColumnRenamed("id", "q"), "q", 5).count() == 0


def test_hashed_texts_through_the_index(spark):
    texts = [(i, " ".join(f"w{(i * j) % 17}" for j in range(1, 9)) if i % 9 else None) for i in range(120)] + [(200, ""), (201, "w1")]
    df = spark.createDataFrame(texts, "id bigint, t string")
    coding = retrieve.hashed_encoding(32)
    index = vector_index.build(df, ["id"], "t", coding, cells=9, block_bytes=2000)
    asked = df.withColumnRenamed("id", "q").where("q < 30 or q >= 200")
    key = lambda found: sorted((r.q, r["rank"], r.id, r.score) for r in found.select("q", "rank", "id", F.round("score", 9).alias("score")).collect())
    assert key(vector_index.search(index, asked, "q", 4)) == key(retrieve.top_k(asked, "q", df, ["id"], "t", coding, 4))
