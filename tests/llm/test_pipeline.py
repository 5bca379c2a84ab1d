from __future__ import annotations

import numpy as np

import corpus_pipeline
from tests.llm.helpers import frame, prose
from tests.llm.test_dedup import exact_plain, near_plain
from pairloom.llm import decontaminate, pieces, toxicity


def tables(spark, folder):
    rng = np.random.default_rng(21)
    base = prose(rng, 90)
    item = prose(rng, 30)
    rows = [(i, prose(rng, 60) + (" vile insult " if i % 4 == 0 else " ") + prose(rng, 10)) for i in range(160)]
    rows += [(200, base), (201, base.upper()), (202, base + " end"), (203, "x " + item + " y"), (204, None), (205, ""), (206, base + " tail")]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(160)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return rows, item


def test_stages_take_effect_one_after_the_other(spark, tmp_path):
    rows, item = tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    net = toxicity.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = {r.doc_id for r in toxicity.scored(docs, net).where("predicted = 0").collect()}
    rows = [(i, t) for i, t in rows if i in left]
    assert {200, 202, 203, 204} <= left and len(left) < 160
    rows = [(i, t) for (i, t) in rows if (i, True) in {(x[0], x[3]) for x in exact_plain(rows)}]
    rows = [(i, t) for (i, t) in rows if (i, i) in {(x[0], x[2]) for x in near_plain(rows)}]
    rows = [(i, t) for (i, t) in rows if not decontaminate.Finder([(0, decontaminate.normal(item))], 0.08).matches(t)]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.decoded) for r in got) == sorted((i, t or "") for i, t in rows)
    assert {201, 205} <= {r.doc_id for r in got} and not {200, 202, 203, 204, 206} & {r.doc_id for r in got}
    machine = pieces.load()
    assert all(r.ids == machine.encode(r.decoded) for r in got)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path))
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert len(corpus_pipeline.STAGES) == 5
