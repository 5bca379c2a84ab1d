from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from pairloom.plans import queries
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"
# The quick part of the side-by-side check; tests/check_oracles.py runs all of it.
CHECKED = "clean_ascii mine_duplicates negatives_reject hash_embed embed_batch_udf retrieve_topk train_step latency_linear".split()


def test_every_query_has_sql():
    assert set(queries.all_queries()) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(entry.oracle_sql()[name]).df()) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_entry_gives_one_row(spark):
    assert entry.entry(spark).count() == 1
