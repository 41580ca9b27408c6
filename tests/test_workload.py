from __future__ import annotations

import pytest

from check import compare
from __spark_entry__ import entry, oracle_sql, queries
from sortflow.workload import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
ROWS_ONLY = set()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), SF, ORACLES[name]) is None


def test_all_other_queries_are_known():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_entry_learns_the_categories(spark):
    report = {r.label: r for r in entry(spark).collect()}
    assert report["accuracy"].precision > 0.8


def test_hybrid_scores_every_document(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    records = queries()["hybrid_classify"](spark, SF)
    assert records.count() == docs
    assert records.where("not ok").count() == 0
    assert queries()["score_batch"](spark, SF).where("known and in_range").count() == docs
