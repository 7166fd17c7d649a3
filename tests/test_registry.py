"""Every registered query against its SQL on the smallest data."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect
from conftest import SMALL
from moundlens.checks.oracles import all_oracles
from moundlens.checks.queries import all_queries

QUERIES, ORACLES = all_queries(), all_oracles()
# fits of trees, and grids of 10,000 cells a group (held against dense sums in test_studies)
WITHOUT_SQL = {
    "train_swing_model", "score_swing", "feature_selection", "location_density_full", "location_hdr_full",
}
SLOW = {"model_roundtrip"}  # covered by test_models


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_only_named_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


UNWANTED = ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas")


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_sql_and_plans_well(spark, con, name):
    result = QUERIES[name](spark, SMALL)
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert [node for node in UNWANTED if node in plan] == []
    assert compare(result, con, ORACLES[name]) == ""
