"""Every registered query next to its SQL at the smallest scale, and the shape of plans."""

import pytest

import __spark_entry__ as entry
from citeweave.plans import all_oracles, all_queries
from tests.conftest import SMALL
from verify import compare, connect


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("key", sorted(all_queries()))
def test_query_matches_its_sql(spark, con, key):
    assert compare(spark, con, SMALL, key).startswith(("ok", "rows only"))


def test_oracles_belong_to_queries():
    assert set(all_oracles()) <= set(all_queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("key", ["phrase_matches", "gate_audit", "hybrid_search", "retrieval_scores", "case_validation", "sync_apply", "children_in_order"])
def test_plans_have_no_nested_loops(spark, key):
    plan = all_queries()[key](spark, SMALL)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_only_the_columns_they_need(spark):
    plan = all_queries()["top_buckets"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "props" not in plan and "PushedFilters: [IsNotNull(ts)" in plan
