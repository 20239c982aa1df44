"""Every registered query against its SQL counterpart, and the shape of the plans."""

import pytest

import __spark_entry__ as entry
from larkspur.plans import registered
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = registered.QUERIES, registered.ORACLES


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert name in ORACLES
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], SF) is None


def test_entry(spark):
    assert QUERIES.keys() <= entry.queries().keys() and ORACLES.keys() <= entry.oracle_sql().keys()
    assert entry.entry(spark).count() > 0


SAMPLES = ("l1_listing_search", "a7_usage_by_date", "a12_user_stats", "j3_company_domain", "j4_loaded_comments", "f9_allowed_pages", "j8_user_activity")


@pytest.mark.parametrize("name", SAMPLES)
def test_no_cross_joins(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_are_pruned(spark):
    plan = QUERIES["a10_vote_state"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema: ")[1].split(">")[0]
    assert "PushedFilters: [In(event_type" in plan
