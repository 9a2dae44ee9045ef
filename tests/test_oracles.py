"""Every registered query against its SQL on the smallest test tables."""

import os

import pytest

import __spark_entry__ as contract
from oracles.queries import ORACLES
from tests.oracle_check import connect, differences

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert set(contract.queries()) >= set(ORACLES)
    assert set(contract.oracle_sql()) - set(ORACLES) <= set(contract.queries())


@pytest.mark.parametrize("name", ORACLES)
def test_query_agrees_with_sql(spark, duck, name):
    assert differences(spark, duck, SF_DIR, name) == []


def test_entry_has_rows(spark):
    assert contract.entry(spark).count() > 0


def test_queries_exercise_what_they_claim(spark, duck):
    """The dirty tables hold every kind of defect; the sparse selection has empty months."""
    run = contract.queries()
    gate = {r["check_name"]: r["violations"] for r in run["quality_gate_dirty"](spark, SF_DIR).collect()}
    assert gate == {
        "job_id_unique": 3, "job_id_not_null": 0, "revenue_non_negative": 4, "margin_reasonable": 39,
        "crew_ids_present": 9,
    }
    sparse = run["monthly_trend_sparse"](spark, SF_DIR)
    assert sparse.filter("revenue = 0").count() > 0
    assert run["scenario_grid"](spark, SF_DIR).count() == 770
    focus = run["focus_crew"](spark, SF_DIR).first()
    want = duck.execute(f"select crew_name, avg_labor_variance from ({ORACLES['focus_crew']})").fetchone()
    assert (focus["crew_name"], focus["avg_labor_variance"]) == want and want[0] == "Crew ASIA"
