"""Properties of the physical plans that matter at scale."""

import os
import re

import pytest

import __spark_entry__ as contract
from jobmargin.operators.economics import economics_of, job_economics
from jobmargin.operators.fact import job_fact
from jobmargin.operators.filters import JobFilter
from jobmargin.operators.staging import Staged, stage
from jobmargin.plans import dashboard, pipeline
from jobmargin.sources.sample_binding import bind
from jobmargin.sources.writers import write_parquet
from jobmargin.session import run_folder
from oracles.queries import ORACLES

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")

# These run jobs while they are built (writes, checkpoints); their final plan is a scan.
EAGER = {
    "csv_estimates", "csv_jobs", "csv_invoices", "exported_cities", "published_months", "bottom_jobs",
    "exported_job_fact", "refreshed_tables", "constraint_report", "constraint_report_dirty",
    "crew_summary", "focus_crew", "focus_gaps", "crew_status", "excess_hours", "scenario_grid", "scenario_comparison",
    "scenario_cards", "review_cards", "warning_cards", "evidence_cards", "story_scope", "refreshed_after_change", "rejected_rows",
    "accepted_jobs", "job_detail_pages", "job_economics_copartitioned",
    *(name for name in ORACLES if name.endswith(("_from_cells", "_from_bitmaps")) or name.startswith(("csv_", "exported_"))),
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(text, column):
    return sum(column in line for line in text.splitlines() if "FileScan" in line)


@pytest.mark.parametrize("name", sorted(set(ORACLES) - EAGER))
def test_no_python_no_cross_join_one_labor_scan(spark, name):
    text = plan(contract.queries()[name](spark, SF_DIR))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert scans(text, "l_orderkey") <= 1


def test_key_constraints_store_no_labor(spark):
    text = plan(pipeline.constrained_fact(Staged(bind(spark, SF_DIR))))
    assert scans(text, "l_orderkey") == 0


@pytest.mark.parametrize("name", ["findings", "insights"])
def test_grouping_sets_see_sums_not_jobs(spark, name):
    text = plan(contract.queries()[name](spark, SF_DIR))
    below = text[text.index("Expand") :]
    assert "HashAggregate" in below  # jobs are summed before they are expanded


def test_scan_reads_only_the_columns_used(spark):
    text = plan(contract.queries()["revenue_by_city"](spark, SF_DIR))
    orders = next(line for line in text.splitlines() if "FileScan" in line and "o_orderkey" in line)
    read = re.search(r"ReadSchema: struct<(.*?)>", orders).group(1)
    assert {c.split(":")[0] for c in read.split(",")} == {"o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"}


def test_filters_on_staged_columns_reach_the_files(spark, tmp_path, capsys):
    raw = bind(spark, SF_DIR)["invoices"].selectExpr("* except (paid_date)", "date_add(invoice_date, 5) as paid_date")
    stored = stage("invoices", write_parquet(raw, f"{tmp_path}/invoices"))
    picked = stored.filter("invoice_date >= date'1997-01-01' and job_id < 1000 and invoice_amount > 10 and paid_date < date'1999-01-01'")
    picked.explain("formatted")
    pushed = re.search(r"PushedFilters: \[(.*)\]", capsys.readouterr().out).group(1)
    for column in ("invoice_date", "job_id", "invoice_amount", "paid_date"):
        assert re.search(rf"(GreaterThan|LessThan)\w*\({column},", pushed)


def test_unused_joins_are_dropped(spark):
    run = contract.queries()
    assert scans(plan(run["revenue_by_city"](spark, SF_DIR)), "l_orderkey") == 0  # no labor column needed
    assert scans(plan(run["labor_rollup"](spark, SF_DIR)), "s_suppkey") == 0  # no crew needed
    assert scans(plan(run["quoted_by_month"](spark, SF_DIR)), "part.parquet") == 0


def test_small_dimensions_are_broadcast_without_a_hint(spark):
    text = plan(contract.queries()["crew_dashboard"](spark, SF_DIR))
    assert text.count("BroadcastHashJoin") >= 3 and "SortMergeJoin" not in text


def test_large_sides_are_shuffled_not_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "2k")
    try:
        text = plan(contract.queries()["job_fact"](spark, SF_DIR))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("SortMergeJoin") >= 3
    # partial sums run before labor entries are shuffled, and the join reuses that shuffle
    assert re.search(r"Exchange hashpartitioning\(job_id.*\n.*HashAggregate\(.*partial_sum", text)
    assert len(re.findall(r"Exchange hashpartitioning\(job_id", text)) == 2


def test_filter_prunes_month_partitions(spark, tmp_path):
    fact = write_parquet(job_fact(Staged(bind(spark, SF_DIR))), f"{tmp_path}/fact", partition_by="completed_month")
    picked = dashboard.kpi_totals(contract.NARROW.apply(fact))
    text = plan(picked)
    assert re.search(r"PartitionFilters: \[[^]]*completed_month", text)
    assert re.search(r"PushedFilters: \[[^]]*(GreaterThanOrEqual|In)\(", text)
    assert picked.first()["jobs_completed"] == contract.NARROW.apply(job_fact(Staged(bind(spark, SF_DIR)))).count()


def test_partition_filter_survives_the_default_selection(spark, tmp_path):
    fact = write_parquet(job_fact(Staged(bind(spark, SF_DIR))), f"{tmp_path}/fact", partition_by="completed_month")
    assert JobFilter().apply(fact).count() == fact.count()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["monthly_scorecard", "city_scorecard"])
def test_customers_are_joined_to_sums_not_jobs(spark, no_broadcast, name):
    text = plan(contract.queries()[name](spark, SF_DIR))
    below = text[re.search(r"Exchange hashpartitioning\(customer_id", text).end() :]
    assert below.index("HashAggregate") < below.index("SortMergeJoin")  # summed per key and customer, then exchanged


def test_story_scope_finds_its_month_without_raw_tables(spark):
    text = plan(contract.queries()["story_scope"](spark, SF_DIR))
    assert "o_orderkey" not in text and "l_orderkey" not in text and "PartitionFilters: [" in text


def test_tables_stored_by_job_join_without_an_exchange(spark, no_broadcast):
    folder = run_folder(spark, "by-job")
    staged = Staged(bind(spark, SF_DIR))
    jobs, rollup = pipeline.store_by_job(staged, folder, "by_job_plan", 4)
    joined = job_economics(jobs, rollup)
    assert "SortMergeJoin" in plan(joined) and "Exchange" not in plan(joined)
    assert "Exchange" not in plan(jobs.groupBy("job_id").count())
    want = economics_of(staged)
    assert joined.select(*want.columns).exceptAll(want).count() == 0 and joined.count() == want.count()


def test_a_hot_job_is_one_row_of_the_stored_labor(spark):
    labor = spark.range(9000).selectExpr("if(id % 3 = 0, 1, id) as job_id", "1D as labor_hours", "2D as labor_cost")
    staged = {"jobs": bind(spark, SF_DIR)["jobs"], "job_labor": labor}
    _, rollup = pipeline.store_by_job(staged, run_folder(spark, "by-job"), "by_job_hot", 4)
    hot = rollup.filter("job_id = 1").collect()
    assert [(r["labor_hours_from_detail"], r["labor_cost"]) for r in hot] == [(3001.0, 6002.0)] and rollup.count() == 6000
