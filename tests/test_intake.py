"""Malformed rows set aside, grid counts, pages by key, and the gate counted while the fact is written."""

import pytest
from pyspark.sql import Observation, functions as F

from jobmargin.functions.ratios import expressions
from jobmargin.operators.fact import job_fact
from jobmargin.operators.intake import checked, take_in
from jobmargin.operators.quality import OBSERVED, observed_gate, quality_gate
from jobmargin.operators.staging import Staged, stage
from jobmargin.plans import dashboard, pipeline
from jobmargin.sources.schemas import RAW_TABLES
from jobmargin.sources.writers import write_parquet
from tests.edge_data import raw_table, raw_tables
from tests.test_plans import plan


def test_malformed_rows_are_set_aside(spark, tmp_path):
    rows = [
        {"job_id": "1"}, {"job_id": "2", "billed_revenue": "12d", "completed_date": "2025-13-01"}, {"job_id": " x "},
        {"job_id": "4", "customer_rating": ""}, {"job_id": "5", "estimate_id": "none", "customer_rating": None}, {"job_id": None},
    ]
    taken = take_in("jobs", raw_table(spark, "jobs", *rows), str(tmp_path))
    assert sorted(map(tuple, taken.rejected.collect())) == [
        ("jobs", "2", "billed_revenue", "12d", "not a double"), ("jobs", "2", "completed_date", "2025-13-01", "not a date"),
        ("jobs", "4", "customer_rating", "", "blank"), ("jobs", "x", "job_id", "x", "not a key"),
    ]
    good = [r["job_id"] for r in taken.accepted.orderBy("job_id").collect()]
    assert good == [None, 1, 5] and taken.accepted.filter("job_id = 5").first()["estimate_id"] is None


@pytest.mark.parametrize("table", RAW_TABLES)
def test_good_rows_are_what_strict_staging_gives(spark, tmp_path, table):
    raw = raw_table(spark, table, {}, {})
    taken = take_in(table, raw, str(tmp_path))
    assert taken.accepted.dtypes == stage(table, raw).dtypes
    assert taken.accepted.collect() == stage(table, raw).collect() and taken.rejected.count() == 0


def test_the_raw_table_is_read_once(spark, tmp_path):
    raw = write_parquet(raw_table(spark, "jobs", {}, {"job_id": "x"}), f"{tmp_path}/raw")
    taken = take_in("jobs", raw, str(tmp_path))
    for df in (taken.accepted, taken.rejected):
        assert f"{tmp_path}/raw" not in plan(df) and "PartitionFilters: [isnotnull(is_good" in plan(df)
    assert "Exchange" not in plan(checked("jobs", raw))


def test_typed_tables_have_no_faults(spark, tmp_path):
    raw = stage("crews", raw_table(spark, "crews", {}))
    assert take_in("crews", raw, str(tmp_path)).rejected.count() == 0


def points(spark, rows):
    return spark.createDataFrame(rows, "billed_revenue double, gross_margin_pct double")


def test_grid_counts(spark):
    found = dashboard.job_value_margin_bins(points(spark, [(0.0, -1.0), (10.0, 1.0), (5.0, 0.0), (9.99, 0.99), (None, 1.0), (3.0, None)]), 10, 4)
    got = {(r["value_bin"], r["margin_bin"]): (r["jobs"], r["value_from"], r["margin_from"]) for r in found.collect()}
    assert got == {(0, 0): (1, 0.0, -1.0), (9, 3): (2, 9.0, 0.5), (5, 2): (1, 5.0, 0.0)}
    same = dashboard.job_value_margin_bins(points(spark, [(2.0, 0.5)] * 7)).collect()
    assert [tuple(r) for r in same] == [(0, 0, 2.0, 0.5, 7)]
    assert dashboard.job_value_margin_bins(points(spark, [])).collect() == []
    many = spark.range(20_000).selectExpr("double(id * 7919 % 1000) as billed_revenue", "double(id % 997) as gross_margin_pct")
    grid = dashboard.job_value_margin_bins(many, 8, 5)
    assert grid.count() <= 40 and grid.agg(F.sum("jobs")).first()[0] == 20_000


def test_pages_put_together_are_the_whole(spark):
    rows = [{"job_id": str(i), "billed_revenue": None if i % 11 == 0 else str(40 + i % 5)} for i in range(1, 60)]
    fact = job_fact(Staged(raw_tables(spark, jobs=rows))).cache()
    whole = [r["job_id"] for r in dashboard.job_detail(fact, "job_id").collect()]
    seen, key = [], None
    while True:
        page = dashboard.job_page(fact, key, 7)
        rows = page.collect()
        assert [r["job_id"] for r in rows] == whole[len(seen) : len(seen) + 7]
        seen += [r["job_id"] for r in rows]
        key = dashboard.next_page(page)
        if key is None:
            break
    assert seen == whole and None in {r["gross_profit"] for r in fact.select("gross_profit").collect()}
    text = plan(dashboard.job_page(fact, (3.0, 7), 7))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text
    fact.unpersist()


@pytest.mark.parametrize("jobs, customers", [
    ([{}], [{}]),
    ([{"billed_revenue": "-5"}, {"job_id": "2", "crew_id": "9"}, {"job_id": None}, {"job_id": "2"}], [{}]),
    ([{}, {"job_id": "2"}], [{}, {}]),  # a customer given twice doubles both jobs
])
def test_the_gate_counted_on_the_way_says_the_same(spark, tmp_path, jobs, customers):
    staged = Staged(raw_tables(spark, jobs=jobs, customers=customers))
    seen = Observation()
    fact = write_parquet(job_fact(staged), f"{tmp_path}/fact", "completed_month", (seen, expressions(OBSERVED)))
    want = sorted(map(tuple, quality_gate(fact).collect()))
    assert sorted(map(tuple, observed_gate(staged["jobs"], seen.get).collect())) == want


def test_the_gate_reads_no_fact(spark, tmp_path):
    raw = {name: write_parquet(df, f"{tmp_path}/{name}") for name, df in raw_tables(spark).items()}
    gate = observed_gate(Staged(raw)["jobs"], dict.fromkeys(OBSERVED, 0))
    assert "ReadSchema: struct<job_id:string>" in plan(gate) and pipeline.FACT not in plan(gate)
