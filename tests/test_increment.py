"""Incremental refresh, selection cells and customer bitmaps against full computations."""

import os
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from jobmargin.functions.measures import REGISTRY
from jobmargin.operators.cells import CELL_STATES, job_cells
from jobmargin.operators.distinct import count_customers, customer_bits, selected_customers
from jobmargin.operators.fact import job_fact
from jobmargin.operators.filters import JobFilter, NoMatchingJobs, require_jobs, selection_state
from jobmargin.operators.staging import Staged, stage
from jobmargin.plans import dashboard, increment
from jobmargin.plans.scorecards import SCORECARDS
from jobmargin.sources.writers import write_parquet
from tests.edge_data import raw_tables
from tests.test_plans import SF_DIR, plan


def jobs(**dates):
    return [{"job_id": k[1:], "completed_date": v, "customer_id": str(1 + int(k[1:]) % 3)} for k, v in dates.items()]


def tables(spark, rows):
    customers = [{"customer_id": "1"}, {"customer_id": "2", "customer_name": "Bo"}]
    return raw_tables(spark, jobs=rows, customers=customers)


def rows_of(df, columns=None):
    return sorted(map(str, df.select(*(columns or df.columns)).collect()))


def check(spark, folder, now):
    """The live folder holds what a full build of ``now`` would."""
    fact = job_fact(Staged(now))
    assert rows_of(increment.live(spark, folder, "job_fact"), fact.columns) == rows_of(fact)
    cells, bits = (increment.live(spark, folder, name) for name in ("job_cells", "customer_bits"))
    for name, card in SCORECARDS.items():
        assert rows_of(increment.scorecard_from_state(name, cells, bits)) == rows_of(card.over(fact)), name


def files_of(folder, name):
    found = {}
    for path, _, files in os.walk(f"{folder}/live/{name}"):
        found.update({f"{path}/{f}": os.stat(f"{path}/{f}").st_mtime_ns for f in files if f.endswith(".parquet")})
    return found


BEFORE = jobs(j1="2025-01-05", j2="2025-01-06", j3="2025-02-07", j4="2025-03-08", j5=None, j6="2025-04-01")


def test_change_of_some_months(spark, tmp_path):
    folder = str(tmp_path)
    increment.start(spark, tables(spark, BEFORE), folder)
    check(spark, folder, tables(spark, BEFORE))
    untouched = {f: t for f, t in files_of(folder, "job_fact").items() if "2025-03" in f or "2025-01" in f}
    # 3 moves to April, which leaves February empty; 5 gets a date; 6 loses its date; 7 is new
    rows = jobs(j1="2025-01-05", j2="2025-01-06", j3="2025-04-30", j4="2025-03-08", j5="2025-05-01", j6=None, j7="2025-05-31")
    now = tables(spark, rows)
    changed = spark.createDataFrame([(3,), (5,), (6,), (7,)], "job_id long")
    months = increment.touched_months(increment.live(spark, folder, "job_fact"), stage("jobs", now["jobs"]), changed)
    assert months == [None, date(2025, 2, 1), date(2025, 4, 1), date(2025, 5, 1)]
    increment.apply_change(spark, now, folder, months)
    check(spark, folder, now)
    after = files_of(folder, "job_fact")
    assert untouched and all(after[f] == t for f, t in untouched.items())
    assert not any("2025-02" in f for f in after) and not [f for f in os.listdir(folder) if f != "live"]
    increment.apply_change(spark, now, folder, [])
    check(spark, folder, now)


def test_a_change_that_was_cut_off_is_completed(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    increment.start(spark, tables(spark, BEFORE), folder)
    now = tables(spark, jobs(j1="2025-01-05", j2="2025-01-06", j3="2025-03-07", j4="2025-03-08", j5=None, j6="2025-04-01"))
    replace = increment._replace

    def dies(spark, folder, aside, months):
        monkeypatch.setattr(increment, "BITS", "none")
        replace(spark, folder, aside, months[:1])
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(increment, "_replace", dies)
        with pytest.raises(KeyboardInterrupt):
            increment.apply_change(spark, now, folder, [date(2025, 2, 1), date(2025, 3, 1)])
    monkeypatch.undo()
    assert increment.recover(spark, folder) and not increment.recover(spark, folder)
    check(spark, folder, now)


def test_changed_months_are_read_alone(spark, tmp_path, capsys):
    raw = {name: write_parquet(df, f"{tmp_path}/{name}") for name, df in tables(spark, BEFORE).items()}
    staged = stage("jobs", raw["jobs"]).withColumn("completed_date", F.col("completed_date"))
    typed = write_parquet(staged, f"{tmp_path}/typed")
    increment.jobs_of(typed, [date(2025, 2, 1), date(2025, 3, 1)]).explain("formatted")
    text = capsys.readouterr().out
    assert "GreaterThanOrEqual(completed_date,2025-02-01)" in text and "LessThanOrEqual(completed_date,2025-03-31)" in text
    increment.start(spark, raw, f"{tmp_path}/out")
    live = increment.live(spark, f"{tmp_path}/out", "job_fact")
    part = live.filter(increment.in_months(F.col("completed_month"), [date(2025, 3, 1)]))
    part.explain("formatted")
    found = re.search(r"PartitionFilters: \[(.*)\]", capsys.readouterr().out).group(1)
    assert "completed_month" in found and "2025-03-01" in found and part.count() == 1


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")
@pytest.mark.parametrize("name", ["kpi_totals", "monthly_trend_dense", "revenue_by_service", "crew_dashboard", "insights", "city_scorecard"])
def test_answers_from_cells_read_no_job(spark, name):
    text = plan(contract.queries()[f"{name}_from_cells"](spark, SF_DIR))
    assert "o_orderkey" not in text and "l_orderkey" not in text and " job_id#" not in text
    assert "sum_billed_revenue" in text


def test_every_additive_measure_merges(spark):
    fact = job_fact(Staged(tables(spark, [{"job_id": str(i), "billed_revenue": str(i * 10), "rework_flag": str(i % 2), "customer_rating": None if i % 3 else "4",
                                           "completed_date": f"2025-01-{1 + i % 9:02}"} for i in range(1, 30)])))
    cells = job_cells(fact)
    assert set(CELL_STATES) <= set(cells.columns)
    for name, measure in REGISTRY.items():
        if measure.final is None or "quoted" in measure.direct:
            continue
        direct, merged = fact.agg(F.expr(measure.direct)).first()[0], cells.agg(F.expr(measure.merged())).first()[0]
        assert merged == pytest.approx(direct), name
    with pytest.raises(ValueError, match="does not add up"):
        REGISTRY["active_customers"].merged()


def test_customers_of_a_selection(spark, tmp_path):
    rows = [
        (i, date(2025, 1 + i % 4, 1 + i % 28), f"c{i % 3}", f"s{i % 2}", "crew", customer)
        for i, customer in enumerate([None, 0, 1, -1, 32768, 32769, -32768, 2**40, 2**62, 7, 7, 7, 1] * 20)
    ]
    fact = spark.createDataFrame(rows, "job_id long, completed_date date, city string, service_name string, crew_name string, customer_id long")
    fact = fact.withColumn("completed_month", F.trunc("completed_date", "month"))
    fact = write_parquet(fact, f"{tmp_path}/fact", "completed_month")
    bits = write_parquet(customer_bits(fact), f"{tmp_path}/bits", "completed_month")
    for chosen in (
        JobFilter(), JobFilter(start=date(2025, 1, 1), end=date(2025, 3, 31)), JobFilter(start=date(2025, 1, 9), end=date(2025, 3, 20)),
        JobFilter(start=date(2025, 2, 3)), JobFilter(start=date(2025, 2, 1), end=date(2025, 2, 28), cities=["c1"]),
        JobFilter(cities=["c0", "c2"], services=["s1"]), JobFilter(cities=["nowhere"]), JobFilter(cities=[f"c{i}" for i in range(1, 400)]),
        JobFilter(start=date(2025, 1, 31), end=date(2025, 2, 1)),
    ):
        want = chosen.apply(fact).agg(F.countDistinct("customer_id")).first()[0]
        assert selected_customers(bits, fact, chosen).first()[0] == want, chosen
    per_month = {r[0]: r[1] for r in count_customers(bits, "completed_month").collect()}
    want = {r[0]: r[1] for r in fact.groupBy("completed_month").agg(F.countDistinct("customer_id")).collect()}
    assert per_month == want


def test_cut_months_are_read_from_the_fact_alone(spark, tmp_path):
    rows = [(date(2025, m, 10), "c", "s", "w", m) for m in range(1, 8)]
    fact = spark.createDataFrame(rows, "completed_date date, city string, service_name string, crew_name string, customer_id long")
    fact = write_parquet(fact.withColumn("completed_month", F.trunc("completed_date", "month")), f"{tmp_path}/f", "completed_month")
    bits = write_parquet(customer_bits(fact), f"{tmp_path}/b", "completed_month")
    whole = selected_customers(bits, fact, JobFilter(start=date(2025, 2, 1), end=date(2025, 4, 30)))
    assert f"{tmp_path}/f" not in plan(whole) and whole.first()[0] == 3
    cut = selected_customers(bits, fact, JobFilter(start=date(2025, 2, 5), end=date(2025, 4, 30)))
    assert "completed_month#" in plan(cut) and "2025-02-01" in plan(cut) and cut.first()[0] == 3


def test_long_lists_become_semi_joins(spark):
    fact = job_fact(Staged(tables(spark, BEFORE)))
    short, long = JobFilter(cities=["Oak", "x"]), JobFilter(cities=[*(f"c{i}" for i in range(10_000)), "Oak", "Oak"])
    assert "LeftSemi" not in plan(short.apply(fact)) and "LeftSemi" in plan(long.apply(fact))
    assert rows_of(short.apply(fact)) == rows_of(long.apply(fact)) and long.apply(fact).columns == fact.columns
    assert rows_of(JobFilter(cities=[f"c{i}" for i in range(300)]).apply(fact)) == []
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in plan(long.apply(fact)) and "BroadcastHashJoin" not in plan(long.apply(fact))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty_selections_say_what_was_asked(spark):
    fact = job_fact(Staged(tables(spark, BEFORE)))
    nowhere = JobFilter(start=date(2025, 1, 1), cities=["b", "a"])
    assert tuple(selection_state(nowhere.apply(fact), nowhere).first()) == ("completed 2025-01-01 to 2025-01-01; city in (a, b)", False)
    assert tuple(selection_state(JobFilter().apply(fact), JobFilter()).first()) == ("all jobs", True)
    with pytest.raises(NoMatchingJobs, match="city in .a, b."):
        require_jobs(nowhere.apply(fact), nowhere)
    assert dashboard.kpi_totals(job_cells(nowhere.apply(fact))).first()["jobs_completed"] == 0
