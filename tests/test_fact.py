import pytest

from jobmargin.functions.measures import MEASURES, measures
from jobmargin.operators.economics import economics_of
from jobmargin.operators.fact import FACT_COLUMNS, LOOKUPS, job_fact
from jobmargin.operators.quality import QualityError, constraint_report, quality_gate, raise_on_failure
from jobmargin.operators.staging import Staged
from jobmargin.plans.pipeline import scorecards_over
from jobmargin.plans.scorecards import SCORECARDS, estimate_scorecard, scorecard
from tests.edge_data import raw_tables


def _staged(spark, **rows):
    return Staged(raw_tables(spark, **rows))


def _jobs(staged):
    return {r["job_id"]: r for r in job_fact(staged).collect()}


def test_fact_has_its_36_columns_in_order(spark):
    fact = job_fact(_staged(spark))
    assert len(FACT_COLUMNS) == 36 and tuple(fact.columns) == FACT_COLUMNS


def test_labor_is_summed_and_defaults_to_zero(spark):
    staged = _staged(
        spark,
        jobs=[{}, {"job_id": "2"}],
        job_labor=[{"labor_cost": "30"}, {"labor_cost": "5.5"}],
    )
    jobs = _jobs(staged)
    assert len(jobs) == 2
    assert (jobs[1]["labor_cost"], jobs[1]["gross_profit"]) == (35.5, 100 - 35.5 - 12)
    assert (jobs[2]["labor_cost"], jobs[2]["gross_profit"]) == (0.0, 88.0)


def test_zero_denominators_give_null(spark):
    staged = _staged(
        spark,
        jobs=[
            {"job_id": "1", "billed_revenue": "0"},
            {"job_id": "2", "estimated_labor_hours": "0"},
            {"job_id": "3", "estimated_material_cost": "0"},
            {"job_id": "4"},
        ],
    )
    jobs = _jobs(staged)
    assert jobs[1]["gross_margin_pct"] is None
    assert (jobs[2]["labor_variance_pct"], jobs[2]["labor_variance_hours"]) == (None, 3.0)
    assert (jobs[3]["material_variance_pct"], jobs[3]["material_variance"]) == (None, 12.0)
    assert (jobs[4]["labor_variance_pct"], jobs[4]["material_variance_pct"]) == (0.5, 0.2)


def test_orphan_keys_become_null_and_stay(spark):
    staged = _staged(spark, jobs=[{}, {"job_id": "2", "customer_id": "9", "service_id": "9", "crew_id": "9"}])
    orphan = _jobs(staged)[2]
    for name in ("customer_id", "customer_name", "service_id", "service_name", "crew_id", "crew_name"):
        assert orphan[name] is None
    month = scorecard("monthly_scorecard", staged).first()
    assert (month["jobs_completed"], month["active_customers"]) == (2, 1)
    gate = {r["check_name"]: r["violations"] for r in quality_gate(job_fact(staged)).collect()}
    assert gate["crew_ids_present"] == 1


def test_every_status_counts_and_city_is_the_jobs(spark):
    staged = _staged(spark, jobs=[{"job_status": "In Progress", "city": "Elm"}])
    assert _jobs(staged)[1]["city"] == "Elm"


def test_job_without_date_forms_the_last_month(spark):
    staged = _staged(spark, jobs=[{"job_id": "2", "completed_date": None}, {}])
    months = [r["completed_month"] for r in scorecard("monthly_scorecard", staged).collect()]
    assert len(months) == 2 and months[-1] is None


def test_group_without_revenue_has_null_margin(spark):
    row = scorecard("crew_scorecard", _staged(spark, jobs=[{"billed_revenue": "0"}])).first()
    assert row["gross_margin_pct"] is None and row["revenue"] == 0.0


def test_group_without_ratings_has_null_rating(spark):
    assert scorecard("city_scorecard", _staged(spark, jobs=[{"customer_rating": None}])).first()[
        "avg_customer_rating"
    ] is None


def test_fewer_lookups_give_the_same_scorecard(spark):
    staged = _staged(spark, jobs=[{}, {"job_id": "2", "crew_id": "9"}], crews=[{}, {"crew_id": "2"}])
    for name, card in SCORECARDS.items():
        assert set(card.lookups) <= set(LOOKUPS)
        direct, full = scorecard(name, staged), card.over(job_fact(staged))
        assert sorted(direct.collect(), key=repr) == sorted(full.collect(), key=repr)


def test_estimates(spark):
    staged = _staged(
        spark,
        services=[{}, {"service_id": "2", "service_name": "Never quoted"}],
        estimates=[
            {},
            {"estimate_id": "2", "estimate_status": "Lost", "quoted_revenue": "300"},
            {"estimate_id": "3", "service_id": "7", "quoted_revenue": None},
        ],
    )
    rows = {r["service_id"]: r for r in estimate_scorecard(staged["estimates"], staged["services"]).collect()}
    assert set(rows) == {1, 7}
    assert (rows[1]["estimates_sent"], rows[1]["estimates_won"], rows[1]["win_rate"]) == (2, 1, 0.5)
    assert (rows[1]["quoted_value"], rows[1]["avg_estimate_value"]) == (400.0, 200.0)
    assert (rows[7]["service_name"], rows[7]["avg_estimate_value"]) == (None, None)


def test_duplicate_job_fails_the_gate(spark, capsys):
    staged = _staged(spark, jobs=[{}, {}])
    gate = quality_gate(job_fact(staged))
    assert {r["check_name"]: r["passed"] for r in gate.collect()}["job_id_unique"] is False
    with pytest.raises(QualityError, match="job_id_unique"):
        raise_on_failure(gate)
    assert "job_id_unique: 1 violations" in capsys.readouterr().out


def test_clean_data_passes(spark):
    staged = _staged(spark)
    assert [ok for _, ok in raise_on_failure(quality_gate(job_fact(staged)), lambda line: None)] == [True] * 5


def test_constraint_report(spark):
    staged = _staged(
        spark,
        jobs=[{}, {}, {"job_id": None}, {"job_id": "2", "customer_id": "9", "billed_revenue": None}],
        crews=[{}, {"crew_name": "Twin"}],
    )
    fact = job_fact(staged)
    tables = {**{t: staged[t] for t in staged}, "job_fact": fact, **scorecards_over(fact, staged)}
    report = {(r["table_name"], r["column_name"], r["rule"]): r["violations"] for r in constraint_report(tables).collect()}
    assert len(report) == 30 and sum(rule == "unique" for _, _, rule in report) == 13
    assert report["jobs", "job_id", "unique"] == 1 and report["jobs", "job_id", "not_null"] == 1
    assert report["crews", "crew_id", "unique"] == 1
    # two crews share the id, so the join doubles every job
    assert report["job_fact", "job_id", "unique"] == 2 and report["job_fact", "job_id", "not_null"] == 2
    assert report["job_fact", "customer_id", "not_null"] == 2
    assert report["job_fact", "billed_revenue", "not_null"] == 2
    assert report["crew_scorecard", "crew_id", "unique"] == 1
    assert report["estimates", "estimate_id", "unique"] == 0


def test_measures_follow_their_definitions(spark):
    """Revenue 100 and 300, labor 30 and 0, material 12 each, hours 3 of 2 planned, then 1 of 2."""
    jobs = [{}, {"job_id": "2", "billed_revenue": "300", "actual_labor_hours": "1", "rework_flag": "1", "customer_rating": "3.5"}]
    staged = _staged(spark, jobs=jobs)
    names = [n for n in MEASURES if not n.startswith(("estimate", "win", "quoted", "avg_estimate"))]
    row = job_fact(staged).agg(*measures(*names)).first().asDict()
    assert row == {
        "jobs_completed": 2, "active_customers": 1, "customers_served": 1, "revenue": 400.0, "labor_cost": 30.0,
        "material_cost": 24.0, "gross_profit": 346.0, "gross_margin_pct": 346 / 400, "avg_job_value": 200.0,
        "actual_labor_hours": 4.0, "revenue_per_labor_hour": 100.0, "labor_variance_hours": 0.0,
        "avg_labor_variance_pct": 0.0, "material_variance": 4.0, "avg_material_variance_pct": 0.2,
        "rework_rate": 0.5, "weather_delay_rate": 0.0, "avg_travel_minutes": 15.0, "avg_customer_rating": 4.0,
    }


def test_economics_keeps_job_columns(spark):
    staged = _staged(spark)
    assert set(staged["jobs"].columns) < set(economics_of(staged).columns)
