from datetime import date

import pytest

from jobmargin.functions import formats
from jobmargin.operators.economics import economics_of
from jobmargin.operators.fact import job_fact
from jobmargin.operators.filters import JobFilter, NoMatchingJobs, require_jobs
from jobmargin.operators.staging import Staged
from jobmargin.plans import dashboard, findings, story
from tests.edge_data import raw_tables

CREWS = [{"crew_id": "1", "crew_name": "North"}, {"crew_id": "2", "crew_name": "East"}]


def _fact(spark, jobs, **rows):
    numbered = [{"job_id": str(i), **job} for i, job in enumerate(jobs, start=1)]
    return job_fact(Staged(raw_tables(spark, jobs=numbered, job_labor=[{"job_id": "0"}], crews=CREWS, **rows)))


def test_default_filter_drops_unknown_dimensions_and_dates(spark):
    fact = _fact(
        spark, [{}, {"city": None}, {"service_id": "9"}, {"crew_id": "9"}, {"completed_date": None}, {"customer_id": "9"}]
    )
    assert [r["job_id"] for r in JobFilter().apply(fact).orderBy("job_id").collect()] == [1, 6]


def test_filter_is_inclusive_and_a_lone_date_is_one_day(spark):
    fact = _fact(spark, [{"completed_date": f"2025-01-{d}"} for d in (10, 11, 12, 13)])

    def kept(**chosen):
        return [r["completed_date"].day for r in JobFilter(**chosen).apply(fact).orderBy("job_id").collect()]

    assert kept(start=date(2025, 1, 11), end=date(2025, 1, 12)) == [11, 12]
    assert kept(start=date(2025, 1, 13)) == [13] and kept(end=date(2025, 1, 10)) == [10]


def test_filter_selections(spark):
    fact = _fact(spark, [{}, {"crew_id": "2"}, {"city": "Elm"}])
    assert JobFilter(crews=["East"]).apply(fact).count() == 1
    assert JobFilter(cities=["Elm", "Oak"], crews=["North"]).apply(fact).count() == 2
    assert JobFilter(cities=[]).apply(fact).count() == 0


def test_empty_selection_is_reported(spark):
    fact = _fact(spark, [{}])
    assert require_jobs(fact) is fact
    with pytest.raises(NoMatchingJobs):
        require_jobs(JobFilter(cities=["Nowhere"]).apply(fact))


def test_kpis_without_revenue_or_jobs(spark):
    fact = _fact(spark, [{"billed_revenue": "0", "actual_labor_hours": "0"}])
    row = dashboard.kpi_totals(fact).first()
    assert (row["gross_margin"], row["avg_job_value"], row["revenue_per_labor_hour"]) == (0.0, 0.0, None)
    none = dashboard.kpi_totals(fact.filter("false")).first()
    assert (none["revenue"], none["jobs_completed"], none["avg_job_value"]) == (0.0, 0, 0.0)


def test_trend_fills_empty_months(spark):
    fact = _fact(spark, [{"completed_date": d} for d in ("2025-01-31", "2025-03-01", "2025-03-05", "2025-07-01")])
    rows = [(r["month"].month, r["revenue"]) for r in dashboard.monthly_trend(fact).collect()]
    assert rows == [(1, 100.0), (2, 0.0), (3, 200.0), (4, 0.0), (5, 0.0), (6, 0.0), (7, 100.0)]
    long = dashboard.monthly_trend_long(fact)
    assert {r["metric"] for r in long.collect()} == {"Revenue", "Gross Profit"} and long.count() == 14


def test_trend_of_one_month(spark):
    assert dashboard.monthly_trend(_fact(spark, [{}])).count() == 1


def test_rankings_are_ordered(spark):
    fact = _fact(spark, [{"city": "A", "billed_revenue": "5"}, {"city": "B", "billed_revenue": "3"}, {"city": "C", "billed_revenue": "4"}])
    assert [r["city"] for r in dashboard.revenue_by(fact, "city").collect()] == ["B", "C", "A"]
    assert [r["billed_revenue"] for r in dashboard.job_detail(fact).collect()] == [3.0, 4.0, 5.0]


def test_crew_dashboard_orders(spark):
    fact = _fact(spark, [{"billed_revenue": "50"}, {"crew_id": "2", "billed_revenue": "200", "actual_labor_hours": "99"}])

    def crews(order):
        return [r["crew_name"] for r in dashboard.crew_dashboard(fact, order).collect()]

    assert crews("revenue") == ["East", "North"]
    assert crews("revenue_per_labor_hour") == ["East", "North"]
    assert crews("gross_margin") == ["North", "East"]


def test_null_margins_sort_last(spark):
    services = [{"service_id": "1", "service_name": "S1"}, {"service_id": "2", "service_name": "S2"}]
    fact = _fact(spark, [{"billed_revenue": "0"}, {"service_id": "2"}], services=services)
    assert [r["service_name"] for r in dashboard.margin_by_service(fact).collect()] == ["S2", "S1"]


def test_insight_ties_go_to_the_smaller_name(spark):
    fact = _fact(spark, [{}, {"crew_id": "2"}])
    picks = {r["insight"]: r["name"] for r in dashboard.insights(fact).collect()}
    assert picks["highest_labor_variance"] == "East" and picks["lowest_revenue_per_hour"] == "East"


def test_insights_skip_unscored_crews(spark):
    fact = _fact(spark, [{"estimated_labor_hours": "0"}, {"crew_id": "2", "actual_labor_hours": "1"}])
    picks = {r["insight"]: (r["name"], r["value"]) for r in dashboard.insights(fact).collect()}
    assert picks["highest_labor_variance"] == ("East", -0.5)


def test_risk_counts(spark):
    fact = _fact(
        spark,
        [
            {"billed_revenue": "5"},
            {"estimated_labor_hours": "0"},
            {"actual_labor_hours": "2.2"},
            {"actual_labor_hours": "2.1"},
        ],
    )
    row = dashboard.job_risk_counts(fact).first()
    # 2.2 against 2.0 planned is 10 % plus a rounding error in doubles, and counts
    assert (row["jobs"], row["loss_jobs"], row["labor_over_jobs"]) == (4, 1, 2)


# -- story ------------------------------------------------------------------------------


def _months(spark, jobs):
    return story.closed_months(JobFilter().apply(_fact(spark, jobs)))


def test_story_drops_the_last_month(spark):
    jobs = [{}, {"completed_date": "2025-02-03"}, {"completed_date": "2025-03-09", "crew_id": "2"}]
    assert [r["job_id"] for r in story.story_scope(_fact(spark, jobs)).orderBy("job_id").collect()] == [1, 2]
    assert [r["crew_name"] for r in story.crew_summary(_months(spark, jobs)).collect()] == ["North"]


def test_single_month_leaves_an_empty_story(spark):
    months = _months(spark, [{}, {}])
    for answer in (story.crew_summary, story.focus_crew, story.focus_gaps, story.scenario_grid, story.excess_hours):
        assert answer(months).count() == 0


LATER = {"completed_date": "2025-06-01"}  # the month that is dropped


def test_excess_hours_ignore_savings_and_nulls(spark):
    hours = [("5", "7"), ("5", None), ("5", "2")]
    jobs = [{"actual_labor_hours": a, "estimated_labor_hours": e} for a, e in hours] + [LATER]
    assert story.excess_hours(_months(spark, jobs)).first()["excess_hours"] == 3.0


def test_focus_tie_goes_to_the_smaller_name(spark):
    months = _months(spark, [{}, {"crew_id": "2"}, LATER])
    assert story.focus_crew(months).first()["crew_name"] == "East"
    status = {r["crew_name"]: r["status"] for r in story.crew_status(months).collect()}
    assert status == {"East": "Investigate", "North": "Other crews"}


def test_avoided_rework_rounds_half_to_even(spark):
    months = _months(spark, [{"rework_flag": "1"}] * 10 + [LATER])
    assert story.scenario_at(months, 40, 25).first()["avoided_rework"] == 2
    assert story.scenario_at(months, 40, 35).first()["avoided_rework"] == 4


def test_scenario_numbers(spark):
    jobs = [
        {"completed_date": "2025-01-05", "actual_labor_hours": "12", "estimated_labor_hours": "2"},
        {"completed_date": "2025-02-05", "actual_labor_hours": "8", "estimated_labor_hours": "10"},
        LATER,
    ]
    numbered = [{"job_id": str(i), **j} for i, j in enumerate(jobs, start=1)]
    labor = [{"job_id": "1", "labor_cost": "40"}, {"job_id": "2", "labor_cost": "20"}]
    months = story.closed_months(job_fact(Staged(raw_tables(spark, jobs=numbered, job_labor=labor))))
    row = story.scenario_at(months).first()
    assert (row["excess_hours"], row["labor_rate"], row["months"]) == (10.0, 3.0, 2)
    assert (row["recovered_hours"], row["period_savings"], row["annual_savings"]) == (4.0, 12.0, 72.0)
    profit, revenue = 200 - 60 - 24, 200
    assert row["modeled_margin"] == pytest.approx((profit + 12) / revenue)
    assert row["margin_gain_points"] == pytest.approx(6.0)
    pair = {r["scenario"]: r["gross_margin"] for r in story.scenario_comparison(months).collect()}
    assert pair["Current"] == pytest.approx(profit / revenue) and pair["Modeled"] == row["modeled_margin"]
    grid = story.scenario_grid(months)
    assert grid.count() == 14 * 11
    same = grid.filter("recovery_pct = 40 and rework_cut_pct = 25").first()
    assert same == row


# -- formats and findings ---------------------------------------------------------------


@pytest.mark.parametrize(
    "value, text",
    [
        (1234567.0, "$1.23M"), (12345.0, "$12K"), (999.4, "$999"), (-5000.0, "$-5K"), (0.0, "$0"), (2.5, "$2"),
        (-2500000.0, "$-2.50M"), (1234567890.0, "$1,234.57M"),
    ],
)
def test_money(spark, value, text):
    assert spark.createDataFrame([(value,)], "v double").selectExpr(f"{formats.money('v')} as t").first()["t"] == text


def test_percent_and_points(spark):
    row = spark.createDataFrame([(0.4876, -5.93, 1.25)], "p double, a double, b double").selectExpr(
        f"{formats.percent('p')} as p", f"{formats.points('a')} as a", f"{formats.points('b')} as b"
    )
    assert tuple(row.first()) == ("48.8%", "-5.9 pts", "+1.2 pts")


def test_bottom_jobs_ties_and_order(spark):
    staged = Staged(raw_tables(spark, jobs=[{"job_id": str(i)} for i in range(30, 0, -1)], job_labor=[{"job_id": "0"}]))
    rows = findings.bottom_jobs(economics_of(staged), staged).collect()
    assert [r["job_id"] for r in rows] == list(range(1, 16))
    assert {(r["customer_name"], r["service_name"], r["crew_name"]) for r in rows} == {("Ada", "Mowing", "North")}


def test_bottom_jobs_keep_jobs_of_unknown_customers(spark):
    staged = Staged(raw_tables(spark, jobs=[{"customer_id": "9"}, {"job_id": "2"}]))
    rows = findings.bottom_jobs(economics_of(staged), staged).collect()
    assert [(r["job_id"], r["customer_name"]) for r in rows] == [(1, None), (2, "Ada")]


def test_size_bands_exclude_their_upper_edge(spark):
    values = ["499.99", "500", "2500", "3999", "4000", None]
    staged = Staged(raw_tables(spark, estimates=[{"estimate_id": str(i), "quoted_revenue": v} for i, v in enumerate(values)]))
    rows = [(r["band"], r["quote_size"], r["estimates_sent"]) for r in findings.win_rate_by_size(staged["estimates"]).collect()]
    assert rows == [
        (1, "$0 to $500", 1), (2, "$500 to $1,000", 1), (4, "$2,500 to $4,000", 2), (5, "$4,000 and up", 1),
        (None, None, 1),
    ]
