"""

Every query binds the test tables to the nine raw tables (``sources.sample_binding``) and
runs the library on them. Doubles are rounded here, and only here, because sums of doubles
differ in their last bits between engines.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Mapping
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from jobmargin.operators.economics import economics_of, job_economics, labor_rollup  # noqa: E402
from jobmargin.operators.fact import job_fact  # noqa: E402
from jobmargin.operators.cells import job_cells  # noqa: E402
from jobmargin.operators.distinct import BIT_KEYS, customer_bits, selected_customers  # noqa: E402
from jobmargin.operators.filters import JobFilter, selection_state  # noqa: E402
from jobmargin.operators.intake import Intake, take_in  # noqa: E402
from jobmargin.operators.quality import QualityError, quality_gate  # noqa: E402
from jobmargin.operators.staging import Staged, stage  # noqa: E402
from jobmargin.plans import dashboard, findings, increment, pipeline, story  # noqa: E402
from jobmargin.plans.scorecards import SCORECARDS, estimate_order, estimate_scorecard, scorecard  # noqa: E402
from jobmargin.session import run_folder  # noqa: E402
from jobmargin.sources.readers import read_csv_table  # noqa: E402
from jobmargin.sources.sample_binding import bind, bind_changed, bind_dirty, bind_misspelt, changed_jobs  # noqa: E402
from jobmargin.sources.schemas import RAW_TABLES  # noqa: E402
from jobmargin.sources.writers import export_csv, remove_folder, write_parquet  # noqa: E402
from oracles.queries import ORACLES  # noqa: E402

try:
    import jobmargin.llm.queries as corpus
except ImportError:  # the package, the pipeline or what they need is not there
    corpus = None

Query = Callable[[SparkSession, str], DataFrame]

SMOKE_DIR = "/root/testdata/sf0.001"

# A selection with empty months between its first and last job.
SPARSE = JobFilter(cities=["NATION_1"], services=["PROMO"])
# A selection of ten thousand names, of which a few exist.
LONG = JobFilter(cities=[f"NATION_{i}" for i in range(3, 10_003)])
# A selection on every dimension.
NARROW = JobFilter(
    start=date(1996, 3, 15),
    end=date(1998, 9, 30),
    cities=["NATION_1", "NATION_7", "NATION_12", "NATION_20"],
    services=["PROMO", "ECONOMY", "STANDARD"],
    crews=["Crew ASIA", "Crew AMERICA", "Crew EUROPE"],
)


def _comparable(df: DataFrame) -> DataFrame:
    """Doubles to nine significant digits, whatever their magnitude.

    Means over 16 or 32 rows often end exactly half way between two such values, where the
    last bit of a sum would decide; the small factor moves them away from there.
    """
    rounded = "if({0} is null, null, cast(format_string('%.8e', {0} * 1.0000000000137D + 0D) as double)) as {0}"
    return df.selectExpr([rounded.format(c) if t == "double" else c for c, t in df.dtypes])


def _on_staged(build: Callable[[Staged], DataFrame]) -> Query:
    return lambda spark, sf_dir: _comparable(build(Staged(bind(spark, sf_dir))))


def _staging(table: str) -> Query:
    return _on_staged(lambda staged: staged[table])


def _on_fact(build: Callable[[DataFrame], DataFrame], *lookups: str) -> Query:
    """``build`` over the whole fact, with just the lookups it reads."""
    return _on_staged(lambda staged: build(job_fact(staged, lookups)))


def _on_picked(
    build: Callable[[DataFrame], DataFrame], *more: str, chosen: JobFilter = JobFilter()
) -> Query:
    """``build`` over the filtered fact; every selection reads the service and crew names."""
    return _on_staged(lambda staged: build(chosen.apply(job_fact(staged, ("services", "crews", *more)))))


def _on_story(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_picked(lambda picked: build(story.closed_months(picked)))


def _estimate_card(staged: Staged) -> DataFrame:
    return estimate_scorecard(staged["estimates"], staged["services"])


def _on_estimate_card(build: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_staged(lambda staged: build(_estimate_card(staged)))


def _with_customers(build: Callable[..., DataFrame], *more: str) -> Query:
    return _on_staged(lambda staged: build(economics_of(staged), staged["customers"], *more))


def _scorecard(name: str) -> Query:
    return _on_staged(lambda staged: scorecard(name, staged))


def _dirty_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparable(quality_gate(job_fact(Staged(bind_dirty(spark, sf_dir)))))


def _constraints(binding: Callable[..., Mapping[str, DataFrame]]) -> Query:
    """Stores the fact's tested columns first, so that its joins run once for all the tests on it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        staged, folder = Staged(binding(spark, sf_dir)), run_folder(spark, "constraints")
        fact = write_parquet(pipeline.constrained_fact(staged), folder)
        report = pipeline.check_constraints(staged, pipeline.constrained_tables(fact, staged)).checkpoint()
        remove_folder(spark, folder)
        return report

    return run


def _through_csv(table: str) -> Query:
    """Raw table out as CSV text, back in as strings, then staged."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{run_folder(spark, 'csv')}/{table}.csv"
        export_csv(bind(spark, sf_dir)[table], path)
        return _comparable(stage(table, read_csv_table(spark, path, table)))

    return run


def _exported_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The city scorecard as its CSV export delivers it."""
    card = scorecard("city_scorecard", Staged(bind(spark, sf_dir)))
    path = f"{run_folder(spark, 'export')}/city_scorecard"
    export_csv(card, path, pipeline.display_order("city_scorecard"))
    return _comparable(spark.read.schema(card.schema).option("header", True).csv(path))


def _exported(name: str) -> Query:
    """A published table as its CSV export delivers it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        staged = Staged(bind(spark, sf_dir))
        if name == pipeline.ESTIMATES:
            table = _estimate_card(staged)
        else:
            table = job_fact(staged) if name == pipeline.FACT else scorecard(name, staged)
        path = f"{run_folder(spark, 'export')}/{name}"
        export_csv(table, path, pipeline.display_order(name))
        return _comparable(spark.read.schema(table.schema).option("header", True).option("escape", '"').csv(path))

    return run


def _profile(name: str, df: DataFrame) -> DataFrame:
    """One row per column: rows, values, smallest and largest as text, and the sum of numbers; one pass over ``df``.

    Scorecards are rounded first, as their SQL is.
    """
    df = _comparable(df) if name.endswith("scorecard") else df
    numbers, whole = ("bigint", "int", "double"), ("bigint", "int", "date", "string")
    rows = []
    for column, kind in df.dtypes:
        least, greatest = (f"cast({f}({column}) as string)" if kind in whole else "cast(null as string)" for f in ("min", "max"))
        total = f"cast(sum({column}) as double)" if kind in numbers else "cast(null as double)"
        rows.append(
            f"struct('{name}' as table_name, '{column}' as column_name, count(1) as n_rows, count({column}) as n_values, "
            f"{least} as least, {greatest} as greatest, {total} as total)"
        )
    return df.agg(F.expr(f"array({', '.join(rows)}) as columns")).selectExpr("inline(columns)")


def _refreshed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of all tables and views of a full refresh, read back by their names."""
    folder = run_folder(spark, "refresh")
    mark = folder.rsplit("-", 1)[1]
    raw, analytics = f"raw_{mark}", f"analytics_{mark}"
    try:
        pipeline.refresh(spark, bind(spark, sf_dir), folder, lambda line: None, raw, analytics)
    except QualityError:
        pass  # the test data holds jobs outside the margin range; everything is published by then
    views = [*(f"staged_{table}" for table in RAW_TABLES), "labor_rollup", "job_economics"]
    tables = {**{view: spark.table(view) for view in views}, **pipeline.read_published(spark, analytics).tables}
    return _comparable(reduce(DataFrame.union, [_profile(name, df) for name, df in tables.items()]))


def _refreshed_after_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of the fact and its scorecards after a change that was applied to its months only."""
    folder, before, after = run_folder(spark, "live"), bind(spark, sf_dir), bind_changed(spark, sf_dir)
    increment.start(spark, before, folder)
    months = increment.touched_months(
        increment.live(spark, folder, increment.FACT), stage("jobs", after["jobs"]), changed_jobs(spark, sf_dir)
    )
    increment.apply_change(spark, after, folder, months)
    cells, bits = increment.live(spark, folder, increment.CELLS), increment.live(spark, folder, increment.BITS)
    tables = {name: increment.scorecard_from_state(name, cells, bits) for name in SCORECARDS}
    tables = {pipeline.FACT: increment.live(spark, folder, increment.FACT), **tables}
    return _comparable(reduce(DataFrame.union, [_profile(name, df) for name, df in tables.items()]))


def _taken_in(spark: SparkSession, sf_dir: str, *tables: str) -> list[Intake]:
    folder, raw = run_folder(spark, "intake"), bind_misspelt(spark, sf_dir)
    return [take_in(table, raw[table], folder) for table in tables]


def _rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce(DataFrame.union, [taken.rejected for taken in _taken_in(spark, sf_dir, "jobs", "estimates")])


def _pages(size: int, count: int) -> Query:
    """The first pages of the job detail, each fetched by the key of the one before."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fact = JobFilter().apply(job_fact(Staged(bind(spark, sf_dir))))
        fact = write_parquet(fact, run_folder(spark, "fact"))
        pages, key = [], None
        for number in range(1, count + 1):
            page = dashboard.job_page(fact, key, size)
            pages.append(page.withColumn("page", F.lit(number)))
            key = dashboard.next_page(page)
            if key is None:
                break
        return _comparable(reduce(DataFrame.union, pages))

    return run


def _on_cells(build: Callable[[DataFrame], DataFrame], chosen: JobFilter = JobFilter()) -> Query:
    """``build`` over stored selection cells, as a dashboard would keep them; no job is read for the answer."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fact = job_fact(Staged(bind(spark, sf_dir)), ("services", "crews", "customers"))
        cells = write_parquet(job_cells(fact), run_folder(spark, "cells"), partition_by="completed_month")
        return _comparable(build(chosen.apply(cells)))

    return run


def _card_from_cells(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        fact = job_fact(Staged(bind(spark, sf_dir)))
        cells = write_parquet(job_cells(fact), run_folder(spark, "cells"))
        bits = write_parquet(customer_bits(fact), run_folder(spark, "bits"))
        return _comparable(increment.scorecard_from_state(name, cells, bits))

    return run


def _customers_from_bits(chosen: JobFilter) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        columns = [*BIT_KEYS, "completed_date", "customer_id"]
        fact = job_fact(Staged(bind(spark, sf_dir))).select(*columns)
        fact = write_parquet(fact, run_folder(spark, "fact"), partition_by="completed_month")
        bits = write_parquet(customer_bits(fact), run_folder(spark, "bits"), partition_by="completed_month")
        return selected_customers(bits, fact, chosen)

    return run


def _selection_states(staged: Staged) -> DataFrame:
    fact = job_fact(staged, ("services", "crews"))
    return reduce(DataFrame.union, [selection_state(c.apply(fact), c) for c in (NARROW, JobFilter(cities=["Nowhere"]))])


def _copartitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job economics from jobs and summed labor that are stored by job id."""
    folder = run_folder(spark, "by-job")
    jobs, rollup = pipeline.store_by_job(Staged(bind(spark, sf_dir)), folder, f"by_job_{folder.rsplit('-', 1)[1]}", 8)
    return _comparable(job_economics(jobs, rollup))


def _on_points(build: Callable[[DataFrame], DataFrame]) -> Query:
    """``build`` over the value and margin of the picked jobs as a stored fact holds them, so that the joins run once."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        picked = JobFilter().apply(job_fact(Staged(bind(spark, sf_dir)), ("services", "crews")))
        points = write_parquet(picked.select("billed_revenue", "gross_margin_pct"), run_folder(spark, "points"))
        return _comparable(build(points))

    return run


def _story_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story's jobs from a stored fact: its last month is found and left out without the raw tables."""
    fact = write_parquet(job_fact(Staged(bind(spark, sf_dir))), run_folder(spark, "fact"), partition_by="completed_month")
    return _comparable(story.story_scope(JobFilter().apply(fact)))


def _published_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A selection over the stored, month-partitioned fact."""
    fact = job_fact(Staged(bind(spark, sf_dir)))
    fact = write_parquet(fact, run_folder(spark, "publish"), partition_by="completed_month")
    return _comparable(NARROW.apply(fact))


def entry(spark: SparkSession) -> DataFrame:
    """Monthly scorecard over the smallest test tables."""
    return queries()["monthly_scorecard"](spark, SMOKE_DIR)


def queries() -> dict[str, Query]:
    return {
        **(corpus.QUERIES if corpus else {}),
        # staging
        "stage_customers": _staging("customers"),
        "stage_services": _staging("services"),
        "stage_crews": _staging("crews"),
        "stage_employees": _staging("employees"),
        "stage_estimates": _staging("estimates"),
        "stage_jobs": _staging("jobs"),
        "stage_job_labor": _staging("job_labor"),
        "stage_invoices": _staging("invoices"),
        "stage_weather": _staging("weather_daily"),
        # sources and sinks
        **{f"csv_{table.removesuffix('_daily')}": _through_csv(table) for table in RAW_TABLES},
        "exported_cities": _exported_cities,
        **{f"exported_{name}": _exported(name) for name in (pipeline.FACT, *SCORECARDS, pipeline.ESTIMATES)},
        "refreshed_tables": _refreshed_tables,
        "refreshed_after_change": _refreshed_after_change,
        "rejected_rows": _rejected_rows,
        "accepted_jobs": lambda spark, sf_dir: _comparable(_taken_in(spark, sf_dir, "jobs")[0].accepted),
        "published_months": _published_months,
        # job economics and the fact
        "labor_rollup": _on_staged(lambda s: labor_rollup(s["job_labor"])),
        "job_economics": _on_staged(economics_of),
        "job_economics_copartitioned": _copartitioned,
        "job_fact": _on_staged(job_fact),
        # scorecards
        **{name: _scorecard(name) for name in SCORECARDS},
        "estimate_scorecard": _on_estimate_card(lambda card: card.orderBy(*estimate_order())),
        # quality
        "quality_gate": _on_staged(lambda s: quality_gate(job_fact(s))),
        "quality_gate_dirty": _dirty_gate,
        "constraint_report": _constraints(bind),
        "constraint_report_dirty": _constraints(bind_dirty),
        # dashboard
        "date_bounds": _on_fact(dashboard.date_bounds),
        "filter_values": _on_fact(dashboard.filter_values, "services", "crews"),
        "filtered_jobs": _on_picked(lambda picked: picked, "customers", chosen=NARROW),
        "kpi_totals": _on_picked(dashboard.kpi_totals),
        "kpi_totals_narrow": _on_picked(dashboard.kpi_totals, chosen=NARROW),
        "kpi_cards": _on_picked(dashboard.kpi_cards),
        "active_customers": _on_picked(dashboard.active_customers, "customers"),
        "active_customers_narrow": _on_picked(dashboard.active_customers, "customers", chosen=NARROW),
        "monthly_trend_dense": _on_picked(dashboard.monthly_trend),
        "monthly_trend_sparse": _on_picked(dashboard.monthly_trend, chosen=SPARSE),
        "monthly_trend_long": _on_picked(dashboard.monthly_trend_long),
        "revenue_by_service": _on_picked(lambda p: dashboard.revenue_by(p, "service_name")),
        "margin_by_service": _on_picked(dashboard.margin_by_service),
        "revenue_by_city": _on_picked(lambda p: dashboard.revenue_by(p, "city")),
        "crew_efficiency": _on_picked(dashboard.crew_efficiency),
        "insights": _on_picked(dashboard.insights),
        "job_risk_counts": _on_picked(dashboard.job_risk_counts),
        "job_value_margin": _on_picked(dashboard.job_value_margin, "customers"),
        "risk_cards": _on_picked(dashboard.risk_cards),
        "risk_cards_narrow": _on_picked(dashboard.risk_cards, chosen=NARROW),
        "estimate_cards": _on_estimate_card(dashboard.estimate_cards),
        "job_value_margin_bins": _on_points(dashboard.job_value_margin_bins),
        "job_detail_pages": _pages(40, 3),
        "labor_variance_by_crew": _on_picked(dashboard.labor_variance_by_crew),
        "job_detail": _on_picked(dashboard.job_detail, "customers"),
        "job_detail_costs": _on_picked(dashboard.job_detail_costs, "customers"),
        "crew_dashboard": _on_picked(dashboard.crew_dashboard),
        "crew_dashboard_by_hour": _on_picked(lambda p: dashboard.crew_dashboard(p, "revenue_per_labor_hour")),
        "crew_dashboard_by_margin": _on_picked(lambda p: dashboard.crew_dashboard(p, "gross_margin")),
        "estimate_totals": _on_estimate_card(dashboard.estimate_totals),
        "win_rate_ranking": _on_estimate_card(dashboard.win_rate_ranking),
        "pipeline_ranking": _on_estimate_card(dashboard.pipeline_ranking),
        "pipeline_ranking_table": _on_estimate_card(lambda card: dashboard.pipeline_ranking(card, largest_first=True)),
        "selection_state": _on_staged(_selection_states),
        "filtered_jobs_long_list": _on_picked(lambda picked: picked, "customers", chosen=LONG),
        # the same from stored cells and bitmaps
        "kpi_totals_from_cells": _on_cells(dashboard.kpi_totals),
        "kpi_totals_narrow_from_cells": _on_cells(dashboard.kpi_totals, NARROW),
        "monthly_trend_dense_from_cells": _on_cells(dashboard.monthly_trend),
        "revenue_by_service_from_cells": _on_cells(lambda cells: dashboard.revenue_by(cells, "service_name")),
        "margin_by_service_from_cells": _on_cells(dashboard.margin_by_service),
        "revenue_by_city_from_cells": _on_cells(lambda cells: dashboard.revenue_by(cells, "city")),
        "crew_efficiency_from_cells": _on_cells(dashboard.crew_efficiency),
        "crew_dashboard_from_cells": _on_cells(dashboard.crew_dashboard),
        "insights_from_cells": _on_cells(dashboard.insights),
        **{f"{name}_from_cells": _card_from_cells(name) for name in SCORECARDS},
        "active_customers_from_bitmaps": _customers_from_bits(JobFilter()),
        "active_customers_narrow_from_bitmaps": _customers_from_bits(NARROW),
        # story and what-if
        "story_scope": _story_scope,
        "review_cards": _on_story(story.review_cards),
        "warning_cards": _on_story(story.warning_cards),
        "evidence_cards": _on_story(story.evidence_cards),
        "crew_summary": _on_story(story.crew_summary),
        "focus_crew": _on_story(story.focus_crew),
        "focus_gaps": _on_story(story.focus_gaps),
        "crew_status": _on_story(story.crew_status),
        "excess_hours": _on_story(story.excess_hours),
        "scenario_grid": _on_story(story.scenario_grid),
        "scenario_comparison": _on_story(story.scenario_comparison),
        "scenario_cards": _on_story(story.scenario_cards),
        # findings
        "kpi_snapshot": _on_fact(findings.kpi_snapshot),
        "findings": _on_fact(findings.findings, "services", "crews"),
        "billing_type_split": _on_fact(findings.billing_type_split, "services"),
        "material_plan_vs_actual": _on_fact(findings.material_plan_vs_actual, "services"),
        "bottom_jobs": _on_staged(lambda s: findings.bottom_jobs(economics_of(s), s)),
        "win_rate_by_channel": _on_staged(lambda s: findings.win_rate_by_channel(s["estimates"], s["customers"])),
        "quoted_by_month": _on_staged(lambda s: findings.quoted_by_month(s["estimates"])),
        "quoted_by_status": _on_staged(lambda s: findings.quoted_by_status(s["estimates"])),
        "win_rate_by_size": _on_staged(lambda s: findings.win_rate_by_size(s["estimates"])),
        "customer_type_value": _with_customers(findings.value_by, "customer_type"),
        "revenue_by_channel": _with_customers(findings.value_by, "acquisition_channel"),
        "top_customers": _with_customers(findings.top_customers),
        "customer_review": _with_customers(findings.customer_review),
        "win_vs_margin": _on_staged(
            lambda s: findings.win_vs_margin(
                _estimate_card(s), SCORECARDS["service_scorecard"].over(job_fact(s, ("services",)))
            )
        ),
        "overrun_review": _on_fact(findings.overrun_review, "services", "crews"),
        "margin_vs_target": _on_fact(findings.margin_vs_target, "services"),
    }


def oracle_sql() -> dict[str, str]:
    return {**ORACLES, **(corpus.ORACLES if corpus else {})}
