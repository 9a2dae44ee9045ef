"""Dashboard answers over the job fact.

Functions taking ``picked`` expect a fact already narrowed by ``JobFilter``; those that only
sum also take selection cells narrowed by it. Sums over nothing are 0 here, as on the cards;
the scorecards keep them NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from jobmargin.functions.formats import money, number, percent
from jobmargin.functions.measures import added, added_or_zero, known, mean, rows
from jobmargin.functions.ratios import ascending, descending, descending_last, expressions, highest, lowest, ratio, total
from jobmargin.operators.cells import aggregates

OVERRUN = 0.10  # share of planned hours above which a job counts as over plan

# Fixed values.
DETAIL_COLUMNS = (
    "completed_date", "customer_name", "service_name", "crew_name", "city", "billed_revenue", "gross_profit",
    "gross_margin_pct", "estimated_labor_hours", "actual_labor_hours", "labor_variance_pct", "rework_flag",
)

# Group aggregates of the dashboard, by output name; they can be taken from jobs or from selection cells.
SUMMARY = {
    "jobs": known("job_id"),
    "revenue": added_or_zero("billed_revenue"),
    "gross_profit": added_or_zero("gross_profit"),
    "labor_hours": added_or_zero("actual_labor_hours"),
    "avg_labor_variance": mean("labor_variance_pct"),
    "rework_rate": mean("rework_flag"),
    "avg_travel": mean("travel_minutes"),
    "avg_rating": mean("customer_rating"),
}
# Ratios of the sums above.
GROSS_MARGIN = f"{ratio('gross_profit', 'revenue')} as gross_margin"
REVENUE_PER_HOUR = f"{ratio('revenue', 'labor_hours')} as revenue_per_labor_hour"


def _summarize(picked: DataFrame, by: str, *names: str) -> DataFrame:
    return picked.groupBy(by).agg(*aggregates(picked, {n: SUMMARY[n] for n in names}))


# -- filter widgets ---------------------------------------------------------------------


def date_bounds(fact: DataFrame) -> DataFrame:
    return fact.agg(F.min("completed_date").alias("min_date"), F.max("completed_date").alias("max_date"))


def filter_values(fact: DataFrame) -> DataFrame:
    """``dimension, value``: what each selection offers, sorted.

    One pass: the distinct combinations are few and are unpivoted only then.
    """
    combos = fact.selectExpr("city", "service_name as service", "crew_name as crew").distinct()
    return (
        combos.unpivot([], ["city", "service", "crew"], "dimension", "value")
        .filter("value is not null")
        .distinct()
        .orderBy("dimension", "value")
    )


# -- executive overview -----------------------------------------------------------------


def kpi_totals(picked: DataFrame) -> DataFrame:
    """One row; margin and job value are 0, not NULL, without revenue or jobs."""
    sums = {n: SUMMARY[n] for n in ("revenue", "gross_profit", "labor_hours")}
    return picked.agg(*aggregates(picked, {**sums, "jobs_completed": rows()})).selectExpr(
        "revenue",
        "gross_profit",
        f"coalesce({ratio('gross_profit', 'revenue')}, 0D) as gross_margin",
        "jobs_completed",
        f"coalesce({ratio('revenue', 'jobs_completed')}, 0D) as avg_job_value",
        REVENUE_PER_HOUR,
    )


def active_customers(picked: DataFrame) -> DataFrame:
    """One row: the customers with a job in the selection. Monthly counts do not add up to it."""
    return picked.agg(F.countDistinct("customer_id").alias("active_customers"))


def kpi_cards(picked: DataFrame) -> DataFrame:
    """``card, value``: the KPI totals as display text. Card labels are fixed values."""
    cards = {
        "Revenue": money("revenue"),
        "Gross Profit": money("gross_profit"),
        "Gross Margin": percent("gross_margin"),
        "Jobs Completed": number("jobs_completed", "#,##0"),
        "Avg Job Value": money("avg_job_value"),
        "Revenue / Labor Hr": money("revenue_per_labor_hour"),
    }
    return as_cards(kpi_totals(picked), cards)


def as_cards(row: DataFrame, cards: dict[str, str]) -> DataFrame:
    """One row turned into ``card, value`` rows of display text."""
    texts = ", ".join(f"struct('{card}' as card, {text} as value)" for card, text in cards.items())
    return row.selectExpr(f"inline(array({texts}))")


def monthly_trend(picked: DataFrame) -> DataFrame:
    """``month, revenue, gross_profit`` for every calendar month from first to last job.

    Each month is stretched up to the one before its successor; the added months get 0.
    The window sees one row per month that has jobs, never job-grain rows, and saves the
    second scan that joining a calendar would need.
    """
    with_jobs = picked.groupBy(F.expr("trunc(completed_date, 'month') as month")).agg(
        *aggregates(picked, {n: SUMMARY[n] for n in ("revenue", "gross_profit")})
    )
    return (
        with_jobs.withColumn("following", F.lead("month").over(Window.orderBy("month")))
        .selectExpr(
            "*", "explode(sequence(month, coalesce(add_months(following, -1), month), interval 1 month)) as calendar"
        )
        .selectExpr(
            "calendar as month",
            "if(calendar = month, revenue, 0D) as revenue",
            "if(calendar = month, gross_profit, 0D) as gross_profit",
        )
        .orderBy("month")
    )


def monthly_trend_long(picked: DataFrame) -> DataFrame:
    """The trend as ``month, metric, amount`` rows, metrics named for display."""
    wide = monthly_trend(picked).withColumnsRenamed({"revenue": "Revenue", "gross_profit": "Gross_Profit"})
    return wide.unpivot("month", ["Revenue", "Gross_Profit"], "metric", "amount").withColumn(
        "metric", F.translate("metric", "_", " ")
    )


def revenue_by(picked: DataFrame, column: str) -> DataFrame:
    return _summarize(picked, column, "revenue").orderBy(*ascending("revenue", column))


def margin_by_service(picked: DataFrame) -> DataFrame:
    return (
        _summarize(picked, "service_name", "revenue", "gross_profit")
        .selectExpr("*", GROSS_MARGIN)
        .orderBy(*ascending("gross_margin", "service_name"))
    )


def crew_efficiency(picked: DataFrame) -> DataFrame:
    return _summarize(
        picked, "crew_name", "revenue", "labor_hours", "avg_labor_variance", "rework_rate"
    ).selectExpr("*", REVENUE_PER_HOUR)


def insights(picked: DataFrame) -> DataFrame:
    """``insight, name, value``: the crew with the highest mean labor variance, the crew with
    the lowest revenue per hour and the service with the lowest margin.

    The jobs are summed once per crew and service; grouping sets over those few rows answer both
    questions, and the picks are aggregates over the groups. Equal scores go to the smaller name.
    """
    crew, service = F.col("crew_name"), F.col("service_name")
    names = ("revenue", "gross_profit", "labor_hours")
    cells = picked.groupBy(crew, service).agg(
        *aggregates(
            picked,
            {
                **{n: SUMMARY[n] for n in names},
                "variance_sum": added("labor_variance_pct"),
                "variance_jobs": known("labor_variance_pct"),
            },
        )
    )
    groups = (
        cells.groupingSets([[crew], [service]], crew, service)
        .agg(
            *expressions({n: f"sum({n})" for n in names}),
            F.expr(f"{ratio('sum(variance_sum)', 'sum(variance_jobs)')} as avg_labor_variance"),
            F.expr("grouping(crew_name) as all_crews"),
        )
        .selectExpr("*", GROSS_MARGIN, REVENUE_PER_HOUR)
    )
    picks = {
        "highest_labor_variance": highest("avg_labor_variance", "crew_name", among="all_crews = 0"),
        "lowest_revenue_per_hour": lowest("revenue_per_labor_hour", "crew_name", among="all_crews = 0"),
        "lowest_service_margin": lowest("gross_margin", "service_name", among="all_crews = 1"),
    }
    return pick_rows(groups.agg(*expressions(picks)), "insight").selectExpr("insight", "name", "score as value")


def pick_rows(picks: DataFrame, label: str) -> DataFrame:
    """Turn one row of pick structs into one row per pick, dropping picks among nothing."""
    rows = ", ".join(f"struct('{name}' as {label}, {name} as pick)" for name in picks.columns)
    return picks.selectExpr(f"inline(array({rows}))").filter("pick is not null").select(label, "pick.*")


# -- job profitability ------------------------------------------------------------------


def job_risk_counts(picked: DataFrame) -> DataFrame:
    return picked.agg(
        *expressions(
            {
                "jobs": "count(1)",
                "gross_margin": ratio("sum(gross_profit)", "sum(billed_revenue)"),
                "loss_jobs": "count_if(gross_profit < 0)",
                "labor_over_jobs": f"count_if(labor_variance_pct > {OVERRUN}D)",
            }
        )
    )


def risk_cards(picked: DataFrame) -> DataFrame:
    """``card, value``: the risk counts as display text. Card labels are fixed values."""
    cards = {
        "Jobs": number("jobs", "#,##0"),
        "Gross Margin": percent("gross_margin"),
        "Jobs Losing Money": number("loss_jobs", "#,##0"),
        "Jobs >10% Labor Over": number("labor_over_jobs", "#,##0"),
    }
    return as_cards(job_risk_counts(picked), cards)


def job_value_margin(picked: DataFrame) -> DataFrame:
    """Scatter points: job value against margin, with their labels."""
    return picked.select(
        "billed_revenue", "gross_margin_pct", "service_name", "customer_name", "crew_name", "city"
    )


def job_value_margin_bins(picked: DataFrame, value_bins: int = 50, margin_bins: int = 50) -> DataFrame:
    """The scatter as counts on a grid between the smallest and largest value and margin.

    ``value_bin, margin_bin`` from 0, their lower edges, and ``jobs``. At most ``value_bins * margin_bins`` rows, however
    many jobs; jobs without a value or margin have no point. The bounds are one aggregate of two columns, taken first.
    """
    points = picked.select("billed_revenue", "gross_margin_pct").dropna()
    limits = "min(billed_revenue) as a0, max(billed_revenue) as a1, min(gross_margin_pct) as b0, max(gross_margin_pct) as b1"
    bounds = points.agg(F.expr(f"struct({limits}) as bounds")).scalar()

    def binned(column: str, low: str, high: str, bins: int) -> str:
        width = f"(bounds.{high} - bounds.{low})"
        return f"int(least(coalesce(floor(try_divide({column} - bounds.{low}, {width}) * {bins}), 0), {bins - 1}))"

    def edge(number: str, low: str, high: str, bins: int) -> str:
        return f"bounds.{low} + (bounds.{high} - bounds.{low}) * {number} / {bins}"

    numbered = points.withColumn("bounds", bounds).selectExpr(
        "bounds", f"{binned('billed_revenue', 'a0', 'a1', value_bins)} as value_bin",
        f"{binned('gross_margin_pct', 'b0', 'b1', margin_bins)} as margin_bin",
    )
    counted = numbered.groupBy("value_bin", "margin_bin").agg(F.count(F.lit(1)).alias("jobs"), F.first("bounds").alias("bounds"))
    return counted.selectExpr(
        "value_bin", "margin_bin", f"{edge('value_bin', 'a0', 'a1', value_bins)} as value_from",
        f"{edge('margin_bin', 'b0', 'b1', margin_bins)} as margin_from", "jobs",
    )


def labor_variance_by_crew(picked: DataFrame) -> DataFrame:
    return _summarize(picked, "crew_name", "avg_labor_variance").orderBy(
        *ascending("avg_labor_variance", "crew_name")
    )


def job_detail(picked: DataFrame, *extra: str) -> DataFrame:
    """All picked jobs, least profitable first.

    The job id breaks ties and keeps a profit shared by very many jobs from falling into a
    single range partition of the sort.
    """
    return picked.orderBy(*ascending("gross_profit", "job_id")).select(*extra, *DETAIL_COLUMNS)


def job_detail_costs(picked: DataFrame) -> DataFrame:
    return job_detail(picked, "job_id", "labor_cost", "actual_material_cost")


PageKey = tuple[float | None, int]  # profit and id of the last job of a page


def job_page(picked: DataFrame, after: PageKey | None = None, size: int = 50, *extra: str) -> DataFrame:
    """The ``size`` jobs that follow ``after`` in the order of ``job_detail``; the first ones without it.

    A page is taken by its key, not by counting rows, so the last page costs no more than the first: each task keeps
    its ``size`` best and nothing is sorted as a whole. Pages stay consistent while jobs are added elsewhere.
    """
    if after is not None:
        profit, job_id = after
        if profit is None:
            picked = picked.filter(F.col("gross_profit").isNull() & (F.col("job_id") > job_id))
        else:
            value = F.col("gross_profit")
            picked = picked.filter(value.isNull() | (value > profit) | ((value == profit) & (F.col("job_id") > job_id)))
    columns = dict.fromkeys(("job_id", *extra, *DETAIL_COLUMNS))
    return picked.orderBy(*ascending("gross_profit", "job_id")).limit(size).select(*columns)


def next_page(page: DataFrame) -> PageKey | None:
    """The key after a page, None after an empty one: one row comes to the driver."""
    last = page.orderBy(*descending_last("gross_profit", "job_id")).select("gross_profit", "job_id").head()
    return None if last is None else (last[0], last[1])


# -- crew performance -------------------------------------------------------------------

CREW_TABLE_ORDERS = {
    "revenue_per_labor_hour": lambda: ascending("revenue_per_labor_hour", "crew_name"),
    "gross_margin": lambda: ascending("gross_margin", "crew_name"),
    "revenue": lambda: descending("revenue") + ascending("crew_name"),
}


def crew_dashboard(picked: DataFrame, order: str = "revenue") -> DataFrame:
    """The crew table, sorted as its chart (``revenue_per_labor_hour`` or ``gross_margin``,
    ascending) or as the table itself (``revenue``, descending)."""
    return (
        _summarize(picked, "crew_name", *SUMMARY)
        .selectExpr("*", GROSS_MARGIN, REVENUE_PER_HOUR)
        .orderBy(*CREW_TABLE_ORDERS[order]())
    )


# -- sales and estimates ----------------------------------------------------------------


def estimate_totals(estimate_card: DataFrame) -> DataFrame:
    return estimate_card.agg(
        *expressions(
            {
                "estimates_sent": "sum(estimates_sent)",
                "estimates_won": "sum(estimates_won)",
                "win_rate": ratio("sum(estimates_won)", "sum(estimates_sent)"),
                "quoted_value": total("quoted_value"),
            }
        )
    )


def estimate_cards(estimate_card: DataFrame) -> DataFrame:
    """``card, value``: the estimate totals as display text. Card labels are fixed values."""
    cards = {
        "Estimates Sent": number("estimates_sent", "#,##0"),
        "Estimates Won": number("estimates_won", "#,##0"),
        "Win Rate": percent("win_rate"),
        "Quoted Value": money("quoted_value"),
    }
    return as_cards(estimate_totals(estimate_card), cards)


def win_rate_ranking(estimate_card: DataFrame) -> DataFrame:
    return estimate_card.orderBy(*ascending("win_rate", "service_id"))


def pipeline_ranking(estimate_card: DataFrame, largest_first: bool = False) -> DataFrame:
    """By quoted value: ascending for the chart, descending for the table."""
    order = descending("quoted_value") if largest_first else ascending("quoted_value")
    return estimate_card.orderBy(*order, *ascending("service_id"))
