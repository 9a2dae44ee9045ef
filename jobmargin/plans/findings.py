"""Portfolio findings and the page questions beyond the scorecards.

Unlike the dashboard answers these cover every job, unfiltered, and keep a NULL group for
jobs whose dimension row is missing, as the scorecards do.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from jobmargin.functions.formats import number, percent, whole_dollars
from jobmargin.functions.measures import measures
from jobmargin.functions.ratios import ascending, descending, expressions, highest, lowest, ratio
from jobmargin.operators.fact import LOOKUPS, attach
from jobmargin.plans.dashboard import OVERRUN, as_cards, pick_rows
from jobmargin.session import shared_root

# Upper edges of the quote-size bands, in dollars.
QUOTE_EDGES = (500, 1000, 2500, 4000)

# Headline numbers: label (a fixed value), measure, display format.
SNAPSHOT = (
    ("Jobs completed", "jobs_completed", lambda v: number(v, "#,##0")),
    ("Revenue", "revenue", whole_dollars),
    ("Gross profit", "gross_profit", whole_dollars),
    ("Gross margin", "gross_margin_pct", percent),
    ("Average job value", "avg_job_value", whole_dollars),
    ("Average labor variance", "avg_labor_variance_pct", percent),
    ("Rework rate", "rework_rate", percent),
    ("Weather delay rate", "weather_delay_rate", percent),
    ("Average customer rating", "avg_customer_rating", lambda v: f"{number(v, '0.00')} || '/5'"),
)


def kpi_snapshot(fact: DataFrame) -> DataFrame:
    """``metric, value``: nine headline numbers as display text."""
    sums = fact.agg(*measures(*[measure for _, measure, _ in SNAPSHOT]))
    shown = as_cards(sums, {label: show(measure) for label, measure, show in SNAPSHOT})
    return shown.withColumnRenamed("card", "metric")


def findings(fact: DataFrame) -> DataFrame:
    """``finding, subject, value, context``: the extremes an owner should know.

    ``context`` is the crew's labor variance, the job count of the service or city, or the
    portfolio margin. The jobs are summed once per crew, service and city, with means as sum and
    count; grouping sets by each of them and over everything then see only those rows.
    """
    crew, service, city = F.col("crew_name"), F.col("service_name"), F.col("city")
    cells = fact.groupBy(crew, service, city).agg(
        *measures("jobs_completed", "revenue", "gross_profit", "actual_labor_hours"),
        F.sum("labor_variance_pct").alias("variance_sum"),
        F.count("labor_variance_pct").alias("variance_jobs"),
    )
    groups = cells.groupingSets([[crew], [service], [city], []], crew, service, city).agg(
        *expressions(
            {
                "revenue": "sum(revenue)",
                "gross_margin_pct": ratio("sum(gross_profit)", "sum(revenue)"),
                "revenue_per_labor_hour": ratio("sum(revenue)", "sum(actual_labor_hours)"),
                "avg_labor_variance_pct": ratio("sum(variance_sum)", "sum(variance_jobs)"),
                "jobs": "cast(sum(jobs_completed) as double)",
                "level": "grouping_id()",
            }
        )
    )
    # grouping_id has one bit per column, set where the column is rolled up
    by_crew, by_service, by_city, overall = (
        f"level = {level} and {name} is not null"
        for level, name in ((3, "crew_name"), (5, "service_name"), (6, "city"), (7, "level"))
    )
    picks = {
        "lowest_revenue_per_hour_crew": lowest(
            "revenue_per_labor_hour", "crew_name", "avg_labor_variance_pct as context", among=by_crew
        ),
        "highest_margin_service": highest("gross_margin_pct", "service_name", "jobs as context", among=by_service),
        "lowest_margin_service": lowest("gross_margin_pct", "service_name", "jobs as context", among=by_service),
        "highest_revenue_city": highest("revenue", "city", "jobs as context", among=by_city),
        "portfolio_revenue": highest("revenue", "'All jobs'", "gross_margin_pct as context", among=overall),
    }
    return pick_rows(groups.agg(*expressions(picks)), "finding").selectExpr(
        "finding", "name as subject", "score as value", "context"
    )


# -- jobs -------------------------------------------------------------------------------


def bottom_jobs(economics: DataFrame, dimensions: Mapping[str, DataFrame], n: int = 15) -> DataFrame:
    """The ``n`` least profitable jobs, with their names from ``dimensions`` (the staged tables).

    The list is cut and checkpointed first; each dimension is then reduced, in its own scan,
    to the keys on the list, so neither jobs nor customers are shuffled for the lookups.
    """
    shared_root(economics.sparkSession)
    order = ascending("gross_profit", "job_id")
    jobs = listed = economics.orderBy(*order).limit(n).checkpoint()
    for name, lookup in LOOKUPS.items():
        needed = dimensions[name].join(listed.select(lookup.key), lookup.key, "left_semi")
        jobs = attach(jobs, needed, lookup)
    return jobs.select(
        "job_id", "completed_date", "customer_name", "service_name", "crew_name", "city", "billed_revenue",
        "gross_profit", "gross_margin_pct",
    ).orderBy(*order)


def overrun_review(fact: DataFrame) -> DataFrame:
    """Jobs over plan by service and crew, most excess hours first."""
    return (
        fact.filter(f"labor_variance_pct > {OVERRUN}D")
        .groupBy("service_name", "crew_name")
        .agg(
            *expressions(
                {
                    "overrun_jobs": "count(1)",
                    "excess_hours": "sum(labor_variance_hours)",
                    "avg_overrun_pct": "avg(labor_variance_pct)",
                }
            )
        )
        .orderBy(*descending("excess_hours"), *ascending("service_name", "crew_name"))
    )


# -- services ---------------------------------------------------------------------------


def billing_type_split(fact: DataFrame) -> DataFrame:
    """Recurring against one-time revenue."""
    return (
        fact.groupBy("billing_type")
        .agg(*measures("jobs_completed", "revenue", "gross_profit", "gross_margin_pct"))
        .orderBy(*descending("revenue"))
    )


def material_plan_vs_actual(fact: DataFrame) -> DataFrame:
    """Estimated against actual material cost per service."""
    return (
        fact.groupBy("service_name")
        .agg(
            F.sum("estimated_material_cost").alias("estimated_material_cost"),
            *measures("material_cost", "material_variance"),
        )
        .orderBy(*ascending("service_name"))
    )


def margin_vs_target(fact: DataFrame) -> DataFrame:
    """Realized margin against the service's target, furthest below first."""
    return (
        fact.groupBy("service_id", "service_name", "target_margin")
        .agg(*measures("revenue", "gross_profit", "gross_margin_pct"))
        .selectExpr("*", "gross_margin_pct - target_margin as margin_gap")
        .orderBy(*ascending("margin_gap", "service_id"))
    )


def win_vs_margin(estimate_card: DataFrame, service_card: DataFrame) -> DataFrame:
    """Services that sell well beside what they earn: highest win rate, lowest margin first.

    A service that was quoted and never performed stays, with NULL for what it earned.
    """
    realized = service_card.select("service_id", "jobs_completed", "revenue", "gross_margin_pct")
    return (
        estimate_card.select("service_id", "service_name", "estimates_sent", "win_rate")
        .join(realized, "service_id", "left")
        .orderBy(*descending("win_rate"), *ascending("gross_margin_pct", "service_id"))
    )


# -- customers --------------------------------------------------------------------------


def _per_customer(economics: DataFrame) -> DataFrame:
    """Additive sums per customer id, reduced before any customer attribute is joined, so a
    customer holding a large share of all jobs is one row by then."""
    return economics.groupBy("customer_id").agg(
        *measures("jobs_completed", "revenue", "gross_profit"),
        *expressions(
            {
                "travel_sum": "sum(travel_minutes)",
                "travel_known": "count(travel_minutes)",
                "loss_jobs": "count_if(gross_profit < 0)",
            }
        ),
    )


def value_by(economics: DataFrame, customers: DataFrame, trait: str) -> DataFrame:
    """Jobs, revenue, margin and travel by a customer attribute, such as ``customer_type``."""
    return (
        _per_customer(economics)
        .join(customers.select("customer_id", trait), "customer_id", "left")
        .groupBy(trait)
        .agg(
            *expressions(
                {
                    "jobs_completed": "sum(jobs_completed)",
                    "revenue": "sum(revenue)",
                    "gross_profit": "sum(gross_profit)",
                    "gross_margin_pct": ratio("sum(gross_profit)", "sum(revenue)"),
                    "avg_travel_minutes": ratio("sum(travel_sum)", "sum(travel_known)"),
                }
            )
        )
        .orderBy(*descending("revenue"), *ascending(trait))
    )


def _customer_list(economics: DataFrame, customers: DataFrame) -> DataFrame:
    """Sums per customer with the name; jobs of unknown customers are one row without id and name."""
    sums = ("jobs_completed", "revenue", "gross_profit", "loss_jobs")
    known = customers.select(F.col("customer_id").alias("known_id"), "customer_name")
    per_customer = _per_customer(economics)
    return (
        per_customer.join(known, per_customer["customer_id"] == known["known_id"], "left")
        .groupBy(F.col("known_id").alias("customer_id"), "customer_name")
        .agg(*[F.sum(c).alias(c) for c in sums])
        .selectExpr("*", f"{ratio('gross_profit', 'revenue')} as gross_margin_pct")
    )


def top_customers(economics: DataFrame, customers: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` customers with the most revenue."""
    return (
        _customer_list(economics, customers)
        .orderBy(*descending("revenue"), *ascending("customer_id"))
        .limit(n)
        .select("customer_id", "customer_name", "jobs_completed", "revenue")
    )


def customer_review(economics: DataFrame, customers: DataFrame) -> DataFrame:
    """All customers, to look at before renewal or repricing: lowest margin first."""
    return (
        _customer_list(economics, customers)
        .orderBy(*ascending("gross_margin_pct", "customer_id"))
        .select(
            "customer_id", "customer_name", "jobs_completed", "revenue", "gross_profit", "gross_margin_pct",
            "loss_jobs",
        )
    )


# -- estimates --------------------------------------------------------------------------


def win_rate_by_channel(estimates: DataFrame, customers: DataFrame) -> DataFrame:
    """Conversion by the customer's acquisition channel; summed per customer before the join."""
    per_customer = estimates.groupBy("customer_id").agg(*measures("estimates_sent", "estimates_won", "quoted_value"))
    return (
        per_customer.join(customers.select("customer_id", "acquisition_channel"), "customer_id", "left")
        .groupBy("acquisition_channel")
        .agg(
            *expressions(
                {
                    "estimates_sent": "sum(estimates_sent)",
                    "estimates_won": "sum(estimates_won)",
                    "win_rate": ratio("sum(estimates_won)", "sum(estimates_sent)"),
                    "quoted_value": "sum(quoted_value)",
                }
            )
        )
        .orderBy(*descending("win_rate"), *ascending("acquisition_channel"))
    )


def quoted_by_month(estimates: DataFrame) -> DataFrame:
    return (
        estimates.groupBy(F.expr("trunc(estimate_date, 'month') as month"))
        .agg(*measures("estimates_sent", "quoted_value"))
        .orderBy(*ascending("month"))
    )


def quoted_by_status(estimates: DataFrame) -> DataFrame:
    """Won against lost and still open estimate value."""
    return (
        estimates.groupBy("estimate_status")
        .agg(*measures("estimates_sent", "quoted_value", "avg_estimate_value"))
        .orderBy(*descending("quoted_value"), *ascending("estimate_status"))
    )


def _size_bands() -> tuple[str, str]:
    """SQL for the number and the label of a quote's size band; each excludes its upper edge."""
    floors = (0, *QUOTE_EDGES)
    labels = [f"${low:,} to ${high:,}" for low, high in zip(floors, QUOTE_EDGES)] + [f"${QUOTE_EDGES[-1]:,} and up"]

    def cases(values: list) -> str:
        upto = " ".join(f"when quoted_revenue < {edge} then {v!r}" for edge, v in zip(QUOTE_EDGES, values))
        return f"case {upto} when quoted_revenue is not null then {values[-1]!r} end"

    return cases(list(range(1, len(labels) + 1))), cases(labels)


def win_rate_by_size(estimates: DataFrame) -> DataFrame:
    """Are larger jobs harder to close? Conversion by quote-size band."""
    band, label = _size_bands()
    return (
        estimates.groupBy(F.expr(f"{band} as band"), F.expr(f"{label} as quote_size"))
        .agg(*measures("estimates_sent", "estimates_won", "win_rate", "quoted_value", "avg_estimate_value"))
        .orderBy(*ascending("band"))
    )
