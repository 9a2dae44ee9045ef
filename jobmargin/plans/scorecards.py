"""The published scorecards, declared as keys, measures and display order."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from jobmargin.functions.measures import REGISTRY, measures, states_of
from jobmargin.functions.ratios import ascending, descending, expressions, ratio
from jobmargin.operators.economics import economics_of
from jobmargin.operators.fact import job_fact


@dataclass(frozen=True)
class Scorecard:
    keys: tuple[str, ...]
    measures: tuple[str, ...]
    lookups: tuple[str, ...]  # dimensions the keys and measures come from
    order: Callable[[], list[Column]]

    def over(self, fact: DataFrame) -> DataFrame:
        """Aggregate the fact; jobs without a key keep their own NULL row."""
        return fact.groupBy(*self.keys).agg(*measures(*self.measures))

    def groups(self, fact: DataFrame) -> DataFrame:
        """The rows of ``over`` without their measures."""
        return fact.select(*self.keys).distinct()


def _by_revenue() -> list[Column]:
    return descending("revenue")


SCORECARDS: dict[str, Scorecard] = {
    "monthly_scorecard": Scorecard(
        keys=("completed_month",),
        measures=(
            "jobs_completed", "active_customers", "revenue", "labor_cost", "material_cost", "gross_profit",
            "gross_margin_pct", "avg_job_value", "revenue_per_labor_hour", "rework_rate", "weather_delay_rate",
            "avg_customer_rating",
        ),
        lookups=("customers",),
        order=lambda: ascending("completed_month"),
    ),
    "crew_scorecard": Scorecard(
        keys=("crew_id", "crew_name"),
        measures=(
            "jobs_completed", "revenue", "gross_profit", "gross_margin_pct", "actual_labor_hours",
            "revenue_per_labor_hour", "avg_labor_variance_pct", "rework_rate", "avg_travel_minutes",
            "avg_customer_rating",
        ),
        lookups=("crews",),
        order=_by_revenue,
    ),
    "service_scorecard": Scorecard(
        keys=("service_id", "service_name", "service_category", "billing_type"),
        measures=(
            "jobs_completed", "revenue", "gross_profit", "gross_margin_pct", "avg_labor_variance_pct",
            "avg_material_variance_pct", "avg_customer_rating",
        ),
        lookups=("services",),
        order=_by_revenue,
    ),
    "city_scorecard": Scorecard(
        keys=("city",),
        measures=(
            "jobs_completed", "customers_served", "revenue", "gross_profit", "gross_margin_pct",
            "avg_travel_minutes", "weather_delay_rate", "avg_customer_rating",
        ),
        lookups=("customers",),
        order=_by_revenue,
    ),
}


def _per_customer(card: Scorecard, staged: Mapping[str, DataFrame]) -> DataFrame:
    """A scorecard that needs of the customers only which of them exist.

    The jobs are summed to one row per key and customer before the lookup, so the join on customers, and a customer
    with a large share of all jobs, never sees job-grain rows.
    """
    additive = {m: REGISTRY[m] for m in card.measures if REGISTRY[m].final is not None}
    jobs = economics_of(staged).withColumn("completed_month", F.expr("trunc(completed_date, 'month')"))
    sums = jobs.groupBy(*card.keys, "customer_id").agg(*expressions(states_of(additive.values())))
    known = staged["customers"].select(F.col("customer_id").alias("known_id"))
    joined = sums.join(known, F.col("customer_id") == F.col("known_id"), "left")
    counts = {m: "count(distinct known_id)" for m in card.measures if m not in additive}
    merged = {m: measure.merged() for m, measure in additive.items()}
    return joined.groupBy(*card.keys).agg(*expressions({m: {**counts, **merged}[m] for m in card.measures}))


def scorecard(name: str, staged: Mapping[str, DataFrame]) -> DataFrame:
    """One scorecard straight from staged tables, joining only the lookups it needs."""
    card = SCORECARDS[name]
    found = _per_customer(card, staged) if card.lookups == ("customers",) else card.over(job_fact(staged, card.lookups))
    return found.orderBy(*card.order())


def estimate_scorecard(estimates: DataFrame, services: DataFrame) -> DataFrame:
    """Sales conversion per quoted service; independent of the job fact.

    Estimates are reduced to one row per service before the lookup, so the join never
    sees estimate-grain rows whatever share one service holds.
    """
    per_service = estimates.groupBy("service_id").agg(
        *measures("estimates_sent", "estimates_won", "quoted_value"), F.count("quoted_revenue").alias("priced")
    )
    return (
        per_service.join(services.select("service_id", "service_name"), "service_id", "left")
        .groupBy("service_id", "service_name")
        .agg(
            *expressions(
                {
                    "estimates_sent": "sum(estimates_sent)",
                    "estimates_won": "sum(estimates_won)",
                    "win_rate": ratio("sum(estimates_won)", "sum(estimates_sent)"),
                    "quoted_value": "sum(quoted_value)",
                    "avg_estimate_value": ratio("sum(quoted_value)", "sum(priced)"),
                }
            )
        )
    )


def estimate_order() -> list[Column]:
    return descending("quoted_value")
