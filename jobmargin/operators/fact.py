"""The job fact: job economics with customer, service and crew attributes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from jobmargin.operators.economics import economics_of


@dataclass(frozen=True)
class Lookup:
    """A dimension: its key and the attributes it adds, as ``{dimension column: fact column}``."""

    key: str
    adds: Mapping[str, str]


def _same(*names: str) -> dict[str, str]:
    return {n: n for n in names}


# Column names of the fact are fixed values.
LOOKUPS: dict[str, Lookup] = {
    "customers": Lookup(
        "customer_id",
        _same("customer_name", "customer_type", "contract_type", "acquisition_channel", "property_tier"),
    ),
    "services": Lookup("service_id", _same("service_name", "service_category", "billing_type", "target_margin")),
    "crews": Lookup("crew_id", {"crew_name": "crew_name", "home_base": "crew_home_base"}),
}

JOB_COLUMNS = ("job_id", "estimate_id", "scheduled_date", "completed_date", "completed_month")
MEASURE_COLUMNS = (
    "city billed_revenue labor_cost actual_material_cost gross_profit gross_margin_pct estimated_labor_hours "
    "actual_labor_hours labor_variance_hours labor_variance_pct estimated_material_cost material_variance "
    "material_variance_pct rework_flag weather_delay_flag travel_minutes customer_rating"
).split()
FACT_COLUMNS = (
    *JOB_COLUMNS,
    *[c for lookup in LOOKUPS.values() for c in (lookup.key, *lookup.adds.values())],
    *MEASURE_COLUMNS,
)


def attach(jobs: DataFrame, dimension: DataFrame, lookup: Lookup) -> DataFrame:
    """Left join that replaces the job's key by the one found in the dimension.

    A key without a match becomes NULL: such jobs stay in the result, drop out of distinct
    counts and are reported by the quality rules. No hint is given. Spark broadcasts a
    dimension whose measured size is below its threshold, at planning or, for a derived
    one, at run time; a larger one is shuffled, with skewed keys split by AQE.
    """
    added = [f"{column} as {name}" for column, name in lookup.adds.items()]
    side = dimension.selectExpr(f"{lookup.key} as found_key", *added)
    return (
        jobs.join(side, F.expr(f"{lookup.key} = found_key"), "left")
        .drop(lookup.key)
        .withColumnRenamed("found_key", lookup.key)
    )


def job_fact(staged: Mapping[str, DataFrame], lookups: Iterable[str] = tuple(LOOKUPS)) -> DataFrame:
    """One row per job. All three lookups give the full 36-column fact.

    A report that starts from staged tables names only the lookups it reads; columns of the
    others, their keys included, are then absent. The measures are the same as long as
    dimension keys are unique, which ``quality.constraint_report`` checks.

    Joins run on job id first and customer id second. Doing customers first would save a
    shuffle when jobs already are partitioned by customer, but two joins on one key in one
    stage keep AQE from splitting a customer that holds a large share of all jobs.
    """
    wanted = set(lookups)
    fact = economics_of(staged).withColumn("completed_month", F.expr("trunc(completed_date, 'month')"))
    columns = list(JOB_COLUMNS)
    for name, lookup in LOOKUPS.items():
        if name in wanted:
            fact = attach(fact, staged[name], lookup)
            columns += [lookup.key, *lookup.adds.values()]
    return fact.selectExpr(*columns, *MEASURE_COLUMNS)
