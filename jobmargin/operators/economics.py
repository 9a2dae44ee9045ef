"""What each job earned, what it cost and how far it missed its plan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

from jobmargin.functions.ratios import expressions, ratio


def labor_rollup(job_labor: DataFrame) -> DataFrame:
    """Labor hours and cost per job.

    Entries are summed map-side first, so a job with a very large share of all entries
    reaches the shuffle as one row per task. The result is unique on ``job_id``: joining
    it cannot multiply jobs, and Catalyst drops that join where no labor column is read.
    """
    return job_labor.groupBy("job_id").agg(
        F.sum("labor_hours").alias("labor_hours_from_detail"), F.sum("labor_cost").alias("labor_cost")
    )


def _gap(actual: str, planned: str) -> str:
    return f"{actual} - {planned}"


def _relative_gap(actual: str, planned: str) -> str:
    return ratio(f"{actual} - {planned}", planned)


_HOURS = ("actual_labor_hours", "estimated_labor_hours")
_MATERIAL = ("actual_material_cost", "estimated_material_cost")

DERIVED = {
    "gross_margin_pct": ratio("gross_profit", "billed_revenue"),
    "labor_variance_hours": _gap(*_HOURS),
    "labor_variance_pct": _relative_gap(*_HOURS),
    "material_variance": _gap(*_MATERIAL),
    "material_variance_pct": _relative_gap(*_MATERIAL),
}


def job_economics(jobs: DataFrame, rollup: DataFrame) -> DataFrame:
    """All job columns plus labor cost, profit, margin and the labor and material variances."""
    known_labor = rollup.selectExpr("job_id", "labor_cost as summed_labor")
    return (
        jobs.join(known_labor, "job_id", "left")
        .selectExpr("* except (summed_labor)", "coalesce(summed_labor, 0D) as labor_cost")
        .selectExpr("*", "billed_revenue - labor_cost - actual_material_cost as gross_profit")
        .select("*", *expressions(DERIVED))
    )


def economics_of(staged: Mapping[str, DataFrame]) -> DataFrame:
    return job_economics(staged["jobs"], labor_rollup(staged["job_labor"]))
