"""Selection cells: what the jobs of one day, city, service and crew add up to.

The dashboard's filter can pick cells as well as jobs, and every measure with a mergeable form can be taken from them, so
the answers need no job. There are at most days x cities x services x crews cells, however many jobs there are.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame

from jobmargin.functions.measures import REGISTRY, Measure, states_of
from jobmargin.functions.ratios import expressions

CELL_KEYS = (
    "completed_month", "completed_date", "city", "service_id", "service_name", "service_category", "billing_type", "crew_id",
    "crew_name",
)

_OF_ESTIMATES = ("quoted_value", "avg_estimate_value")
CELL_STATES: dict[str, str] = {
    **states_of(measure for name, measure in REGISTRY.items() if name not in _OF_ESTIMATES),
    "count_job_id": "count(job_id)",
}


def job_cells(fact: DataFrame) -> DataFrame:
    """One row per combination of ``CELL_KEYS`` with the states of all job measures."""
    return fact.groupBy(*CELL_KEYS).agg(*expressions(CELL_STATES))


def has_cells(picked: DataFrame) -> bool:
    """Whether a frame holds cells rather than jobs."""
    return "jobs" in picked.columns and "job_id" not in picked.columns


def aggregates(picked: DataFrame, named: Mapping[str, Measure]) -> list[Column]:
    """``named`` measures over jobs or over cells, whichever ``picked`` holds."""
    over_cells = has_cells(picked)
    return expressions({name: m.merged() if over_cells else m.direct for name, m in named.items()})
