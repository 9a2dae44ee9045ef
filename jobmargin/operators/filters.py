"""The dashboard's composite job filter."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F


# Longer selections are joined, not listed: a literal of thousands of names is copied into every task's plan.
LONG_LIST = 200


class NoMatchingJobs(ValueError):
    """The current filter leaves no job."""


@dataclass(frozen=True)
class JobFilter:
    """Completed-date range (inclusive) and optional city, service and crew selections.

    The default selects everything a user can pick, which still leaves out jobs without a
    completion date, city, service or crew. A lone ``start`` or ``end`` is a single day.
    """

    start: date | None = None
    end: date | None = None
    cities: Collection[str] | None = None
    services: Collection[str] | None = None
    crews: Collection[str] | None = None

    def bounds(self) -> tuple[date, date] | None:
        """First and last day, or None without a date selection."""
        first, last = self.start or self.end, self.end or self.start
        return None if first is None else (first, last)

    def picks(self) -> list[Column]:
        """The conditions on city, service and crew names."""
        picked = {"city": self.cities, "service_name": self.services, "crew_name": self.crews}
        return [
            F.col(column).isNotNull() if values is None else F.col(column).isin(*values)
            for column, values in picked.items()
            if values is None or len(values) <= LONG_LIST
        ]

    def long_lists(self) -> dict[str, Collection[str]]:
        """Selections too long for a literal list in the plan, by column."""
        picked = {"city": self.cities, "service_name": self.services, "crew_name": self.crews}
        return {column: values for column, values in picked.items() if values is not None and len(values) > LONG_LIST}

    def conditions(self, has_month: bool = False) -> list[Column]:
        rules = self.picks()
        if self.bounds() is None:
            return [*rules, F.col("completed_date").isNotNull()]
        first, last = self.bounds()
        rules.append(F.col("completed_date").between(F.lit(first), F.lit(last)))
        if has_month:
            # Implied by the date range; Catalyst cannot derive it, and on the stored fact
            # it prunes whole month partitions.
            rules.append(F.col("completed_month").between(F.lit(first.replace(day=1)), F.lit(last.replace(day=1))))
        return rules

    def semi_joined(self, jobs: DataFrame) -> DataFrame:
        """``jobs`` narrowed by the long lists, each a table of its own.

        No hint is given: Spark measures the list and broadcasts it below its threshold, or shuffles both sides.
        """
        for column, values in self.long_lists().items():
            names = jobs.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"{column} string")
            jobs = jobs.join(names, column, "left_semi").select(*jobs.columns)
        return jobs

    def apply(self, fact: DataFrame) -> DataFrame:
        for rule in self.conditions("completed_month" in fact.columns):
            fact = fact.filter(rule)
        return self.semi_joined(fact)

    def described(self) -> str:
        """The selection in words, for messages."""
        parts = [f"completed {first} to {last}" for first, last in [self.bounds() or ("ever", "now")] if self.bounds()]
        for what, values in (("city", self.cities), ("service", self.services), ("crew", self.crews)):
            if values is not None:
                shown = ", ".join(sorted(values)[:5]) + (f" and {len(values) - 5} more" if len(values) > 5 else "")
                parts.append(f"{what} in ({shown})")
        return "; ".join(parts) or "all jobs"


def selection_state(picked: DataFrame, chosen: JobFilter) -> DataFrame:
    """``selection, has_jobs``: one row that tells whether anything is left; looks for a first row only."""
    found = picked.limit(1).agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.lit(chosen.described()).alias("selection"), F.expr("n > 0").alias("has_jobs"))


def require_jobs(df: DataFrame, chosen: JobFilter | None = None) -> DataFrame:
    """``df`` unchanged, or ``NoMatchingJobs`` naming the selection; looks for a first row only."""
    if df.isEmpty():
        raise NoMatchingJobs(f"selection without jobs: {(chosen or JobFilter()).described()}")
    return df
