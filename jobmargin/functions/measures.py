"""Named measures: one definition per business metric, shared by every report.

A measure has a direct form, an aggregate over rows, and a mergeable one: states that add up, and a formula over their
sums. Reports over jobs use the direct form; reports over stored cells sum the states and apply the formula. Both come
from the same few words below. A distinct count has no state that adds up; see ``operators.distinct``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column

from jobmargin.functions.ratios import expressions, ratio, total

WON = "count_if(estimate_status = 'Won')"
ROWS = "count(1)"


@dataclass(frozen=True)
class Measure:
    direct: str
    states: Mapping[str, str] = field(default_factory=dict)  # state name to aggregate over rows
    final: str | None = None  # formula over ``{state name}``; None where states do not add up

    def merged(self) -> str:
        """The measure as an aggregate over rows that hold states."""
        if self.final is None:
            raise ValueError(f"{self.direct} does not add up")
        return self.final.format(**{name: f"sum({name})" for name in self.states})


def rows() -> Measure:
    return Measure(ROWS, {"jobs": ROWS}, "coalesce({jobs}, 0L)")


def known(column: str) -> Measure:
    """Rows where ``column`` is not NULL."""
    name = f"count_{column}"
    return Measure(f"count({column})", {name: f"count({column})"}, f"coalesce({{{name}}}, 0L)")


def added(column: str) -> Measure:
    name = f"sum_{column}"
    return Measure(f"sum({column})", {name: f"sum({column})"}, f"{{{name}}}")


def added_or_zero(column: str) -> Measure:
    """0, not NULL, over nothing (dashboard totals)."""
    name = f"sum_{column}"
    return Measure(total(column), added(column).states, f"coalesce({{{name}}}, 0D)")


def mean(column: str) -> Measure:
    top, bottom = f"sum_{column}", f"count_{column}"
    states = {top: f"sum({column})", bottom: f"count({column})"}
    return Measure(f"avg({column})", states, ratio(f"{{{top}}}", f"{{{bottom}}}"))


def per(numerator: str, denominator: str) -> Measure:
    """Ratio of sums."""
    states = {f"sum_{c}": f"sum({c})" for c in (numerator, denominator)}
    direct = ratio(f"sum({numerator})", f"sum({denominator})")
    return Measure(direct, states, ratio(f"{{sum_{numerator}}}", f"{{sum_{denominator}}}"))


def distinct(column: str) -> Measure:
    return Measure(f"count(distinct {column})")


# Margin, revenue per hour and win rate are ratios of sums; the variance measures named
# avg_* are plain means of the per-job ratios. The two are not interchangeable.
REGISTRY: dict[str, Measure] = {
    # volume
    "jobs_completed": rows(),
    "active_customers": distinct("customer_id"),
    "customers_served": distinct("customer_id"),
    # money
    "revenue": added("billed_revenue"),
    "labor_cost": added("labor_cost"),
    "material_cost": added("actual_material_cost"),
    "gross_profit": added("gross_profit"),
    "gross_margin_pct": per("gross_profit", "billed_revenue"),
    "avg_job_value": mean("billed_revenue"),
    # labor and material
    "actual_labor_hours": added("actual_labor_hours"),
    "revenue_per_labor_hour": per("billed_revenue", "actual_labor_hours"),
    "labor_variance_hours": added("labor_variance_hours"),
    "avg_labor_variance_pct": mean("labor_variance_pct"),
    "material_variance": added("material_variance"),
    "avg_material_variance_pct": mean("material_variance_pct"),
    # service quality
    "rework_rate": mean("rework_flag"),
    "weather_delay_rate": mean("weather_delay_flag"),
    "avg_travel_minutes": mean("travel_minutes"),
    "avg_customer_rating": mean("customer_rating"),
    # sales
    "estimates_sent": Measure(ROWS),
    "estimates_won": Measure(WON),
    "win_rate": Measure(ratio(WON, ROWS)),
    "quoted_value": added("quoted_revenue"),
    "avg_estimate_value": mean("quoted_revenue"),
}
MEASURES: dict[str, str] = {name: measure.direct for name, measure in REGISTRY.items()}


def measures(*names: str) -> list[Column]:
    """Aggregate columns for ``groupBy(...).agg(*measures(...))``, named as registered."""
    return expressions({name: MEASURES[name] for name in names})


def states_of(measures: Iterable[Measure]) -> dict[str, str]:
    """All states of some measures, each once."""
    return {name: sql for measure in measures for name, sql in measure.states.items()}
