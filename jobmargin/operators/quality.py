"""Quality rules: the gate on the job fact and the key constraints of all tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from jobmargin.functions.ratios import expressions


class QualityError(RuntimeError):
    """At least one quality rule failed."""


# Violations per gate check, as aggregates over the fact. The check names are fixed values.
GATE = {
    "job_id_unique": "count(1) - count(distinct job_id)",
    "job_id_not_null": "count(1) - count(job_id)",
    "revenue_non_negative": "count_if(billed_revenue < 0)",
    "margin_reasonable": "count_if(abs(gross_margin_pct) > 1)",
    "crew_ids_present": "count_if(crew_id is null)",
}


def quality_gate(fact: DataFrame) -> DataFrame:
    """``check_name, violations, passed``: five checks in one pass over the fact."""
    counts = fact.agg(*expressions(GATE))
    return counts.unpivot([], list(GATE), "check_name", "violations").selectExpr(
        "*", "violations = 0 as passed"
    )


# What one pass over the fact can count without keeping ids; the rest of the gate is derived from it.
OBSERVED = {"rows": "count(1)", **{name: sql for name, sql in GATE.items() if "distinct" not in sql}}


def observed_gate(jobs: DataFrame, observed: Mapping[str, int]) -> DataFrame:
    """``quality_gate`` from counts taken while the fact was written, and the distinct ids of the staged ``jobs``.

    The fact keeps every job, so it has as many distinct ids as the jobs; only their id column is read.
    """
    ids = jobs.agg(F.count_distinct("job_id").alias("ids"))
    counts = {**{name: f"{observed[name]}L" for name in GATE if name in observed}, "job_id_unique": f"{observed['rows']}L - ids"}
    rows = ids.select(*expressions({name: counts[name] for name in GATE}))
    return rows.unpivot([], list(GATE), "check_name", "violations").selectExpr("*", "violations = 0 as passed")


# (table, key that must be unique and not null, further columns that must not be null)
CONSTRAINTS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("customers", "customer_id", ()),
    ("services", "service_id", ()),
    ("crews", "crew_id", ()),
    ("employees", "employee_id", ()),
    ("estimates", "estimate_id", ()),
    ("jobs", "job_id", ()),
    ("invoices", "invoice_id", ()),
    ("job_fact", "job_id", ("customer_id", "service_id", "crew_id", "billed_revenue")),
    ("monthly_scorecard", "completed_month", ()),
    ("crew_scorecard", "crew_id", ()),
    ("service_scorecard", "service_id", ()),
    ("city_scorecard", "city", ()),
    ("estimate_scorecard", "service_id", ()),
)


def constrained_columns(table: str) -> tuple[str, ...]:
    """The columns of ``table`` that its rules read."""
    return next((key, *more) for name, key, more in CONSTRAINTS if name == table)


def table_constraints(name: str, df: DataFrame, key: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Violations of one table's rules from a single shuffle on its key.

    Rows are first counted per key, map-side before the shuffle, so neither a key with
    very many copies nor a mass of NULL keys ends up in one task. ``unique`` counts key
    values that occur more than once, ``not_null`` counts rows.
    """
    columns = [key, *required]
    nulls = {f"null_{i}": f"count_if({c} is null)" for i, c in enumerate(columns)}
    per_key = df.groupBy(F.col(key).alias("key_value")).agg(*expressions({"copies": "count(1)", **nulls}))
    found = per_key.agg(
        *expressions(
            {
                "repeated": "count_if(key_value is not null and copies > 1)",
                **{n: f"coalesce(sum({n}), 0L)" for n in nulls},
            }
        )
    )
    rules = [(key, "unique", "repeated"), *[(c, "not_null", n) for c, n in zip(columns, nulls)]]
    rows = [
        f"struct('{name}' as table_name, '{column}' as column_name, '{rule}' as rule, {source} as violations)"
        for column, rule, source in rules
    ]
    return found.selectExpr(f"inline(array({', '.join(rows)}))")


def constraint_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """``table_name, column_name, rule, violations``: 13 unique and 17 not-null rules."""
    reports = [table_constraints(name, tables[name], key, more) for name, key, more in CONSTRAINTS]
    return reduce(DataFrame.unionByName, reports)


def raise_on_failure(gate: DataFrame, show: Callable[[str], None] = print) -> list[tuple[str, bool]]:
    """Collect the few gate rows, show how many violations each check found and raise if any did."""
    rows = gate.collect()
    for row in rows:
        show(f"{row['check_name']}: {'ok' if row['passed'] else str(row['violations']) + ' violations'}")
    broken = {row["check_name"]: row["violations"] for row in rows if not row["passed"]}
    if broken:
        raise QualityError(f"violations by check: {broken}")
    return [(row["check_name"], row["passed"]) for row in rows]
