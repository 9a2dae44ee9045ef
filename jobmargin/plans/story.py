"""The owner story: which crew loses hours, and what recovering some of them is worth.

Everything derives from one small table of sums per crew and month, so the jobs are read
once and the what-if model is column arithmetic on a few rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobmargin.functions.formats import money, number, percent, points
from jobmargin.functions.ratios import ascending, expressions, highest, ratio, total
from jobmargin.plans.dashboard import as_cards
from jobmargin.session import shared_root

# Slider ranges of the what-if model, in percent: first, last, step, default.
RECOVERY = (10, 75, 5, 40)
REWORK_CUT = (0, 50, 5, 25)

# Additive per crew and month. Excess hours count overruns only; means are kept as sum and
# count, so that they stay exact when months are added up.
SUMS = {
    "jobs": "count(job_id)",
    "revenue": total("billed_revenue"),
    "gross_profit": total("gross_profit"),
    "labor_cost": total("labor_cost"),
    "labor_hours": total("actual_labor_hours"),
    "labor_variance_hours": total("labor_variance_hours"),
    "excess_hours": total("greatest(labor_variance_hours, 0D)"),
    "variance_sum": "sum(labor_variance_pct)",
    "variance_jobs": "count(labor_variance_pct)",
    "rework_jobs": "coalesce(sum(rework_flag), 0L)",
    "rework_known": "count(rework_flag)",
}

RATES = {
    "avg_labor_variance": ratio("variance_sum", "variance_jobs"),
    "rework_rate": ratio("rework_jobs", "rework_known"),
    "gross_margin": ratio("gross_profit", "revenue"),
    "revenue_per_labor_hour": ratio("revenue", "labor_hours"),
    "labor_rate": ratio("labor_cost", "labor_hours"),
}


def story_scope(picked: DataFrame) -> DataFrame:
    """The picked jobs without those of the last, partial month.

    The month comes first, from the filter columns alone. Give it jobs of the stored fact, or sums of them: then neither
    raw tables nor joins are read for it, and the month left out is not read at all.
    """
    return picked.filter(F.col("completed_month") < picked.agg(F.max("completed_month")).scalar())


def crew_months(picked: DataFrame) -> DataFrame:
    """``SUMS`` per crew and month, last month included."""
    return picked.groupBy("crew_name", "completed_month").agg(*expressions(SUMS))


def closed_months(picked: DataFrame) -> DataFrame:
    """``crew_months`` of the story scope, checkpointed.

    The story reads this table several times (its last month, its month count, the crews).
    The checkpoint in the shared folder makes that one pass over the jobs and survives the
    loss of executors.
    """
    shared_root(picked.sparkSession)
    return story_scope(crew_months(picked).checkpoint())


def crews_of(months: DataFrame) -> DataFrame:
    """One row per crew with its sums, means and ratios."""
    by_crew = months.groupBy("crew_name").agg(*expressions({c: f"sum({c})" for c in SUMS}))
    return by_crew.select("*", *expressions(RATES))


def crew_summary(months: DataFrame) -> DataFrame:
    return crews_of(months).select(
        "crew_name", "jobs", "revenue", "gross_profit", "labor_hours", "labor_variance_hours", "avg_labor_variance",
        "rework_rate", "rework_jobs", "gross_margin", "revenue_per_labor_hour",
    )


def focus_crew(months: DataFrame, *carry: str) -> DataFrame:
    """The crew with the highest mean labor variance: one row, none without jobs in scope."""
    carry = carry or tuple("gross_margin rework_rate rework_jobs revenue gross_profit revenue_per_labor_hour".split())
    return (
        crews_of(months)
        .agg(F.expr(f"{highest('avg_labor_variance', 'crew_name', *carry)} as focus"))
        .filter("focus is not null")
        .selectExpr("focus.name as crew_name", "focus.score as avg_labor_variance", *[f"focus.{c}" for c in carry])
    )


def focus_gaps(months: DataFrame) -> DataFrame:
    """How far the focus crew's margin trails the portfolio and the best crew, in points."""
    picks = {
        "focus": highest("avg_labor_variance", "crew_name", "gross_margin"),
        "best": highest("gross_margin", "crew_name"),
        "portfolio_margin": ratio("sum(gross_profit)", "sum(revenue)"),
    }
    return (
        crews_of(months)
        .agg(*expressions(picks))
        .filter("focus is not null")
        .selectExpr(
            "focus.name as focus_crew",
            "focus.gross_margin as focus_margin",
            "portfolio_margin",
            "(focus.gross_margin - portfolio_margin) * 100 as portfolio_gap_points",
            "best.name as best_crew",
            "best.score as best_margin",
            "(best.score - focus.gross_margin) * 100 as best_gap_points",
        )
        .selectExpr("*", f"{points('portfolio_gap_points')} as portfolio_gap")
    )


def crew_status(months: DataFrame) -> DataFrame:
    """Crews by margin, the focus crew marked for investigation."""
    focus = focus_crew(months, "gross_margin").select("crew_name").scalar()
    is_focus = F.col("crew_name") == focus
    return (
        crews_of(months)
        .select("crew_name", "gross_margin", F.when(is_focus, "Investigate").otherwise("Other crews").alias("status"))
        .orderBy(*ascending("gross_margin", "crew_name"))
    )


def excess_hours(months: DataFrame) -> DataFrame:
    """The evidence against the focus crew: overrun hours and the rates beside them."""
    return focus_crew(months, "excess_hours", "rework_rate", "revenue_per_labor_hour", "labor_rate").drop(
        "avg_labor_variance"
    )


def _slider(settings: tuple[int, int, int, int]) -> str:
    first, last, step, _ = settings
    return f"explode(sequence({first}, {last}, {step}))"


def scenario(crews: DataFrame, recovery: str, rework_cut: str, months: DataFrame) -> DataFrame:
    """Value of recovering part of the excess hours and avoiding part of the rework.

    ``recovery`` and ``rework_cut`` are SQL for percentages; savings are annualized over the
    number of months in scope.
    """
    month_count = months.agg(F.expr("greatest(1L, count(distinct completed_month))")).scalar()
    return (
        crews.selectExpr("*", f"{recovery} as recovery_pct")
        .selectExpr("*", f"{rework_cut} as rework_cut_pct")
        .withColumn("months", month_count)
        .selectExpr("*", "excess_hours * recovery_pct / 100 as recovered_hours")
        .selectExpr("*", "recovered_hours * labor_rate as period_savings")
        .selectExpr("*", f"{ratio('gross_profit + period_savings', 'revenue')} as modeled_margin")
        .selectExpr(
            "crew_name",
            "recovery_pct",
            "rework_cut_pct",
            "months",
            "excess_hours",
            "labor_rate",
            "recovered_hours",
            "period_savings",
            "period_savings / months * 12 as annual_savings",
            "cast(bround(rework_jobs * rework_cut_pct / 100D) as bigint) as avoided_rework",
            "gross_margin",
            "modeled_margin",
            "(modeled_margin - gross_margin) * 100 as margin_gain_points",
        )
    )


def scenario_grid(months: DataFrame) -> DataFrame:
    """Every crew at every position of the two sliders."""
    return scenario(crews_of(months), _slider(RECOVERY), _slider(REWORK_CUT), months)


def scenario_at(
    months: DataFrame, recovery_pct: int = RECOVERY[-1], rework_cut_pct: int = REWORK_CUT[-1]
) -> DataFrame:
    """The focus crew at one position of the sliders."""
    focus = focus_crew(months, "excess_hours", "labor_rate", "rework_jobs", "gross_profit", "revenue", "gross_margin")
    return scenario(focus, str(recovery_pct), str(rework_cut_pct), months)


def scenario_comparison(months: DataFrame) -> DataFrame:
    """``scenario, gross_margin``: the focus crew today and at the default settings."""
    modeled = scenario_at(months).selectExpr("gross_margin as Current", "modeled_margin as Modeled")
    return modeled.unpivot([], ["Current", "Modeled"], "scenario", "gross_margin")


def scenario_cards(months: DataFrame) -> DataFrame:
    """``card, value``: the focus crew's outcome at the default settings, as display text."""
    cards = {
        "Hours recovered": number("recovered_hours", "#,##0"),
        "Annualized profit impact": money("annual_savings"),
        "Modeled crew margin": percent("modeled_margin"),
        "Margin change": f"{number('margin_gain_points', '0.0')} || ' pts'",
        "Rework jobs avoided": number("avoided_rework", "#,##0"),
    }
    return as_cards(scenario_at(months), cards)


def review_cards(months: DataFrame) -> DataFrame:
    """``card, value``: what the story looks at. Card labels, here and below, are fixed values."""
    cards = {
        "Revenue reviewed": money("revenue"),
        "Gross profit": money("gross_profit"),
        "Portfolio margin": percent("margin"),
        "Completed jobs": number("jobs", "#,##0"),
    }
    sums = {name: f"sum({name})" for name in ("revenue", "gross_profit", "jobs")}
    return as_cards(months.agg(*expressions({**sums, "margin": ratio("sum(gross_profit)", "sum(revenue)")})), cards)


def warning_cards(months: DataFrame) -> DataFrame:
    """``card, value``: the focus crew and how far its margin trails the portfolio; none without jobs in scope."""
    picks = {
        "focus": highest("avg_labor_variance", "crew_name", "gross_margin"),
        "portfolio_margin": ratio("sum(gross_profit)", "sum(revenue)"),
    }
    found = crews_of(months).agg(*expressions(picks)).filter("focus is not null").selectExpr("focus.*", "portfolio_margin")
    cards = {
        "Crew needing attention": "name",
        "Labor variance": percent("score"),
        "Crew margin": percent("gross_margin"),
        "Gap vs portfolio": points("(gross_margin - portfolio_margin) * 100"),
    }
    return as_cards(found, cards)


def evidence_cards(months: DataFrame) -> DataFrame:
    """``card, value``: the evidence against the focus crew; none without jobs in scope."""
    cards = {
        "Excess labor hours": number("excess_hours", "#,##0"),
        "Rework rate": percent("rework_rate"),
        "Revenue / labor hour": money("revenue_per_labor_hour"),
    }
    return as_cards(excess_hours(months), cards)
