"""One SQL text per registered query, over the CTEs of ``oracles.tables``."""

from __future__ import annotations

from oracles.tables import with_tables

ROWS = "cast(count(*) as bigint)"

NARROW = """
    completed_date between date '1996-03-15' and date '1998-09-30'
    and city in ('NATION_1', 'NATION_7', 'NATION_12', 'NATION_20')
    and service_name in ('PROMO', 'ECONOMY', 'STANDARD')
    and crew_name in ('Crew ASIA', 'Crew AMERICA', 'Crew EUROPE')"""
SPARSE = "city = 'NATION_1' and service_name = 'PROMO'"


def _r(expression: str, name: str) -> str:
    return f"six({expression}) as {name}"


def _rounded(columns: str) -> str:
    """Plain columns; those written with a leading ~ are doubles to round."""
    return ", ".join(_r(c[1:], c[1:]) if c.startswith("~") else c for c in columns.split())


def _sum(column: str, name: str) -> str:
    return _r(f"sum({column})", name)


def _avg(column: str, name: str) -> str:
    return _r(f"avg({column})", name)


def _zero_sum(column: str, name: str) -> str:
    return _r(f"ifnull(sum({column}), 0e0)", name)


def _share(top: str, bottom: str, name: str) -> str:
    return _r(f"sum({top}) / nullif(sum({bottom}), 0)", name)


def _list(*items: str) -> str:
    return ", ".join(items)


MARGIN = _share("gross_profit", "billed_revenue", "gross_margin_pct")
PER_HOUR = _share("billed_revenue", "actual_labor_hours", "revenue_per_labor_hour")
RATING = _avg("customer_rating", "avg_customer_rating")
REWORK = _avg("rework_flag", "rework_rate")
WEATHER = _avg("weather_delay_flag", "weather_delay_rate")
TRAVEL = _avg("travel_minutes", "avg_travel_minutes")
REVENUE = _sum("billed_revenue", "revenue")
PROFIT = _sum("gross_profit", "gross_profit")

FACT_COLUMNS = """job_id estimate_id scheduled_date completed_date completed_month customer_id customer_name customer_type
    contract_type acquisition_channel property_tier service_id service_name service_category billing_type ~target_margin
    crew_id crew_name crew_home_base city ~billed_revenue ~labor_cost ~actual_material_cost ~gross_profit
    ~gross_margin_pct ~estimated_labor_hours ~actual_labor_hours ~labor_variance_hours ~labor_variance_pct
    ~estimated_material_cost ~material_variance ~material_variance_pct rework_flag weather_delay_flag travel_minutes
    ~customer_rating"""

DETAIL_COLUMNS = """completed_date customer_name service_name crew_name city ~billed_revenue ~gross_profit
    ~gross_margin_pct ~estimated_labor_hours ~actual_labor_hours ~labor_variance_pct rework_flag"""

JOB_COLUMNS = """job_id estimate_id customer_id service_id crew_id scheduled_date completed_date job_status city
    ~billed_revenue ~estimated_labor_hours ~actual_labor_hours ~estimated_material_cost ~actual_material_cost
    rework_flag weather_delay_flag travel_minutes ~customer_rating"""

ESTIMATE_COLUMNS = """estimate_id customer_id service_id estimate_date ~quoted_revenue ~quoted_labor_hours
    ~quoted_material_cost estimate_status won_date"""

INVOICE_COLUMNS = """invoice_id job_id customer_id invoice_date ~invoice_amount payment_status days_to_pay paid_date"""

SENT = f"{ROWS} as estimates_sent"
WON = "cast(count(*) filter (where estimate_status = 'Won') as bigint) as estimates_won"
WIN_RATE = _r("count(*) filter (where estimate_status = 'Won') / cast(nullif(count(*), 0) as double)", "win_rate")
QUOTED = _sum("quoted_revenue", "quoted_value")
AVG_QUOTE = _avg("quoted_revenue", "avg_estimate_value")

SCORECARDS = {
    "monthly_scorecard": "select "
    + _list(
        "completed_month", f"{ROWS} as jobs_completed", "count(distinct customer_id) as active_customers", REVENUE,
        _sum("labor_cost", "labor_cost"), _sum("actual_material_cost", "material_cost"), PROFIT, MARGIN,
        _avg("billed_revenue", "avg_job_value"), PER_HOUR, REWORK, WEATHER, RATING,
    )
    + " from fact group by completed_month",
    "crew_scorecard": "select "
    + _list(
        "crew_id", "crew_name", f"{ROWS} as jobs_completed", REVENUE, PROFIT, MARGIN,
        _sum("actual_labor_hours", "actual_labor_hours"), PER_HOUR,
        _avg("labor_variance_pct", "avg_labor_variance_pct"), REWORK, TRAVEL, RATING,
    )
    + " from fact group by crew_id, crew_name",
    "service_scorecard": "select "
    + _list(
        "service_id", "service_name", "service_category", "billing_type", f"{ROWS} as jobs_completed", REVENUE,
        PROFIT, MARGIN, _avg("labor_variance_pct", "avg_labor_variance_pct"),
        _avg("material_variance_pct", "avg_material_variance_pct"), RATING,
    )
    + " from fact group by service_id, service_name, service_category, billing_type",
    "city_scorecard": "select "
    + _list(
        "city", f"{ROWS} as jobs_completed", "count(distinct customer_id) as customers_served", REVENUE, PROFIT,
        MARGIN, TRAVEL, WEATHER, RATING,
    )
    + " from fact group by city",
    "estimate_scorecard": "select "
    + _list("e.service_id", "s.service_name", SENT, WON, WIN_RATE, QUOTED, AVG_QUOTE)
    + """ from estimates_t e left join services_t s on s.service_id = e.service_id
         group by e.service_id, s.service_name""",
}

# -- quality ----------------------------------------------------------------------------

GATE = """
    select check_name, cast(violations as bigint) as violations, violations = 0 as passed from (
      select 'job_id_unique' as check_name, count(*) - count(distinct job_id) as violations from fact
      union all select 'job_id_not_null', count(*) - count(job_id) from fact
      union all select 'revenue_non_negative', count(*) from fact where billed_revenue < 0
      union all select 'margin_reasonable', count(*) from fact where gross_margin_pct < -1 or gross_margin_pct > 1
      union all select 'crew_ids_present', count(*) from fact where crew_id is null)"""

# published name, SQL source, key, further columns that must not be null
CONSTRAINED = [
    ("customers", "customers_t", "customer_id", ()),
    ("services", "services_t", "service_id", ()),
    ("crews", "crews_t", "crew_id", ()),
    ("employees", "employees_t", "employee_id", ()),
    ("estimates", "estimates_t", "estimate_id", ()),
    ("jobs", "jobs_t", "job_id", ()),
    ("invoices", "invoices_t", "invoice_id", ()),
    ("job_fact", "fact", "job_id", ("customer_id", "service_id", "crew_id", "billed_revenue")),
    ("monthly_scorecard", "(select distinct completed_month from fact)", "completed_month", ()),
    ("crew_scorecard", "(select distinct crew_id, crew_name from fact)", "crew_id", ()),
    (
        "service_scorecard",
        "(select distinct service_id, service_name, service_category, billing_type from fact)",
        "service_id",
        (),
    ),
    ("city_scorecard", "(select distinct city from fact)", "city", ()),
    (
        "estimate_scorecard",
        "(select distinct e.service_id, s.service_name from estimates_t e left join services_t s using (service_id))",
        "service_id",
        (),
    ),
]


def _constraint_sql() -> str:
    parts = []
    for table, source, key, more in CONSTRAINED:
        parts.append(
            f"""select '{table}' as table_name, '{key}' as column_name, 'unique' as rule, count(*) as violations
            from (select {key} from {source} where {key} is not null group by {key} having count(*) > 1)"""
        )
        for column in (key, *more):
            parts.append(f"select '{table}', '{column}', 'not_null', count(*) from {source} where {column} is null")
    return " union all ".join(parts)


# -- dashboard --------------------------------------------------------------------------

KPIS = """
    select six(revenue) as revenue, six(gross_profit) as gross_profit,
      six(case when revenue = 0 then 0e0 else gross_profit / revenue end) as gross_margin, jobs_completed,
      six(case when jobs_completed = 0 then 0e0 else revenue / jobs_completed end) as avg_job_value,
      six(revenue / nullif(hours, 0)) as revenue_per_labor_hour
    from (select ifnull(sum(billed_revenue), 0e0) as revenue, ifnull(sum(gross_profit), 0e0) as gross_profit,
            count(*) as jobs_completed, ifnull(sum(actual_labor_hours), 0e0) as hours
          from picked where {where})"""



def _money(x: str) -> str:
    return f"""'$' || case when abs({x}) >= 1e6 then format('{{:,.2f}}', {x} / 1e6) || 'M'
        when abs({x}) >= 1e3 then format('{{:,.0f}}', {x} / 1e3) || 'K' else format('{{:,.0f}}', {x}) end"""


CARDS = f"""
    select 'Revenue' as card, {_money('revenue')} as value from kpis
    union all select 'Gross Profit', {_money('gross_profit')} from kpis
    union all select 'Gross Margin', printf('%.1f%%', gross_margin * 100) from kpis
    union all select 'Jobs Completed', format('{{:,}}', jobs_completed) from kpis
    union all select 'Avg Job Value', {_money('avg_job_value')} from kpis
    union all select 'Revenue / Labor Hr', {_money('revenue_per_labor_hour')} from kpis"""

SCENARIO_CARDS = f"""
    select 'Hours recovered' as card, format('{{:,.0f}}', recovered_hours) as value from chosen
    union all select 'Annualized profit impact', {_money('(period_savings / months * 12)')} from chosen
    union all select 'Modeled crew margin', printf('%.1f%%', (gross_profit + period_savings) / revenue * 100) from chosen
    union all select 'Margin change',
      printf('%.1f pts', ((gross_profit + period_savings) / revenue - gross_margin) * 100) from chosen
    union all select 'Rework jobs avoided', format('{{:,}}', avoided_rework) from chosen"""

TREND = """
    select cast(c.month as date) as month, six(ifnull(m.revenue, 0e0)) as revenue,
      six(ifnull(m.gross_profit, 0e0)) as gross_profit
    from (select unnest(generate_series(min(completed_month), max(completed_month), interval 1 month)) as month
          from picked where {where}) c
    left join (select completed_month, sum(billed_revenue) as revenue, sum(gross_profit) as gross_profit
               from picked where {where} group by completed_month) m on m.completed_month = cast(c.month as date)"""

CREWS = {
    "crew_totals": """
        select crew_name, count(job_id) as jobs, sum(billed_revenue) as revenue, sum(gross_profit) as gross_profit,
          sum(actual_labor_hours) as labor_hours, avg(labor_variance_pct) as avg_labor_variance,
          avg(rework_flag) as rework_rate, avg(travel_minutes) as avg_travel, avg(customer_rating) as avg_rating,
          sum(gross_profit) / nullif(sum(billed_revenue), 0) as gross_margin,
          sum(billed_revenue) / nullif(sum(actual_labor_hours), 0) as revenue_per_labor_hour
        from picked group by crew_name""",
    "service_totals": """
        select service_name, sum(billed_revenue) as revenue, sum(gross_profit) as gross_profit,
          sum(gross_profit) / nullif(sum(billed_revenue), 0) as gross_margin
        from picked group by service_name""",
}

INSIGHTS = """
    (select 'highest_labor_variance' as insight, crew_name as name, six(avg_labor_variance) as value
     from crew_totals order by avg_labor_variance desc nulls last, crew_name limit 1)
    union all
    (select 'lowest_revenue_per_hour', crew_name, six(revenue_per_labor_hour)
     from crew_totals order by revenue_per_labor_hour nulls last, crew_name limit 1)
    union all
    (select 'lowest_service_margin', service_name, six(gross_margin)
     from service_totals order by gross_margin nulls last, service_name limit 1)"""

# -- story ------------------------------------------------------------------------------

STORY = {
    "crew_story": """
        select crew_name, count(job_id) as jobs, sum(billed_revenue) as revenue, sum(gross_profit) as gross_profit,
          sum(labor_cost) as labor_cost, sum(actual_labor_hours) as labor_hours,
          sum(labor_variance_hours) as labor_variance_hours,
          sum(greatest(labor_variance_hours, 0e0)) as excess_hours,
          avg(labor_variance_pct) as avg_labor_variance, avg(rework_flag) as rework_rate,
          cast(sum(rework_flag) as bigint) as rework_jobs,
          sum(gross_profit) / nullif(sum(billed_revenue), 0) as gross_margin,
          sum(billed_revenue) / nullif(sum(actual_labor_hours), 0) as revenue_per_labor_hour,
          sum(labor_cost) / nullif(sum(actual_labor_hours), 0) as labor_rate
        from story group by crew_name""",
    "focus": "select * from crew_story order by avg_labor_variance desc nulls last, crew_name limit 1",
    "best": "select * from crew_story order by gross_margin desc nulls last, crew_name limit 1",
    "portfolio": "select sum(gross_profit) / nullif(sum(billed_revenue), 0) as margin from story",
    "grid": """
        select crew_name, recovery_pct, rework_cut_pct, months, excess_hours, labor_rate, gross_margin, revenue,
          gross_profit, excess_hours * recovery_pct / 100 as recovered_hours,
          excess_hours * recovery_pct / 100 * labor_rate as period_savings,
          cast(round_even(rework_jobs * rework_cut_pct / 100e0, 0) as bigint) as avoided_rework
        from crew_story,
          (select cast(unnest(generate_series(10, 75, 5)) as int) as recovery_pct),
          (select cast(unnest(generate_series(0, 50, 5)) as int) as rework_cut_pct),
          (select greatest(1, count(distinct completed_month)) as months from story)""",
    "chosen": """
        select grid.* from grid join focus on focus.crew_name = grid.crew_name
        where recovery_pct = 40 and rework_cut_pct = 25""",
}

SCENARIO_GRID = """
    select crew_name, recovery_pct, rework_cut_pct, cast(months as bigint) as months,
      six(excess_hours) as excess_hours, six(labor_rate) as labor_rate,
      six(recovered_hours) as recovered_hours, six(period_savings) as period_savings,
      six(period_savings / months * 12) as annual_savings, avoided_rework, six(gross_margin) as gross_margin,
      six((gross_profit + period_savings) / nullif(revenue, 0)) as modeled_margin,
      six(((gross_profit + period_savings) / nullif(revenue, 0) - gross_margin) * 100) as margin_gain_points
    from grid"""

SCENARIO_COMPARISON = """
    select 'Current' as scenario, six(gross_margin) as gross_margin from chosen
    union all select 'Modeled', six((gross_profit + period_savings) / nullif(revenue, 0)) from chosen"""

FOCUS_GAPS = """
    select f.crew_name as focus_crew, six(f.gross_margin) as focus_margin, six(p.margin) as portfolio_margin,
      six((f.gross_margin - p.margin) * 100) as portfolio_gap_points, b.crew_name as best_crew,
      six(b.gross_margin) as best_margin, six((b.gross_margin - f.gross_margin) * 100) as best_gap_points,
      printf('%+.1f pts', (f.gross_margin - p.margin) * 100) as portfolio_gap
    from focus f, best b, portfolio p"""

# -- findings ---------------------------------------------------------------------------

HEADLINES = {
    "kpis": """
        select sum(billed_revenue) as revenue, sum(gross_profit) as gross_profit, count(*) as jobs_completed,
          sum(gross_profit) / nullif(sum(billed_revenue), 0) as gross_margin,
          sum(billed_revenue) / count(*) as avg_job_value,
          sum(billed_revenue) / nullif(sum(actual_labor_hours), 0) as revenue_per_labor_hour
        from picked""",
    "s": """
        select count(*) as jobs, sum(billed_revenue) as revenue, sum(gross_profit) as profit,
          avg(billed_revenue) as job_value, avg(labor_variance_pct) as variance, avg(rework_flag) as rework,
          avg(weather_delay_flag) as weather, avg(customer_rating) as rating
        from fact"""
}

SNAPSHOT = """
    select 'Jobs completed' as metric, format('{:,}', jobs) as value from s
    union all select 'Revenue', '$' || format('{:,}', cast(revenue as bigint)) from s
    union all select 'Gross profit', '$' || format('{:,}', cast(profit as bigint)) from s
    union all select 'Gross margin', printf('%.1f%%', profit / nullif(revenue, 0) * 100) from s
    union all select 'Average job value', '$' || format('{:,}', cast(job_value as bigint)) from s
    union all select 'Average labor variance', printf('%.1f%%', variance * 100) from s
    union all select 'Rework rate', printf('%.1f%%', rework * 100) from s
    union all select 'Weather delay rate', printf('%.1f%%', weather * 100) from s
    union all select 'Average customer rating', printf('%.2f/5', rating) from s"""


def _extreme(finding: str, key: str, score: str, direction: str, context: str) -> str:
    return f"""(select '{finding}' as finding, {key} as subject, six({score}) as value,
        six(cast({context} as double)) as context
        from fact where {key} is not null group by {key} order by {score} {direction} nulls last, {key} limit 1)"""


_MARGIN = "sum(gross_profit) / nullif(sum(billed_revenue), 0)"
FINDINGS = " union all ".join(
    [
        _extreme(
            "lowest_revenue_per_hour_crew", "crew_name", "sum(billed_revenue) / nullif(sum(actual_labor_hours), 0)",
            "asc", "avg(labor_variance_pct)",
        ),
        _extreme("highest_margin_service", "service_name", _MARGIN, "desc", "count(*)"),
        _extreme("lowest_margin_service", "service_name", _MARGIN, "asc", "count(*)"),
        _extreme("highest_revenue_city", "city", "sum(billed_revenue)", "desc", "count(*)"),
        f"select 'portfolio_revenue', 'All jobs', six(sum(billed_revenue)), six({_MARGIN}) from fact",
    ]
)


def _value_by(trait: str) -> str:
    columns = _list(trait, f"{ROWS} as jobs_completed", REVENUE, PROFIT, MARGIN, TRAVEL)
    return f"select {columns} from fact group by {trait}"


BODIES: dict[str, str] = {
    # staging
    "stage_customers": "select * from customers_t",
    "stage_services": f"""select {_rounded('''service_id service_name service_category billing_type ~default_price
        ~default_est_labor_hours ~default_material_cost''')}, cast(target_margin as double) as target_margin
        from services_t""",
    "stage_crews": f"select {_rounded('crew_id crew_name home_base supervisor crew_size ~labor_efficiency_factor')} from crews_t",
    "stage_employees": f"select {_rounded('employee_id employee_name crew_id role ~hourly_rate hire_date')} from employees_t",
    "stage_estimates": f"select {_rounded(ESTIMATE_COLUMNS)} from estimates_t",
    "stage_jobs": f"select {_rounded(JOB_COLUMNS)} from jobs_t",
    "stage_job_labor": f"select {_rounded('job_id employee_id crew_id work_date ~labor_hours ~labor_cost')} from labor_t",
    "stage_invoices": f"select {_rounded(INVOICE_COLUMNS)} from invoices_t",
    "stage_weather": f"""select {_rounded('weather_date city ~high_temp_f ~precip_inches rain_flag severe_weather_flag')}
        from weather_t""",
    # sources and sinks
    "exported_cities": SCORECARDS["city_scorecard"],
    "published_months": f"select {_rounded(FACT_COLUMNS)} from fact where {NARROW}",
    # job economics and the fact
    "labor_rollup": f"select {_rounded('job_id ~labor_hours_from_detail ~labor_cost')} from labor_sums",
    "job_economics": f"""select {_rounded(JOB_COLUMNS + ''' ~labor_cost ~gross_profit ~gross_margin_pct
        ~labor_variance_hours ~labor_variance_pct ~material_variance ~material_variance_pct''')} from economics""",
    "job_fact": f"select {_rounded(FACT_COLUMNS)} from fact",
    **SCORECARDS,
    # quality
    "quality_gate": GATE,
    "quality_gate_dirty": GATE,
    "constraint_report": _constraint_sql(),
    "constraint_report_dirty": _constraint_sql(),
    # dashboard
    "date_bounds": "select min(completed_date) as min_date, max(completed_date) as max_date from fact",
    "filter_values": """
        select distinct 'city' as dimension, city as value from fact where city is not null
        union all select distinct 'service', service_name from fact where service_name is not null
        union all select distinct 'crew', crew_name from fact where crew_name is not null""",
    "filtered_jobs": f"select {_rounded(FACT_COLUMNS)} from fact where {NARROW}",
    "kpi_totals": KPIS.format(where="true"),
    "kpi_totals_narrow": KPIS.format(where=NARROW),
    "kpi_cards": CARDS,
    "monthly_trend_dense": TREND.format(where="true"),
    "monthly_trend_sparse": TREND.format(where=SPARSE),
    "monthly_trend_long": f"""
        select month, 'Revenue' as metric, revenue as amount from ({TREND.format(where="true")})
        union all select month, 'Gross Profit', gross_profit from ({TREND.format(where="true")})""",
    "revenue_by_service": f"select service_name, {_zero_sum('billed_revenue', 'revenue')} from picked group by 1",
    "margin_by_service": f"select {_rounded('service_name ~revenue ~gross_profit ~gross_margin')} from service_totals",
    "revenue_by_city": f"select city, {_zero_sum('billed_revenue', 'revenue')} from picked group by 1",
    "crew_efficiency": f"""select {_rounded('''crew_name ~revenue ~labor_hours ~avg_labor_variance ~rework_rate
        ~revenue_per_labor_hour''')} from crew_totals""",
    "insights": INSIGHTS,
    "job_risk_counts": f"""select {ROWS} as jobs, {_share('gross_profit', 'billed_revenue', 'gross_margin')},
        count(*) filter (where gross_profit < 0) as loss_jobs,
        count(*) filter (where labor_variance_pct > 0.1) as labor_over_jobs from picked""",
    "job_value_margin": f"""select {_rounded('''~billed_revenue ~gross_margin_pct service_name customer_name crew_name
        city''')} from picked""",
    "labor_variance_by_crew": f"select {_rounded('crew_name ~avg_labor_variance')} from crew_totals",
    "job_detail": f"select {_rounded(DETAIL_COLUMNS)} from picked",
    "job_detail_costs": f"select {_rounded('job_id ~labor_cost ~actual_material_cost ' + DETAIL_COLUMNS)} from picked",
    "crew_dashboard": f"""select {_rounded('''crew_name jobs ~revenue ~gross_profit ~labor_hours ~avg_labor_variance
        ~rework_rate ~avg_travel ~avg_rating ~gross_margin ~revenue_per_labor_hour''')} from crew_totals""",
    "estimate_totals": f"select {_list(SENT, WON, WIN_RATE, QUOTED)} from estimates_t",
    "win_rate_ranking": SCORECARDS["estimate_scorecard"],
    "pipeline_ranking": SCORECARDS["estimate_scorecard"],
    # story and what-if
    "story_scope": f"select {_rounded(FACT_COLUMNS)} from story",
    "crew_summary": f"""select {_rounded('''crew_name jobs ~revenue ~gross_profit ~labor_hours ~labor_variance_hours
        ~avg_labor_variance ~rework_rate rework_jobs ~gross_margin ~revenue_per_labor_hour''')} from crew_story""",
    "focus_crew": f"""select {_rounded('''crew_name ~avg_labor_variance ~gross_margin ~rework_rate rework_jobs ~revenue
        ~gross_profit ~revenue_per_labor_hour''')} from focus""",
    "focus_gaps": FOCUS_GAPS,
    "crew_status": """select crew_name, six(gross_margin) as gross_margin,
        case when crew_name = (select crew_name from focus) then 'Investigate' else 'Other crews' end as status
        from crew_story""",
    "excess_hours": f"""select {_rounded('crew_name ~excess_hours ~rework_rate ~revenue_per_labor_hour ~labor_rate')}
        from focus""",
    "scenario_grid": SCENARIO_GRID,
    "scenario_comparison": SCENARIO_COMPARISON,
    "scenario_cards": SCENARIO_CARDS,
    # findings
    "kpi_snapshot": SNAPSHOT,
    "findings": FINDINGS,
    "billing_type_split": f"select {_list('billing_type', f'{ROWS} as jobs_completed', REVENUE, PROFIT, MARGIN)} from fact group by 1",
    "material_plan_vs_actual": "select "
    + _list(
        "service_name",
        _sum("estimated_material_cost", "estimated_material_cost"),
        _sum("actual_material_cost", "material_cost"),
        _sum("material_variance", "material_variance"),
    )
    + " from fact group by 1",
    "bottom_jobs": f"""select {_rounded('''job_id completed_date customer_name service_name crew_name city
        ~billed_revenue ~gross_profit ~gross_margin_pct''')}
        from (select * from fact order by gross_profit nulls last, job_id limit 15)""",
    "win_rate_by_channel": f"""select c.acquisition_channel, {_list(SENT, WON, WIN_RATE, QUOTED)}
        from estimates_t e left join customers_t c on c.customer_id = e.customer_id group by 1""",
    "quoted_by_month": f"""select cast(date_trunc('month', estimate_date) as date) as month, {_list(SENT, QUOTED)}
        from estimates_t group by 1""",
    "quoted_by_status": f"select estimate_status, {_list(SENT, QUOTED, AVG_QUOTE)} from estimates_t group by 1",
    "win_rate_by_size": f"""select band, case band when 1 then '$0 to $500' when 2 then '$500 to $1,000'
          when 3 then '$1,000 to $2,500' when 4 then '$2,500 to $4,000' else '$4,000 and up' end as quote_size,
          {_list(SENT, WON, WIN_RATE, QUOTED, AVG_QUOTE)}
        from (select *, cast(1 + (quoted_revenue >= 500)::int + (quoted_revenue >= 1000)::int
              + (quoted_revenue >= 2500)::int + (quoted_revenue >= 4000)::int as int) as band from estimates_t)
        group by 1""",
    "customer_type_value": _value_by("customer_type"),
    "revenue_by_channel": _value_by("acquisition_channel"),
    "top_customers": f"""select customer_id, customer_name, {_list(f'{ROWS} as jobs_completed', REVENUE)}
        from fact group by 1, 2
        order by sum(billed_revenue) desc nulls last, customer_id nulls last limit 15""",
    "customer_review": f"""select customer_id, customer_name, {_list(f'{ROWS} as jobs_completed', REVENUE, PROFIT, MARGIN)},
          count(*) filter (where gross_profit < 0) as loss_jobs
        from fact group by 1, 2""",
    "win_vs_margin": f"""
        select w.service_id, w.service_name, w.estimates_sent, w.win_rate, r.jobs_completed, r.revenue, r.gross_margin_pct
        from ({SCORECARDS['estimate_scorecard']}) w left join ({SCORECARDS['service_scorecard']}) r
          on r.service_id = w.service_id""",
    "overrun_review": f"""select service_name, crew_name, {ROWS} as overrun_jobs,
          {_sum('labor_variance_hours', 'excess_hours')}, {_avg('labor_variance_pct', 'avg_overrun_pct')}
        from fact where labor_variance_pct > 0.1 group by 1, 2""",
    "margin_vs_target": f"""select service_id, service_name, cast(target_margin as double) as target_margin,
          {_list(REVENUE, PROFIT, MARGIN)}, {_r(_MARGIN + ' - target_margin', 'margin_gap')}
        from fact group by service_id, service_name, target_margin""",
}

DIRTY = {"quality_gate_dirty", "constraint_report_dirty"}


def _spell_out(sql: str) -> str:
    """Replace ``six(x)`` by its arithmetic, as one statement cannot define a macro.

    Doubles are compared to nine significant digits, since the last bits of a sum depend on its
    order. Means over 16 or 32 rows often end exactly half way between two such values; the small
    factor moves them away from there. __spark_entry__ does the same.
    """
    while (start := sql.find("six(")) >= 0:
        end, depth = start + 4, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        x = f"({sql[start + 4 : end - 1]})"
        exact = f"cast(printf('%.8e', {x} * 1.0000000000137e0 + 0e0) as double)"
        sql = sql[:start] + exact + sql[end:]
    return sql


# A table that went through CSV is the staged table.
BODIES |= {
    f"csv_{name}": BODIES[f"stage_{name}"]
    for name in ("customers", "services", "crews", "employees", "estimates", "jobs", "job_labor", "invoices", "weather")
}

# An export reads back as the published table.
BODIES |= {f"exported_{name}": BODIES[name] for name in ("job_fact", *SCORECARDS)}
# Sort orders and selections of one answer.
BODIES |= {name: BODIES["crew_dashboard"] for name in ("crew_dashboard_by_hour", "crew_dashboard_by_margin")}
BODIES["pipeline_ranking_table"] = BODIES["pipeline_ranking"]
BODIES["active_customers"] = "select count(distinct customer_id) as active_customers from picked"
BODIES["active_customers_narrow"] = f"{BODIES['active_customers']} where {NARROW}"
# Every table and view of a full refresh.
REFRESHED = {
    "staged_customers": "customers_t", "staged_services": "services_t", "staged_crews": "crews_t",
    "staged_employees": "employees_t", "staged_estimates": "estimates_t", "staged_jobs": "jobs_t",
    "staged_job_labor": "labor_t", "staged_invoices": "invoices_t", "staged_weather_daily": "weather_t",
    "labor_rollup": "labor_sums", "job_economics": "economics", "job_fact": "fact",
    **{name: f"({sql})" for name, sql in SCORECARDS.items()},
}
# Columns of these tables as (name, kind); kinds: t text, d date, i whole number, f double.
SHAPES = {
    "staged_customers": "customer_id:i customer_name:t customer_type:t city:t zip_code:t signup_date:d customer_status:t "
    "contract_type:t acquisition_channel:t property_tier:t",
    "staged_services": "service_id:i service_name:t service_category:t billing_type:t default_price:f default_est_labor_hours:f "
    "default_material_cost:f target_margin:f",
    "staged_crews": "crew_id:i crew_name:t home_base:t supervisor:t crew_size:i labor_efficiency_factor:f",
    "staged_employees": "employee_id:i employee_name:t crew_id:i role:t hourly_rate:f hire_date:d",
    "staged_estimates": "estimate_id:i customer_id:i service_id:i estimate_date:d quoted_revenue:f quoted_labor_hours:f "
    "quoted_material_cost:f estimate_status:t won_date:d",
    "staged_jobs": "job_id:i estimate_id:i customer_id:i service_id:i crew_id:i scheduled_date:d completed_date:d job_status:t city:t "
    "billed_revenue:f estimated_labor_hours:f actual_labor_hours:f estimated_material_cost:f actual_material_cost:f rework_flag:i "
    "weather_delay_flag:i travel_minutes:i customer_rating:f",
    "staged_job_labor": "job_id:i employee_id:i crew_id:i work_date:d labor_hours:f labor_cost:f",
    "staged_invoices": "invoice_id:i job_id:i customer_id:i invoice_date:d invoice_amount:f payment_status:t days_to_pay:i paid_date:d",
    "staged_weather_daily": "weather_date:d city:t high_temp_f:f precip_inches:f rain_flag:i severe_weather_flag:i",
    "labor_rollup": "job_id:i labor_hours_from_detail:f labor_cost:f",
    "job_fact": "job_id:i estimate_id:i scheduled_date:d completed_date:d completed_month:d customer_id:i customer_name:t customer_type:t "
    "contract_type:t acquisition_channel:t property_tier:t service_id:i service_name:t service_category:t billing_type:t "
    "target_margin:f crew_id:i crew_name:t crew_home_base:t city:t billed_revenue:f labor_cost:f actual_material_cost:f gross_profit:f "
    "gross_margin_pct:f estimated_labor_hours:f actual_labor_hours:f labor_variance_hours:f labor_variance_pct:f "
    "estimated_material_cost:f material_variance:f material_variance_pct:f rework_flag:i weather_delay_flag:i travel_minutes:i "
    "customer_rating:f",
    "monthly_scorecard": "completed_month:d jobs_completed:i active_customers:i revenue:f labor_cost:f material_cost:f gross_profit:f "
    "gross_margin_pct:f avg_job_value:f revenue_per_labor_hour:f rework_rate:f weather_delay_rate:f avg_customer_rating:f",
    "crew_scorecard": "crew_id:i crew_name:t jobs_completed:i revenue:f gross_profit:f gross_margin_pct:f actual_labor_hours:f "
    "revenue_per_labor_hour:f avg_labor_variance_pct:f rework_rate:f avg_travel_minutes:f avg_customer_rating:f",
    "service_scorecard": "service_id:i service_name:t service_category:t billing_type:t jobs_completed:i revenue:f gross_profit:f "
    "gross_margin_pct:f avg_labor_variance_pct:f avg_material_variance_pct:f avg_customer_rating:f",
    "city_scorecard": "city:t jobs_completed:i customers_served:i revenue:f gross_profit:f gross_margin_pct:f avg_travel_minutes:f "
    "weather_delay_rate:f avg_customer_rating:f",
    "estimate_scorecard": "service_id:i service_name:t estimates_sent:i estimates_won:i win_rate:f quoted_value:f avg_estimate_value:f",
}
SHAPES["job_economics"] = f"{SHAPES['staged_jobs']} " + " ".join(
    f"{c}:f" for c in (
        "labor_cost", "gross_profit", "gross_margin_pct", "labor_variance_hours", "labor_variance_pct", "material_variance",
        "material_variance_pct",
    )
)


def _profiled(table: str, source: str) -> str:
    """One row per column: rows, values, smallest and largest as text, and the sum of numbers."""
    rows = []
    for column, kind in (item.split(":") for item in SHAPES[table].split()):
        text = f"cast({column} as varchar)" if kind != "f" else "cast(null as varchar)"
        least, greatest = (f"cast({f}({column}) as varchar)" if kind in "di" else f"{f}({text})" for f in ("min", "max"))
        total = f"six(cast(sum({column}) as double))" if kind in "if" else "cast(null as double)"
        rows.append(
            f"select '{table}' as table_name, '{column}' as column_name, {ROWS} as n_rows, cast(count({column}) as bigint) as n_values, "
            f"{least} as least, {greatest} as greatest, {total} as total from {source}"
        )
    return " union all ".join(rows)


BODIES["refreshed_tables"] = " union all ".join(_profiled(name, source) for name, source in REFRESHED.items())
BODIES["refreshed_after_change"] = " union all ".join(
    _profiled(name, REFRESHED[name]) for name in ("job_fact", "monthly_scorecard", "crew_scorecard", "service_scorecard", "city_scorecard")
)
# The same answers from selection cells and customer bitmaps.
for _name in (
    "kpi_totals", "kpi_totals_narrow", "monthly_trend_dense", "revenue_by_service", "margin_by_service", "revenue_by_city",
    "crew_efficiency", "crew_dashboard", "insights", *(card for card in SCORECARDS if card != "estimate_scorecard"),
):
    BODIES[f"{_name}_from_cells"] = BODIES[_name]
for _name in ("active_customers", "active_customers_narrow"):
    BODIES[f"{_name}_from_bitmaps"] = BODIES[_name]
BODIES["selection_state"] = """
    select 'completed 1996-03-15 to 1998-09-30; city in (NATION_1, NATION_12, NATION_20, NATION_7); service in (ECONOMY, PROMO, STANDARD); '
      || 'crew in (Crew AMERICA, Crew ASIA, Crew EUROPE)' as selection, count(*) > 0 as has_jobs from picked where """ + NARROW + """
    union all select 'city in (Nowhere)', count(*) > 0 from picked where city = 'Nowhere'"""
BODIES["filtered_jobs_long_list"] = f"select {_rounded(FACT_COLUMNS)} from picked where city in (select 'NATION_' || x from range(3, 10003) t(x))"

BODIES["job_economics_copartitioned"] = BODIES["job_economics"]


def _count(x: str) -> str:
    return f"format('{{:,}}', cast({x} as bigint))"


def _percent(x: str) -> str:
    return f"printf('%.1f%%', ({x}) * 100)"


def _risk_cards(where: str) -> str:
    return f"""
    select unnest([
        struct_pack(card := 'Jobs', value := {_count('n')}), struct_pack(card := 'Gross Margin', value := {_percent('margin')}),
        struct_pack(card := 'Jobs Losing Money', value := {_count('losses')}),
        struct_pack(card := 'Jobs >10% Labor Over', value := {_count('overs')})], recursive := true)
    from (select count(*) as n, sum(gross_profit) / nullif(sum(billed_revenue), 0) as margin,
        count(*) filter (where gross_profit < 0) as losses, count(*) filter (where labor_variance_pct > 1e-1) as overs
      from picked where {where}) as risks"""


BODIES["risk_cards"], BODIES["risk_cards_narrow"] = _risk_cards("true"), _risk_cards(NARROW)
BODIES["estimate_cards"] = f"""
    select unnest([
        struct_pack(card := 'Estimates Sent', value := {_count('sent')}), struct_pack(card := 'Estimates Won', value := {_count('won')}),
        struct_pack(card := 'Win Rate', value := {_percent('won / sent')}), struct_pack(card := 'Quoted Value', value := {_money('quoted')})],
      recursive := true)
    from (select count(*) as sent, count(*) filter (where estimate_status = 'Won') as won, sum(quoted_revenue) as quoted from estimates_t) as e"""
BODIES["review_cards"] = f"""
    select unnest([
        struct_pack(card := 'Revenue reviewed', value := {_money('revenue')}), struct_pack(card := 'Gross profit', value := {_money('profit')}),
        struct_pack(card := 'Portfolio margin', value := {_percent('profit / revenue')}),
        struct_pack(card := 'Completed jobs', value := {_count('n')})], recursive := true)
    from (select sum(billed_revenue) as revenue, sum(gross_profit) as profit, count(*) as n from story) as r"""
BODIES["warning_cards"] = f"""
    select unnest([
        struct_pack(card := 'Crew needing attention', value := crew_name),
        struct_pack(card := 'Labor variance', value := {_percent('avg_labor_variance')}),
        struct_pack(card := 'Crew margin', value := {_percent('gross_margin')}),
        struct_pack(card := 'Gap vs portfolio', value := printf('%+.1f pts', (gross_margin - margin) * 100))], recursive := true)
    from focus, portfolio"""
BODIES["evidence_cards"] = f"""
    select unnest([
        struct_pack(card := 'Excess labor hours', value := {_count('round_even(excess_hours, 0)')}),
        struct_pack(card := 'Rework rate', value := {_percent('rework_rate')}),
        struct_pack(card := 'Revenue / labor hour', value := {_money('revenue_per_labor_hour')})], recursive := true)
    from focus"""

# The rules of the misspelt binding; a job id itself may be the malformed text.
_KEY = "case when job_id % 109 = 0 then 'J' || job_id else cast(job_id as varchar) end"
_BAD_JOBS = {
    "job_id": ("job_id % 109 = 0", _KEY, "'not a key'"),
    "completed_date": ("job_id % 107 = 0", "'1997-02-30'", "'not a date'"),
    "billed_revenue": (
        "(job_id % 101 = 0 or job_id % 103 = 0)", "case when job_id % 101 = 0 then '12d' else '' end",
        "case when job_id % 101 = 0 then 'not a double' else 'blank' end",
    ),
    "rework_flag": ("job_id % 202 = 0", "'yes'", "'not a int'"),
}
BODIES["rejected_rows"] = " union all ".join(
    f"select 'jobs' as table_name, {_KEY} as row_key, '{column}' as column_name, {text} as text, {reason} as reason from raw_jobs where {bad}"
    for column, (bad, text, reason) in _BAD_JOBS.items()
) + """
    union all select 'estimates', cast(estimate_id as varchar), 'quoted_revenue', 'NaN', 'not a double' from raw_estimates
    where estimate_id % 19 = 0"""
BODIES["accepted_jobs"] = f"""
    select {_rounded(JOB_COLUMNS)} from (select * replace (case when job_id % 113 = 0 then null else estimate_id end as estimate_id) from jobs_t)
    where not ({' or '.join(bad for bad, *_ in _BAD_JOBS.values())})"""
BODIES["job_value_margin_bins"] = f"""
    select * from (with points as (select billed_revenue as v, gross_margin_pct as m from picked where billed_revenue is not null and gross_margin_pct is not null),
    bounds as (select min(v) as a0, max(v) as a1, min(m) as b0, max(m) as b1 from points),
    binned as (
      select cast(least(floor((v - a0) / (a1 - a0) * 50), 49) as integer) as value_bin,
        cast(least(floor((m - b0) / (b1 - b0) * 50), 49) as integer) as margin_bin
      from points, bounds)
    select value_bin, margin_bin, six(a0 + (a1 - a0) * value_bin / 50) as value_from, six(b0 + (b1 - b0) * margin_bin / 50) as margin_from,
      {ROWS} as jobs
    from binned, bounds group by value_bin, margin_bin, a0, a1, b0, b1) as grid"""
BODIES["job_detail_pages"] = f"""
    select job_id, completed_date, customer_name, service_name, crew_name, city, {_rounded('~billed_revenue ~gross_profit ~gross_margin_pct')},
      {_rounded('~estimated_labor_hours ~actual_labor_hours ~labor_variance_pct')}, rework_flag, cast((place - 1) // 40 + 1 as integer) as page
    from (select *, row_number() over (order by gross_profit nulls last, job_id) as place from picked) where place <= 120"""

ORACLES: dict[str, str] = {
    name: with_tables(
        _spell_out(body), dirty=name in DIRTY, changed=name == "refreshed_after_change", **CREWS, **STORY, **HEADLINES
    )
    for name, body in BODIES.items()
}
