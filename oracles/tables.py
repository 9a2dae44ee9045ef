"""CTEs shared by all oracles: the nine raw tables, their typed form, the job fact.

The raw tables are FIXTURES.md section 4, written for DuckDB.
"""

RAW = {
    "raw_customers": """
        select c_custkey as customer_id, c_name as customer_name,
          case when c_mktsegment in ('BUILDING','MACHINERY') then 'Commercial' else 'Residential' end as customer_type,
          n_name as city, cast(c_nationkey as varchar) as zip_code,
          date '1995-01-01' - cast(c_custkey % 365 as int) as signup_date,
          case when c_acctbal < 0 then 'Inactive' else 'Active' end as status,
          case when c_custkey % 2 = 0 then 'Recurring' else 'One-Time' end as contract_type,
          c_mktsegment as acquisition_channel,
          case when c_acctbal < 0 then 'Basic' when c_acctbal < 5000 then 'Standard' else 'Premium' end as property_tier
        from customer join nation on c_nationkey = n_nationkey""",
    "raw_services": """
        select cast(row_number() over (order by p_type) as int) as service_id, p_type as service_name,
          case when p_type in ('ECONOMY','STANDARD') then 'Recurring Maintenance' else 'Project' end as service_category,
          case when p_type in ('ECONOMY','STANDARD') then 'recurring' else 'one-time' end as billing_type,
          avg(p_retailprice) as default_price, avg(p_size) as default_est_labor_hours,
          avg(p_retailprice) * 2e-1 as default_material_cost, 35e-2 as target_margin
        from part group by p_type""",
    "raw_crews": """
        select r_regionkey + 1 as crew_id, 'Crew ' || r_name as crew_name, r_name as home_base,
          'Supervisor ' || r_name as supervisor, 3 as crew_size, 9e-1 + r_regionkey * 5e-2 as labor_efficiency_factor
        from region""",
    "raw_employees": """
        select s_suppkey as employee_id, s_name as employee_name, n_regionkey + 1 as crew_id,
          case when s_suppkey % 3 = 0 then 'Crew Lead' else 'Landscape Technician' end as role,
          18e0 + s_suppkey % 8 as hourly_rate, date '1995-01-01' - cast(s_suppkey % 900 as int) as hire_date
        from supplier join nation on s_nationkey = n_nationkey""",
    "raw_estimates": """
        select o_orderkey as estimate_id, o_custkey as customer_id, cast(o_orderkey % 6 + 1 as int) as service_id,
          cast(o_orderdate as date) as estimate_date, o_totalprice / 1e2 as quoted_revenue,
          1e0 + (o_orderkey % 40) / 4e0 as quoted_labor_hours, o_totalprice * 3e-3 as quoted_material_cost,
          case o_orderstatus when 'F' then 'Won' when 'O' then 'Lost' else 'Pending' end as estimate_status,
          case when o_orderstatus = 'F' then cast(cast(o_orderdate as date) + 7 as varchar) else '' end as won_date
        from orders""",
    "raw_jobs": """
        select o_orderkey as job_id, case when o_orderstatus = 'F' then cast(o_orderkey as varchar) else '' end as estimate_id,
          o_custkey as customer_id, cast(o_orderkey % 6 + 1 as int) as service_id, n_regionkey + 1 as crew_id,
          cast(o_orderdate as date) as scheduled_date,
          cast(o_orderdate as date) + cast(o_orderkey % 10 as int) as completed_date,
          case when o_orderstatus = 'P' then 'In Progress' else 'Completed' end as job_status, n_name as city,
          case when o_orderkey % 997 = 0 then 0e0 else o_totalprice / 1e2 end as billed_revenue,
          case when o_orderkey % 50 = 0 then 0e0 else 1e0 + ((o_orderkey * 7) % 40) / 4e0 end as estimated_labor_hours,
          1e0 + (o_orderkey % 41) / 4e0 as actual_labor_hours,
          case when o_orderkey % 60 = 0 then 0e0 else o_totalprice * 25e-4 end as estimated_material_cost,
          o_totalprice * (2e-3 + (o_orderkey % 5) * 5e-4) as actual_material_cost,
          case when o_orderkey % 29 = 0 then 1 else 0 end as rework_flag,
          case when o_orderkey % 9 = 0 then 1 else 0 end as weather_delay_flag,
          cast(10 + o_custkey % 45 as int) as travel_minutes,
          case when o_orderkey % 13 = 0 then null else 3e0 + (o_orderkey % 5) * 5e-1 end as customer_rating
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "raw_job_labor": """
        select l_orderkey as job_id, l_suppkey as employee_id, n_regionkey + 1 as crew_id,
          cast(l_shipdate as date) as work_date, l_quantity / 1e1 as labor_hours,
          l_quantity / 1e1 * (18e0 + l_suppkey % 8) as labor_cost
        from lineitem left join supplier on l_suppkey = s_suppkey left join nation on s_nationkey = n_nationkey""",
    "raw_invoices": """
        select o_orderkey as invoice_id, o_orderkey as job_id, o_custkey as customer_id,
          cast(o_orderdate as date) + 10 as invoice_date, o_totalprice / 1e2 as invoice_amount,
          case when o_orderstatus = 'F' then 'Paid' else 'Open' end as payment_status,
          case when o_orderstatus = 'F' then cast(o_orderkey % 60 as varchar) else '' end as days_to_pay,
          case when o_orderstatus = 'F'
            then cast(cast(o_orderdate as date) + 10 + cast(o_orderkey % 60 as int) as varchar) else '' end as paid_date
        from orders""",
    "raw_weather": """
        select cast(ts as date) as date, event_type as city, avg(value) as high_temp_f, min(value) / 1e2 as precip_inches,
          case when min(value) < 1e0 then 1 else 0 end as rain_flag,
          case when max(value) > 4e2 then 1 else 0 end as severe_weather_flag
        from events group by 1, 2""",
}

# FIXTURES.md section 6: the same tables with known defects.
DIRTY = {
    "raw_customers": f"select * from ({RAW['raw_customers']}) where customer_id % 97 <> 0",
    "raw_jobs": f"""
        with damaged as (
          select * replace (
            case when job_id % 211 = 0 then 99 else crew_id end as crew_id,
            case when job_id % 401 = 0 then null else completed_date end as completed_date,
            case when job_id % 301 = 0 then -billed_revenue else billed_revenue end as billed_revenue)
          from ({RAW['raw_jobs']}))
        select * from damaged union all select * from damaged where job_id % 500 = 0""",
}

# The same tables after some jobs and their labor changed.
_CHANGES = "scheduled_date between date '1997-03-01' and date '1997-04-30'"
CHANGED = {
    "raw_jobs": f"""
        select * replace (
          case when {_CHANGES} and job_id % 7 = 3 then billed_revenue * 125e-2 else billed_revenue end as billed_revenue,
          case when {_CHANGES} and job_id % 7 = 4 then completed_date + 40
            when {_CHANGES} and job_id % 7 = 6 then null else completed_date end as completed_date)
        from ({RAW['raw_jobs']}) where not ({_CHANGES} and job_id % 7 = 5)""",
    "raw_job_labor": f"""
        select * replace (case when job_id % 7 = 3
            and job_id in (select o_orderkey from orders where cast(o_orderdate as date) between date '1997-03-01' and date '1997-04-30')
            then labor_cost * 2 else labor_cost end as labor_cost)
        from ({RAW['raw_job_labor']})""",
}

TYPED = {
    "customers_t": "select * rename (status as customer_status) from raw_customers",
    "services_t": "select * replace (service_id::bigint as service_id) from raw_services",
    "crews_t": "select * replace (crew_id::bigint as crew_id) from raw_crews",
    "employees_t": "select * replace (crew_id::bigint as crew_id) from raw_employees",
    "estimates_t": """
        select * replace (service_id::bigint as service_id, try_cast(nullif(won_date, '') as date) as won_date)
        from raw_estimates""",
    "jobs_t": """
        select * replace (try_cast(nullif(estimate_id, '') as bigint) as estimate_id,
          service_id::bigint as service_id, crew_id::bigint as crew_id)
        from raw_jobs""",
    "labor_t": "select * replace (crew_id::bigint as crew_id) from raw_job_labor",
    "invoices_t": """
        select * replace (try_cast(nullif(days_to_pay, '') as integer) as days_to_pay,
          try_cast(nullif(paid_date, '') as date) as paid_date)
        from raw_invoices""",
    "weather_t": "select * rename (date as weather_date) from raw_weather",
}

FACT = {
    "labor_sums": """
        select job_id, sum(labor_hours) as labor_hours_from_detail, sum(labor_cost) as labor_cost
        from labor_t group by job_id""",
    "costed": """
        select jobs_t.*, ifnull(labor_sums.labor_cost, 0e0) as labor_cost,
          billed_revenue - ifnull(labor_sums.labor_cost, 0e0) - actual_material_cost as gross_profit
        from jobs_t left join labor_sums on labor_sums.job_id = jobs_t.job_id""",
    "economics": """
        select *, gross_profit / nullif(billed_revenue, 0) as gross_margin_pct,
          actual_labor_hours - estimated_labor_hours as labor_variance_hours,
          (actual_labor_hours - estimated_labor_hours) / nullif(estimated_labor_hours, 0) as labor_variance_pct,
          actual_material_cost - estimated_material_cost as material_variance,
          (actual_material_cost - estimated_material_cost) / nullif(estimated_material_cost, 0) as material_variance_pct
        from costed""",
    "fact": """
        select x.job_id, x.estimate_id, x.scheduled_date, x.completed_date,
          cast(date_trunc('month', x.completed_date) as date) as completed_month,
          cu.customer_id, cu.customer_name, cu.customer_type, cu.contract_type, cu.acquisition_channel, cu.property_tier,
          se.service_id, se.service_name, se.service_category, se.billing_type, se.target_margin,
          cr.crew_id, cr.crew_name, cr.home_base as crew_home_base,
          x.city, x.billed_revenue, x.labor_cost, x.actual_material_cost, x.gross_profit, x.gross_margin_pct,
          x.estimated_labor_hours, x.actual_labor_hours, x.labor_variance_hours, x.labor_variance_pct,
          x.estimated_material_cost, x.material_variance, x.material_variance_pct,
          x.rework_flag, x.weather_delay_flag, x.travel_minutes, x.customer_rating
        from economics x
        left join customers_t cu on cu.customer_id = x.customer_id
        left join services_t se on se.service_id = x.service_id
        left join crews_t cr on cr.crew_id = x.crew_id""",
    "picked": """
        select * from fact
        where completed_date is not null and city is not null and service_name is not null and crew_name is not null""",
    "story": "select * from picked where completed_month < (select max(completed_month) from picked)",
}


def with_tables(body: str, dirty: bool = False, changed: bool = False, **more: str) -> str:
    """``body`` preceded by all shared CTEs and any further ones, in order."""
    ctes = {**RAW, **(DIRTY if dirty else {}), **(CHANGED if changed else {}), **TYPED, **FACT, **more}
    return "with " + ",\n".join(f"{name} as ({sql})" for name, sql in ctes.items()) + "\n" + body
