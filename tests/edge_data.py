"""Hand-made raw tables, all strings as a CSV reader delivers them (None = unquoted blank)."""

from jobmargin.sources.schemas import RAW_TABLES, raw_schema

DEFAULTS = {
    "customers": dict(
        customer_id="1", customer_name="Ada", customer_type="Residential", city="Oak", zip_code="1",
        signup_date="2024-05-01", status="Active", contract_type="Recurring", acquisition_channel="Web",
        property_tier="Basic",
    ),
    "services": dict(
        service_id="1", service_name="Mowing", service_category="Care", billing_type="recurring", default_price="70",
        default_est_labor_hours="1.5", default_material_cost="8", target_margin="0.3",
    ),
    "crews": dict(
        crew_id="1", crew_name="North", home_base="Oak", supervisor="Sam", crew_size="3", labor_efficiency_factor="1.0"
    ),
    "employees": dict(
        employee_id="1", employee_name="Lee", crew_id="1", role="Lead", hourly_rate="20", hire_date="2024-01-02"
    ),
    "estimates": dict(
        estimate_id="1", customer_id="1", service_id="1", estimate_date="2025-01-03", quoted_revenue="100",
        quoted_labor_hours="2", quoted_material_cost="10", estimate_status="Won", won_date="2025-01-09",
    ),
    "jobs": dict(
        job_id="1", estimate_id="1", customer_id="1", service_id="1", crew_id="1", scheduled_date="2025-01-10",
        completed_date="2025-01-11", job_status="Completed", city="Oak", billed_revenue="100",
        estimated_labor_hours="2", actual_labor_hours="3", estimated_material_cost="10", actual_material_cost="12",
        rework_flag="0", weather_delay_flag="0", travel_minutes="15", customer_rating="4.5",
    ),
    "job_labor": dict(
        job_id="1", employee_id="1", crew_id="1", work_date="2025-01-11", labor_hours="3", labor_cost="30"
    ),
    "invoices": dict(
        invoice_id="1", job_id="1", customer_id="1", invoice_date="2025-01-12", invoice_amount="100",
        payment_status="Paid", days_to_pay="14", paid_date="2025-01-26",
    ),
    "weather_daily": dict(
        date="2025-01-11", city="Oak", high_temp_f="50", precip_inches="0.1", rain_flag="1", severe_weather_flag="0"
    ),
}


def raw_table(spark, table, *rows):
    """Rows given as differences from the default row."""
    full = [{**DEFAULTS[table], **row} for row in rows]
    return spark.createDataFrame([[r[f.source] for f in RAW_TABLES[table]] for r in full], raw_schema(table))


def raw_tables(spark, **rows):
    """All nine tables; those not named hold their default row only."""
    return {t: raw_table(spark, t, *rows.get(t, [{}])) for t in RAW_TABLES}
