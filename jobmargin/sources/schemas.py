"""The nine input tables: column order, meaning and cast of every raw column.

Kinds: ``text`` passes through; ``key``, ``int``, ``double`` and ``date`` are required
casts; ``optional_*`` turns blank or malformed text into NULL. Ids are bigint so that job
and labor tables may pass two billion rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    source: str
    kind: str
    renamed: str | None = None

    @property
    def name(self) -> str:
        return self.renamed or self.source


def _fields(declaration: str) -> tuple[Field, ...]:
    """``source:kind`` or ``source:kind:new_name`` items, in column order."""
    return tuple(Field(*item.split(":")) for item in declaration.split())


# Table and column names are fixed values: the files to be read carry them.
RAW_TABLES: dict[str, tuple[Field, ...]] = {
    "customers": _fields(
        "customer_id:key customer_name:text customer_type:text city:text zip_code:text signup_date:date "
        "status:text:customer_status contract_type:text acquisition_channel:text property_tier:text"
    ),
    "services": _fields(
        "service_id:key service_name:text service_category:text billing_type:text default_price:double "
        "default_est_labor_hours:double default_material_cost:double target_margin:double"
    ),
    "crews": _fields(
        "crew_id:key crew_name:text home_base:text supervisor:text crew_size:int labor_efficiency_factor:double"
    ),
    "employees": _fields(
        "employee_id:key employee_name:text crew_id:key role:text hourly_rate:double hire_date:date"
    ),
    "estimates": _fields(
        "estimate_id:key customer_id:key service_id:key estimate_date:date quoted_revenue:double "
        "quoted_labor_hours:double quoted_material_cost:double estimate_status:text won_date:optional_date"
    ),
    "jobs": _fields(
        "job_id:key estimate_id:optional_key customer_id:key service_id:key crew_id:key scheduled_date:date "
        "completed_date:date job_status:text city:text billed_revenue:double estimated_labor_hours:double "
        "actual_labor_hours:double estimated_material_cost:double actual_material_cost:double rework_flag:int "
        "weather_delay_flag:int travel_minutes:int customer_rating:double"
    ),
    "job_labor": _fields(
        "job_id:key employee_id:key crew_id:key work_date:date labor_hours:double labor_cost:double"
    ),
    "invoices": _fields(
        "invoice_id:key job_id:key customer_id:key invoice_date:date invoice_amount:double payment_status:text "
        "days_to_pay:optional_int paid_date:optional_date"
    ),
    "weather_daily": _fields(
        "date:date:weather_date city:text high_temp_f:double precip_inches:double rain_flag:int "
        "severe_weather_flag:int"
    ),
}

_SPARK_TYPES = {
    "text": T.StringType(),
    "key": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
}


def raw_schema(table: str) -> T.StructType:
    """All-string schema: typing is staging's job, so inference never decides."""
    return T.StructType([T.StructField(f.source, T.StringType()) for f in RAW_TABLES[table]])


def staged_schema(table: str) -> T.StructType:
    return T.StructType(
        [T.StructField(f.name, _SPARK_TYPES[f.kind.removeprefix("optional_")]) for f in RAW_TABLES[table]]
    )


def require_columns(table: str, present: list[str]) -> None:
    missing = [f.source for f in RAW_TABLES[table] if f.source not in present]
    if missing:
        raise ValueError(f"raw table {table!r} lacks columns {missing}")
