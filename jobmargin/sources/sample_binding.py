"""The nine raw tables, derived from the TPC-H-style test tables of TESTDATA.md.

Only tests and benchmarks use this module; production reads raw tables with
``sources.readers``. Everything is lazy, so a query scans just the columns it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


class TestTables:
    """Named access to ``<folder>/<name>.parquet``; a file's schema is inferred once per process."""

    __test__ = False
    _schemas: dict[str, StructType] = {}

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder, self._opened = spark, folder, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            path = f"{self._folder}/{name}.parquet"
            if path not in self._schemas:
                self._schemas[path] = self._spark.read.parquet(path).schema
            self._opened[name] = self._spark.read.schema(self._schemas[path]).parquet(path)
        return self._opened[name]

    def in_nation(self, located: DataFrame, nation_key: str) -> DataFrame:
        """``located`` rows joined to their nation."""
        return located.join(self["nation"], F.expr(f"{nation_key} = n_nationkey"))


SERVICE_OF_ORDER = "cast(o_orderkey % 6 + 1 as int) as service_id"
CREW_OF_NATION = "n_regionkey + 1 as crew_id"


def _if_won(value: str) -> str:
    """Text for won orders, blank for all others, as CSV sources leave it."""
    return f"if(o_orderstatus = 'F', cast({value} as string), '')"


def _hourly_rate(supplier_key: str) -> str:
    return f"18D + {supplier_key} % 8"


def customers(t: TestTables) -> DataFrame:
    return t.in_nation(t["customer"], "c_nationkey").selectExpr(
        "c_custkey as customer_id",
        "c_name as customer_name",
        "if(c_mktsegment in ('BUILDING', 'MACHINERY'), 'Commercial', 'Residential') as customer_type",
        "n_name as city",
        "cast(c_nationkey as string) as zip_code",
        "date_sub(date'1995-01-01', cast(c_custkey % 365 as int)) as signup_date",
        "if(c_acctbal < 0, 'Inactive', 'Active') as status",
        "if(c_custkey % 2 = 0, 'Recurring', 'One-Time') as contract_type",
        "c_mktsegment as acquisition_channel",
        "case when c_acctbal < 0 then 'Basic' when c_acctbal < 5000 then 'Standard' else 'Premium' end as property_tier",
    )


def services(t: TestTables) -> DataFrame:
    """One service per part type. The numbering window sees the distinct types only."""
    types = t["part"].groupBy("p_type").agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"))
    recurring = "p_type in ('ECONOMY', 'STANDARD')"
    return types.selectExpr(
        "row_number() over (order by p_type) as service_id",
        "p_type as service_name",
        f"if({recurring}, 'Recurring Maintenance', 'Project') as service_category",
        f"if({recurring}, 'recurring', 'one-time') as billing_type",
        "price as default_price",
        "size as default_est_labor_hours",
        "price * 0.2D as default_material_cost",
        "0.35D as target_margin",
    )


def crews(t: TestTables) -> DataFrame:
    return t["region"].selectExpr(
        "r_regionkey + 1 as crew_id",
        "'Crew ' || r_name as crew_name",
        "r_name as home_base",
        "'Supervisor ' || r_name as supervisor",
        "3 as crew_size",
        "0.9D + r_regionkey * 0.05D as labor_efficiency_factor",
    )


def employees(t: TestTables) -> DataFrame:
    return t.in_nation(t["supplier"], "s_nationkey").selectExpr(
        "s_suppkey as employee_id",
        "s_name as employee_name",
        CREW_OF_NATION,
        "if(s_suppkey % 3 = 0, 'Crew Lead', 'Landscape Technician') as role",
        f"{_hourly_rate('s_suppkey')} as hourly_rate",
        "date_sub(date'1995-01-01', cast(s_suppkey % 900 as int)) as hire_date",
    )


def estimates(t: TestTables) -> DataFrame:
    return t["orders"].selectExpr(
        "o_orderkey as estimate_id",
        "o_custkey as customer_id",
        SERVICE_OF_ORDER,
        "cast(o_orderdate as date) as estimate_date",
        "o_totalprice / 100D as quoted_revenue",
        "1D + (o_orderkey % 40) / 4D as quoted_labor_hours",
        "o_totalprice * 0.003D as quoted_material_cost",
        "case o_orderstatus when 'F' then 'Won' when 'O' then 'Lost' else 'Pending' end as estimate_status",
        f"{_if_won('date_add(cast(o_orderdate as date), 7)')} as won_date",
    )


def jobs(t: TestTables) -> DataFrame:
    orders = t["orders"].join(t["customer"], F.expr("o_custkey = c_custkey"))
    return t.in_nation(orders, "c_nationkey").selectExpr(
        "o_orderkey as job_id",
        f"{_if_won('o_orderkey')} as estimate_id",
        "o_custkey as customer_id",
        SERVICE_OF_ORDER,
        CREW_OF_NATION,
        "cast(o_orderdate as date) as scheduled_date",
        "date_add(cast(o_orderdate as date), cast(o_orderkey % 10 as int)) as completed_date",
        "if(o_orderstatus = 'P', 'In Progress', 'Completed') as job_status",
        "n_name as city",
        "if(o_orderkey % 997 = 0, 0D, o_totalprice / 100D) as billed_revenue",
        "if(o_orderkey % 50 = 0, 0D, 1D + ((o_orderkey * 7) % 40) / 4D) as estimated_labor_hours",
        "1D + (o_orderkey % 41) / 4D as actual_labor_hours",
        "if(o_orderkey % 60 = 0, 0D, o_totalprice * 0.0025D) as estimated_material_cost",
        "o_totalprice * (0.002D + (o_orderkey % 5) * 0.0005D) as actual_material_cost",
        "if(o_orderkey % 29 = 0, 1, 0) as rework_flag",
        "if(o_orderkey % 9 = 0, 1, 0) as weather_delay_flag",
        "cast(10 + o_custkey % 45 as int) as travel_minutes",
        "if(o_orderkey % 13 = 0, null, 3D + (o_orderkey % 5) * 0.5D) as customer_rating",
    )


def job_labor(t: TestTables) -> DataFrame:
    """One labor entry per line item, with the crew of the employee who logged it.

    The crew lookup is a left join on a provably unique key, so Catalyst drops it for
    readers that do not use the crew, and line items are then never shuffled by supplier.
    """
    crew_of = (
        t.in_nation(t["supplier"], "s_nationkey").groupBy("s_suppkey").agg(F.expr("min(n_regionkey + 1) as crew_id"))
    )
    return (
        t["lineitem"]
        .join(crew_of, F.expr("l_suppkey = s_suppkey"), "left")
        .selectExpr(
            "l_orderkey as job_id",
            "l_suppkey as employee_id",
            "crew_id",
            "cast(l_shipdate as date) as work_date",
            "l_quantity / 10D as labor_hours",
            f"l_quantity / 10D * ({_hourly_rate('l_suppkey')}) as labor_cost",
        )
    )


def invoices(t: TestTables) -> DataFrame:
    days = "cast(o_orderkey % 60 as int)"
    return t["orders"].selectExpr(
        "o_orderkey as invoice_id",
        "o_orderkey as job_id",
        "o_custkey as customer_id",
        "date_add(cast(o_orderdate as date), 10) as invoice_date",
        "o_totalprice / 100D as invoice_amount",
        "if(o_orderstatus = 'F', 'Paid', 'Open') as payment_status",
        f"{_if_won(days)} as days_to_pay",
        f"{_if_won(f'date_add(cast(o_orderdate as date), 10 + {days})')} as paid_date",
    )


def weather_daily(t: TestTables) -> DataFrame:
    by_day = t["events"].groupBy(F.expr("cast(ts as date) as date"), F.expr("event_type as city"))
    return by_day.agg(
        F.expr("avg(value) as high_temp_f"),
        F.expr("min(value) / 100D as precip_inches"),
        F.expr("if(min(value) < 1D, 1, 0) as rain_flag"),
        F.expr("if(max(value) > 400D, 1, 0) as severe_weather_flag"),
    )


def _damaged_jobs(t: TestTables) -> DataFrame:
    damaged = jobs(t).withColumns(
        {
            "crew_id": F.expr("if(job_id % 211 = 0, 99, crew_id)"),
            "completed_date": F.expr("if(job_id % 401 = 0, null, completed_date)"),
            "billed_revenue": F.expr("if(job_id % 301 = 0, -billed_revenue, billed_revenue)"),
        }
    )
    return damaged.withColumn("copy", F.expr("explode(array_repeat(0, if(job_id % 500 = 0, 2, 1)))")).drop("copy")


# Jobs that change between two loads: those scheduled in two months of 1997, by their id modulo 7.
AMENDED = "scheduled_date between date'1997-03-01' and date'1997-04-30'"


def _amended_jobs(t: TestTables) -> DataFrame:
    """Some jobs are billed higher, some finish 40 days later, some lose their date, some are gone."""
    return jobs(t).filter(f"not ({AMENDED} and job_id % 7 = 5)").withColumns(
        {
            "billed_revenue": F.expr(f"if({AMENDED} and job_id % 7 = 3, billed_revenue * 1.25D, billed_revenue)"),
            "completed_date": F.expr(
                f"case when {AMENDED} and job_id % 7 = 4 then date_add(completed_date, 40) when {AMENDED} and job_id % 7 = 6 then null "
                "else completed_date end"
            ),
        }
    )


def _amended_labor(t: TestTables) -> DataFrame:
    """The labor of the jobs billed higher costs twice as much."""
    dated = t["orders"].selectExpr("o_orderkey as of_job", "cast(o_orderdate as date) as scheduled_date", "o_orderkey as job_id")
    raised = dated.filter(f"{AMENDED} and job_id % 7 = 3").select("of_job")
    labor = job_labor(t).join(raised, F.expr("job_id = of_job"), "left")
    return labor.withColumn("labor_cost", F.expr("if(of_job is null, labor_cost, labor_cost * 2)")).drop("of_job")


def _missing_customers(t: TestTables) -> DataFrame:
    return customers(t).filter("customer_id % 97 <> 0")


def _misspelt_jobs(t: TestTables) -> DataFrame:
    """Jobs as text, as a CSV source delivers them, some of it malformed."""
    texts = jobs(t).selectExpr("job_id as id", "*")
    spelt = texts.select("id", *[F.col(c).cast("string").alias(c) for c in texts.columns[1:]])
    return spelt.withColumns(
        {
            "billed_revenue": F.expr("case when id % 101 = 0 then '12d' when id % 103 = 0 then ' ' else billed_revenue end"),
            "completed_date": F.expr("if(id % 107 = 0, '1997-02-30', completed_date)"),
            "job_id": F.expr("if(id % 109 = 0, 'J' || job_id, '  ' || job_id || ' ')"),
            "estimate_id": F.expr("if(id % 113 = 0, 'none', estimate_id)"),
            "rework_flag": F.expr("if(id % 202 = 0, 'yes', rework_flag)"),
        }
    ).drop("id")


def _misspelt_estimates(t: TestTables) -> DataFrame:
    spelt = estimates(t).withColumn("won_date", F.expr("if(estimate_id % 17 = 0, 'soon', won_date)"))
    return spelt.withColumn("quoted_revenue", F.expr("if(estimate_id % 19 = 0, 'NaN', string(quoted_revenue))"))


BINDINGS: dict[str, Callable[[TestTables], DataFrame]] = {
    "customers": customers,
    "services": services,
    "crews": crews,
    "employees": employees,
    "estimates": estimates,
    "jobs": jobs,
    "job_labor": job_labor,
    "invoices": invoices,
    "weather_daily": weather_daily,
}
CHANGED = {**BINDINGS, "jobs": _amended_jobs, "job_labor": _amended_labor}
MISSPELT = {**BINDINGS, "jobs": _misspelt_jobs, "estimates": _misspelt_estimates}
DAMAGED = {**BINDINGS, "customers": _missing_customers, "jobs": _damaged_jobs}


class Bound(Mapping[str, DataFrame]):
    """The nine raw tables over the test tables in ``folder``, each opened on first use."""

    def __init__(self, spark: SparkSession, folder: str, bindings: Mapping[str, Callable] = BINDINGS):
        self._tables, self._bindings = TestTables(spark, folder), bindings

    def __getitem__(self, name: str) -> DataFrame:
        return self._bindings[name](self._tables)

    def __iter__(self) -> Iterator[str]:
        return iter(self._bindings)

    def __len__(self) -> int:
        return len(self._bindings)


def bind(spark: SparkSession, folder: str) -> Bound:
    return Bound(spark, folder)


def bind_dirty(spark: SparkSession, folder: str) -> Bound:
    """The same tables with known defects, so that every quality rule has something to find."""
    return Bound(spark, folder, DAMAGED)


def bind_changed(spark: SparkSession, folder: str) -> Bound:
    """The same tables after some jobs and their labor changed."""
    return Bound(spark, folder, CHANGED)


def changed_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """``job_id`` of all jobs that differ between ``bind`` and ``bind_changed``."""
    return bind(spark, folder)["jobs"].filter(f"{AMENDED} and job_id % 7 between 3 and 6").select("job_id")


def bind_misspelt(spark: SparkSession, folder: str) -> Bound:
    """The same tables with malformed texts in jobs and estimates."""
    return Bound(spark, folder, MISSPELT)
