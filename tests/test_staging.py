from datetime import date

import pytest
from pyspark.errors import PySparkException

from jobmargin.operators.staging import Staged, stage
from jobmargin.sources.schemas import RAW_TABLES, staged_schema
from tests.edge_data import raw_table, raw_tables


@pytest.mark.parametrize("table", RAW_TABLES)
def test_staged_schema(spark, table):
    staged = stage(table, raw_table(spark, table, {}))
    assert [(f.name, f.dataType) for f in staged.schema] == [(f.name, f.dataType) for f in staged_schema(table)]


def _one_column(spark, table, column, *texts):
    rows = raw_table(spark, table, *[{column: t} for t in texts])
    return [r[column] for r in stage(table, rows).select(column).collect()]


def test_optional_estimate_id(spark):
    texts = ["", "abc", "12", "12.0", "12.5", " 7 ", None, "-3", "9007199254740993"]
    want = [None, None, 12, 12, 13, 7, None, -3, 9007199254740993]
    assert _one_column(spark, "jobs", "estimate_id", *texts) == want


def test_optional_won_date(spark):
    texts = ["", "2025-13-01", "2025-02-03", None, "2025", "2025-02", "soon", "2025/02/03", "2025-02-03 10:00:00"]
    day = date(2025, 2, 3)
    assert _one_column(spark, "estimates", "won_date", *texts) == [None, None, day, None, None, None, None, day, day]


def test_optional_payment_columns(spark):
    assert _one_column(spark, "invoices", "days_to_pay", "", "30", "x") == [None, 30, None]
    assert _one_column(spark, "invoices", "paid_date", "", "2025-03-01", "x") == [None, date(2025, 3, 1), None]


@pytest.mark.parametrize("column", ["billed_revenue", "job_id", "completed_date", "rework_flag"])
def test_required_column_rejects_bad_text(spark, column):
    with pytest.raises(PySparkException):
        stage("jobs", raw_table(spark, "jobs", {column: "x"})).collect()


def test_required_column_keeps_null(spark):
    assert _one_column(spark, "jobs", "customer_rating", None, "4.5") == [None, 4.5]


def test_optional_cast_accepts_typed_input(spark):
    raw = raw_table(spark, "estimates", {}).selectExpr("* except (won_date)", "date'2025-01-09' as won_date")
    assert stage("estimates", raw).first()["won_date"] == date(2025, 1, 9)


def test_missing_column_is_reported(spark):
    with pytest.raises(ValueError, match="city"):
        stage("jobs", raw_table(spark, "jobs", {}).drop("city"))


def test_missing_table_is_reported(spark):
    raw = raw_tables(spark)
    del raw["crews"]
    with pytest.raises(KeyError, match="crews"):
        Staged(raw)["crews"]
