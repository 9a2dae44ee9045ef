"""Strict casts and lossless CSV: texts that once became wrong data."""

import math

import pytest

from jobmargin.functions.casts import trimmed, typed
from jobmargin.operators.staging import stage
from jobmargin.session import run_folder
from jobmargin.sources.writers import export_csv


def cast(spark, text, kind):
    texts = spark.createDataFrame([(text,)], "c string").selectExpr(f"{trimmed('c')} as c")
    return texts.selectExpr(f"{typed('c', kind)} as v").first()["v"]


@pytest.mark.parametrize("kind, text", [
    ("date", "2025"), ("date", "2025-01"), ("date", "2025-01-02 junk"), ("date", "2025-01-02Tx"), ("date", "2025-02-30"),
    ("double", "12d"), ("double", "12f"), ("double", "NaN"), ("double", "Infinity"), ("double", "x"), ("double", ""),
    ("key", "12d"), ("key", "x"), ("key", "99999999999999999999"), ("int", "3000000000"), ("int", "1e"),
])
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_required_casts_raise(spark, kind, text, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="malformed value"):
            cast(spark, text, kind)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("kind, text, want", [
    ("date", "2025/01/02", "2025-01-02"), ("date", " 2025-1-2 ", "2025-01-02"), ("date", "2025-01-02T10:20:30Z", "2025-01-02"),
    ("date", "2025-01-02 00:00:00", "2025-01-02"), ("key", "12.0", "12"), ("key", "9007199254740993.0", "9007199254740993"),
    ("double", "1.5E7", "15000000.0"), ("double", " -.5 ", "-0.5"), ("int", "12.5", "13"), ("key", None, "None"),
    ("optional_int", "12d", "None"), ("optional_date", "2025-01-02 junk", "None"), ("optional_date", "2025-01-02Tx", "None"),
    ("optional_key", "9007199254740993.0", "9007199254740993"), ("optional_key", " ", "None"), ("key", " +7 ", "7"),
    ("key", "9223372036854775807", "9223372036854775807"), ("optional_int", "3000000000", "None"), ("int", "-0", "0"),
])
def test_accepted_texts(spark, kind, text, want):
    assert str(cast(spark, text, kind)) == want


def test_typed_columns_pass_through(spark):
    """Types that are the declared ones, or widen to them, are not read as text; NaN is a double like any other."""
    rows = [(1, 2, 3, "2025-01-02", float("nan"), 1.5)]
    raw = spark.createDataFrame(rows, "job_id int, employee_id long, crew_id short, work_date string, labor_hours double, labor_cost float")
    raw = raw.withColumn("work_date", raw.work_date.cast("timestamp"))
    staged = stage("job_labor", raw)
    row = staged.first()
    assert (row["job_id"], row["employee_id"], row["crew_id"], str(row["work_date"])) == (1, 2, 3, "2025-01-02")
    assert math.isnan(row["labor_hours"]) and row["labor_cost"] == 1.5
    text = staged._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in text.upper() and "raise_error" not in text
    assert dict(staged.dtypes)["crew_id"] == "bigint" and dict(staged.dtypes)["labor_cost"] == "double"


@pytest.mark.parametrize("dtype, value, kind, want", [
    ("long", 3_000_000_000, "int", None), ("long", 7, "int", 7), ("double", 12.5, "optional_int", 13),
    ("decimal(10,2)", "3.25", "double", 3.25), ("int", 20250102, "optional_date", None),
])
def test_other_types_follow_the_text_rules(spark, dtype, value, kind, want):
    raw = spark.sql(f"select cast('{value}' as {dtype}) as c")
    types = dict(raw.dtypes)
    if not (kind == "double" and dtype.startswith("decimal")):
        raw = raw.selectExpr(f"{trimmed('c', types['c'])} as c")
    read = raw.selectExpr(f"{typed('c', kind, dict(raw.dtypes)['c'])} as v")
    if want is None and not kind.startswith("optional_"):
        with pytest.raises(Exception, match="malformed value"):
            read.first()
    else:
        assert read.first()["v"] == want


def test_csv_round_trip_keeps_every_text(spark):
    rows = [
        ("  ACME  ", 12345678.5, 1), ("", 0.0001, 2), (None, None, 3), ('say "hi", twice', -1e7, 4), ("two\nlines", 1e300, 5),
        ("é,;\t", 1e-15, 6),
    ]
    df = spark.createDataFrame(rows, "name string, amount double, id int")
    path = run_folder(spark, "csv-test")
    export_csv(df, path)
    options = {"header": True, "nullValue": "\\N", "quote": '"', "escape": '"', "multiLine": True}
    back = spark.read.schema(df.schema).options(**options).csv(path)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[2]) == rows
    raw = {r["id"]: r["amount"] for r in spark.read.options(**options).csv(path).collect()}
    assert raw["1"] == "12345678.5" and raw["2"] == "0.0001" and raw["4"] == "-10000000.0"
