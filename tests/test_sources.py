import csv

import pytest

from jobmargin.operators.fact import FACT_COLUMNS
from jobmargin.operators.quality import QualityError
from jobmargin.operators.staging import Staged
from jobmargin.plans import pipeline
from jobmargin.plans.scorecards import SCORECARDS
from jobmargin.sources.readers import read_csv_table, read_csv_tables, read_parquet_tables
from jobmargin.sources.schemas import RAW_TABLES
from jobmargin.sources.writers import export_csv, write_parquet
from tests.edge_data import DEFAULTS, raw_table, raw_tables

# Shape of the shipped CSV files: whole and decimal numbers mixed, no quotes.
SERVICES = """service_id,service_name,service_category,billing_type,default_price,default_est_labor_hours,default_material_cost,target_margin
1,Edging,Seasonal,one-time,90,1.25,7,0.25
2,Pruning & Care,Enhancement,recurring,120,2.0,31,0.4
"""


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_is_read_as_text_and_staged(spark, tmp_path):
    raw = read_csv_table(spark, _write(tmp_path / "services.csv", SERVICES), "services")
    assert {t for _, t in raw.dtypes} == {"string"}
    rows = Staged({"services": raw})["services"].orderBy("service_id").collect()
    assert [tuple(r) for r in rows][1] == (2, "Pruning & Care", "Enhancement", "recurring", 120.0, 2.0, 31.0, 0.4)


def test_csv_columns_match_by_name(spark, tmp_path):
    text = "supervisor,crew_name,crew_id,extra,home_base,labor_efficiency_factor,crew_size\nSam,North,4,?,Oak,0.9,3\n"
    raw = read_csv_table(spark, _write(tmp_path / "crews.csv", text), "crews")
    assert raw.columns == [f.source for f in RAW_TABLES["crews"]]
    assert tuple(raw.first()) == ("4", "North", "Oak", "Sam", "3", "0.9")


def test_csv_missing_column_is_reported(spark, tmp_path):
    with pytest.raises(ValueError, match="crew_size"):
        read_csv_table(spark, _write(tmp_path / "crews.csv", "crew_id,crew_name\n1,North\n"), "crews")


def test_csv_files_of_one_folder_must_agree(spark, tmp_path):
    (tmp_path / "crews.csv").mkdir()
    head = "crew_id,crew_name,home_base,supervisor,crew_size,labor_efficiency_factor\n"
    _write(tmp_path / "crews.csv" / "a.csv", head + "1,North,Oak,Sam,3,1\n")
    _write(tmp_path / "crews.csv" / "b.csv", head.replace("crew_name,home_base", "home_base,crew_name") + "2,Elm,East,Kim,3,1\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        read_csv_table(spark, str(tmp_path / "crews.csv"), "crews").collect()


def test_csv_quotes_blanks_and_line_breaks(spark, tmp_path):
    text = (
        "crew_id,crew_name,home_base,supervisor,crew_size,labor_efficiency_factor\n"
        '1,"The ""A"", team",,"",3,\n'
    )
    assert tuple(read_csv_table(spark, _write(tmp_path / "crews.csv", text), "crews").first()) == (
        "1", 'The "A", team', None, None, "3", None,
    )
    broken = text.replace("team", "team\nof two")
    row = read_csv_table(spark, _write(tmp_path / "two.csv", broken), "crews", multi_line=True).first()
    assert row["crew_name"] == 'The "A", team\nof two'


def test_blank_in_strict_csv_column_is_null(spark, tmp_path):
    row = dict(DEFAULTS["jobs"], customer_rating="", estimate_id="")
    text = ",".join(row) + "\n" + ",".join(row.values()) + "\n"
    raw = read_csv_table(spark, _write(tmp_path / "jobs.csv", text), "jobs")
    staged = Staged({"jobs": raw})["jobs"].first()
    assert staged["customer_rating"] is None and staged["estimate_id"] is None


def test_csv_round_trip_of_all_tables(spark, tmp_path):
    tables = raw_tables(spark, crews=[{"crew_name": 'Quote " and, comma', "supervisor": None}])
    for name, df in tables.items():
        export_csv(df, f"{tmp_path}/{name}.csv")
    for name, df in read_csv_tables(spark, str(tmp_path)).items():
        assert df.collect() == tables[name].collect()


def test_parquet_tables(spark, tmp_path):
    tables = raw_tables(spark)
    for name, df in tables.items():
        write_parquet(df, f"{tmp_path}/{name}.parquet")
    found = read_parquet_tables(spark, str(tmp_path))
    assert found["jobs"].collect() == tables["jobs"].collect()
    write_parquet(tables["jobs"].drop("city"), f"{tmp_path}/jobs.parquet")
    with pytest.raises(ValueError, match="city"):
        read_parquet_tables(spark, str(tmp_path), ["jobs"])


def test_partitioned_write_keeps_columns_types_and_null_partition(spark, tmp_path):
    df = spark.sql("select 1 as a, cast(null as date) as m, 'x' as b union all select 2, date'2025-01-01', 'y'")
    back = write_parquet(df, f"{tmp_path}/t", partition_by="m")
    assert back.dtypes == df.dtypes
    assert sorted(back.collect(), key=repr) == sorted(df.collect(), key=repr)


def _csv_rows(folder):
    parts = sorted(p for p in folder.iterdir() if p.name.endswith(".csv"))
    return [row for p in parts for row in csv.DictReader(p.open())]


def test_refresh_publishes_exports_and_repeats(spark, tmp_path):
    jobs = [
        {"job_id": str(i), "completed_date": f"2025-0{1 + i % 3}-05", "billed_revenue": str(50 * i), "crew_id": str(1 + i % 2)}
        for i in range(1, 7)
    ]
    tables = raw_tables(spark, jobs=jobs, crews=[{}, {"crew_id": "2", "crew_name": "East"}])
    verdicts = []
    for _ in range(2):  # a refresh replaces what is there
        published = pipeline.refresh(spark, tables, str(tmp_path), verdicts.append)
    assert len(verdicts) == 10 and all(v.endswith(": ok") for v in verdicts)

    assert published.fact.count() == 6 and tuple(published.fact.columns) == FACT_COLUMNS
    stored = pipeline.read_published(spark)
    assert sorted(stored.fact.collect(), key=repr) == sorted(published.fact.collect(), key=repr)
    assert set(stored.tables) == {"job_fact", "estimate_scorecard", *SCORECARDS}

    # jobs, revenue and profit agree across the four scorecards of the fact
    totals = {
        name: tuple(stored.tables[name].selectExpr("sum(jobs_completed)", "sum(revenue)", "sum(gross_profit)").first())
        for name in SCORECARDS
    }
    assert len(set(totals.values())) == 1 and totals["crew_scorecard"][:2] == (6, 1050.0)

    exports = tmp_path / "exports"
    assert len(_csv_rows(exports / "job_fact")) == 6
    assert [r["completed_month"] for r in _csv_rows(exports / "monthly_scorecard")] == ["2025-01-01", "2025-02-01", "2025-03-01"]
    revenue = [float(r["revenue"]) for r in _csv_rows(exports / "crew_scorecard")]
    assert revenue == sorted(revenue, reverse=True) and len(revenue) == 2

    assert spark.table("staged_jobs").count() == 6
    assert spark.table("job_economics").count() == 6
    assert spark.sql("show databases").filter("namespace in ('raw', 'analytics')").count() == 2
    assert spark.table("raw.jobs").dtypes == tables["jobs"].dtypes


def test_refresh_publishes_before_it_fails(spark, tmp_path):
    tables = raw_tables(spark, jobs=[{"crew_id": "77"}])
    with pytest.raises(QualityError, match="crew_ids_present"):
        pipeline.refresh(spark, tables, str(tmp_path), lambda line: None)
    assert len(_csv_rows(tmp_path / "exports" / "crew_scorecard")) == 1


def test_constraints_of_published_tables(spark, tmp_path):
    tables = raw_tables(spark, jobs=[{"customer_id": "77"}])
    published = pipeline.refresh(spark, tables, str(tmp_path), lambda line: None)
    report = pipeline.check_constraints(Staged(tables), published)
    broken = [(r["table_name"], r["column_name"], r["rule"]) for r in report.filter("violations > 0").collect()]
    assert broken == [("job_fact", "customer_id", "not_null")]
    assert raw_table(spark, "jobs", {}).count() == 1
