"""Publishing is all or nothing: whatever breaks, readers see one release, whole."""

import os

import pytest

from jobmargin.plans import pipeline
from jobmargin.plans.scorecards import SCORECARDS
from jobmargin.sources import releases
from tests.edge_data import raw_tables


def jobs(*revenues):
    return [{"job_id": str(i), "billed_revenue": str(r), "completed_date": f"2025-0{i}-05"} for i, r in enumerate(revenues, 1)]


def names(mark):
    return {"raw": f"raw_{mark}", "analytics": f"analytics_{mark}"}


def state(spark, raw, analytics):
    """Everything the catalog shows."""
    tables = [f"{raw}.jobs", f"{raw}.crews", *(f"{analytics}.{t}" for t in (pipeline.FACT, *SCORECARDS, pipeline.ESTIMATES))]
    return {t: sorted(map(str, spark.table(t).collect())) for t in tables}


def refresh(spark, path, mark, *revenues):
    tables = raw_tables(spark, jobs=jobs(*revenues))
    return pipeline.refresh(spark, tables, str(path), lambda line: None, **names(mark))


class Broken(RuntimeError):
    pass


@pytest.mark.parametrize("after", ["job_fact", "crew_scorecard", "raw_break_a.services"])
def test_a_run_that_breaks_between_two_tables_changes_nothing(spark, tmp_path, monkeypatch, after):
    mark = "break_a"
    refresh(spark, tmp_path, mark, 50, 70)
    before = state(spark, **names(mark))
    write = releases.Release.write

    def breaks(self, df, table, partition_by=None, **options):
        stored = write(self, df, table, partition_by, **options)
        if table.endswith(after):
            raise Broken
        return stored

    with monkeypatch.context() as patch:
        patch.setattr(releases.Release, "write", breaks)
        with pytest.raises(Broken):
            refresh(spark, tmp_path, mark, 50, 90, 80)
    assert state(spark, **names(mark)) == before
    assert len(os.listdir(tmp_path / "releases")) == len(releases.released(spark, f"{tmp_path}/releases"))
    refresh(spark, tmp_path, mark, 50, 90, 80)
    assert state(spark, **names(mark)) != before and spark.table(f"analytics_{mark}.job_fact").count() == 3


def test_a_switch_that_fails_is_undone(spark, tmp_path, monkeypatch):
    mark = "break_b"
    refresh(spark, tmp_path, mark, 50, 70)
    before, point, seen = state(spark, **names(mark)), releases.point, []

    def breaks(spark, table, path, partition_by=None):
        seen.append(table)
        if len(seen) == 4:
            raise Broken
        point(spark, table, path, partition_by)

    switch = releases.switch
    with monkeypatch.context() as patch:
        patch.setattr(releases, "switch", lambda spark, tables: switch(spark, tables, breaks))
        with pytest.raises(Broken):
            refresh(spark, tmp_path, mark, 60, 80)
    assert state(spark, **names(mark)) == before
    assert len(releases.released(spark, f"{tmp_path}/releases")) == 1


def test_recover_completes_a_switch_that_was_cut_off(spark, tmp_path, monkeypatch):
    mark = "break_c"
    refresh(spark, tmp_path, mark, 50, 70)
    old = state(spark, **names(mark))
    with monkeypatch.context() as patch:  # the driver dies after the marker
        patch.setattr(releases, "switch", lambda spark, tables: None)
        refresh(spark, tmp_path, mark, 60, 80)
    assert state(spark, **names(mark)) == old
    newest = releases.recover(spark, f"{tmp_path}/releases")
    assert newest == releases.released(spark, f"{tmp_path}/releases")[-1]
    assert spark.table(f"analytics_{mark}.job_fact").agg({"billed_revenue": "sum"}).first()[0] == 140.0
    assert releases.recover(spark, f"{tmp_path}/nowhere") is None


def test_old_releases_expire_and_open_queries_go_on(spark, tmp_path):
    first = refresh(spark, tmp_path, "keep", 60)
    refresh(spark, tmp_path, "keep", 70)
    assert first.fact.first()["billed_revenue"] == 60.0  # still there for those who read it
    refresh(spark, tmp_path, "keep", 80)
    assert len(releases.released(spark, f"{tmp_path}/releases")) == 2


def test_pointing_at_another_shape_replaces_the_entry(spark, tmp_path):
    spark.sql("create database if not exists shapes")
    release = releases.Release(spark, f"{tmp_path}/r")
    release.write(spark.sql("select 1 as a, date'2025-01-01' as m"), "shapes.t", "m")
    release.publish()
    again = releases.Release(spark, f"{tmp_path}/r")
    again.write(spark.sql("select 1 as a, 'x' as b"), "shapes.t")
    again.publish()
    assert spark.table("shapes.t").columns == ["a", "b"]


def test_the_published_fact_prunes_months(spark, tmp_path):
    refresh(spark, tmp_path, "prune", 50, 70)
    picked = spark.table("analytics_prune.job_fact").filter("completed_month = date'2025-02-01'")
    assert "PartitionFilters: [isnotnull(completed_month" in picked._jdf.queryExecution().executedPlan().toString()
    assert [r["billed_revenue"] for r in picked.collect()] == [70.0]
