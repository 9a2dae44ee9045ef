"""Incremental refresh: when some jobs change, only their months are computed again.

A live folder holds the fact, its selection cells and its customer bitmaps, each partitioned by month. The scorecards are
sums over cells and bitmaps, so they never read the fact. A change recomputes the fact of the months it
touches, from raw jobs filtered to them and the labor of those jobs alone, writes it and its state aside, and only then
replaces those partitions. What is about to be replaced is noted in one small file first: a run that was cut off is
completed by ``recover``, which every later change calls.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobmargin.functions.measures import REGISTRY
from jobmargin.functions.ratios import expressions
from jobmargin.operators.cells import job_cells
from jobmargin.operators.distinct import count_customers, customer_bits
from jobmargin.operators.fact import job_fact
from jobmargin.operators.staging import Staged
from jobmargin.plans.scorecards import SCORECARDS
from jobmargin.sources.releases import read_small_file
from jobmargin.sources.writers import file_exists, remove_folder, write_parquet, write_small_file

MONTH = "completed_month"
FACT, CELLS, BITS = "job_fact", "job_cells", "customer_bits"
PENDING = "pending.json"
NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


def _state_of(fact: DataFrame) -> dict[str, DataFrame]:
    return {CELLS: job_cells(fact), BITS: customer_bits(fact)}


def start(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> None:
    """The first, full build of the live folder."""
    fact = write_parquet(job_fact(Staged(tables)), f"{folder}/live/{FACT}", MONTH)
    for name, df in _state_of(fact).items():
        write_parquet(df, f"{folder}/live/{name}", MONTH)


def live(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/live/{name}")
    return df.withColumn(MONTH, F.col(MONTH).cast("date"))


def month_of(completed: str = "completed_date") -> Column:
    return F.expr(f"trunc({completed}, 'month')")


def touched_months(fact: DataFrame, jobs: DataFrame, changed: DataFrame) -> list[date | None]:
    """The months that hold a job of ``changed`` (job_id), before (``fact``) or after (staged ``jobs``) the change.

    As many values as there are months come to the driver.
    """
    before = fact.join(changed, "job_id", "left_semi").select(MONTH)
    after = jobs.join(changed, "job_id", "left_semi").select(month_of().alias(MONTH))
    return sorted((r[0] for r in before.union(after).distinct().collect()), key=lambda m: (m is not None, m))


def in_months(column: Column, months: Iterable[date | None]) -> Column:
    months = list(months)
    listed = column.isin([m for m in months if m is not None])
    return F.coalesce(listed, F.lit(None in months)) if None in months else listed


def jobs_of(jobs: DataFrame, months: Sequence[date | None]) -> DataFrame:
    """Staged jobs completed in ``months``; the range of dates they span is pushed to the files."""
    dated = [m for m in months if m is not None]
    if dated and None not in months:
        last = F.last_day(F.lit(max(dated)))
        jobs = jobs.filter(F.col("completed_date").between(F.lit(min(dated)), last))
    return jobs.filter(in_months(month_of(), months))


def fact_of(tables: Mapping[str, DataFrame], months: Sequence[date | None]) -> DataFrame:
    """The fact of some months, from their jobs and the labor of those jobs."""
    staged = Staged(tables)
    jobs = jobs_of(staged["jobs"], months)
    labor = staged["job_labor"].join(jobs.select("job_id"), "job_id", "left_semi")
    return job_fact({**{name: staged[name] for name in staged}, "jobs": jobs, "job_labor": labor})


def _replace(spark: SparkSession, folder: str, aside: str, months: Sequence[str]) -> None:
    """Replace the partitions of ``months`` by what lies aside; months without a row there go. Can be repeated."""
    for name in (FACT, CELLS, BITS):
        source, target = f"{aside}/{name}", f"{folder}/live/{name}"
        found = [m for m in months if file_exists(spark, f"{source}/{MONTH}={m}")]
        if found:
            df = spark.read.parquet(source)
            df = df.hint("rebalance", MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            df.partitionBy(MONTH).parquet(target)
        for month in set(months) - set(found):
            remove_folder(spark, f"{target}/{MONTH}={month}")


def recover(spark: SparkSession, folder: str) -> bool:
    """Complete a change that was cut off while it replaced partitions; whether there was one."""
    note = f"{folder}/{PENDING}"
    if not file_exists(spark, note):
        return False
    pending = json.loads(read_small_file(spark, note))
    _replace(spark, folder, pending["aside"], pending["months"])
    remove_folder(spark, note)
    remove_folder(spark, pending["aside"])
    return True


def apply_change(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str, months: Sequence[date | None]) -> None:
    """Bring the live folder up to ``tables``, which differ from what it holds only in jobs of ``months``."""
    recover(spark, folder)
    if not months:
        return
    aside = f"{folder}/aside-{uuid.uuid4().hex}"
    fact = write_parquet(fact_of(tables, months), f"{aside}/{FACT}", MONTH)
    for name, df in _state_of(fact).items():
        write_parquet(df, f"{aside}/{name}", MONTH)
    named = [NO_MONTH if m is None else m.isoformat() for m in months]
    write_small_file(spark, f"{folder}/{PENDING}", json.dumps({"aside": aside, "months": named}))
    recover(spark, folder)


def scorecard_from_state(name: str, cells: DataFrame, bits: DataFrame) -> DataFrame:
    """A scorecard, equal to the one over the fact, from cells and customer bitmaps."""
    card = SCORECARDS[name]
    additive = {m: REGISTRY[m].merged() for m in card.measures if REGISTRY[m].final is not None}
    result = cells.groupBy(*card.keys).agg(*expressions(additive))
    for measure in card.measures:
        if measure not in additive:
            counts = count_customers(bits, *card.keys, name=measure).withColumnsRenamed({k: f"of_{k}" for k in card.keys})
            same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in card.keys]
            result = result.join(counts, same, "left").withColumn(measure, F.coalesce(measure, F.lit(0)))
    return result.select(*card.keys, *card.measures)
