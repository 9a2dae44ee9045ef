"""Full refresh: raw tables to published fact, scorecards, CSV exports and the quality gate."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession

from jobmargin.functions.ratios import expressions
from jobmargin.operators.economics import economics_of, labor_rollup
from jobmargin.operators.fact import FACT_COLUMNS, job_fact
from jobmargin.operators.quality import OBSERVED, constrained_columns, constraint_report, observed_gate, raise_on_failure
from jobmargin.operators.staging import Staged
from jobmargin.plans.scorecards import SCORECARDS, estimate_order, estimate_scorecard
from jobmargin.sources.releases import Release, expire
from jobmargin.sources.writers import ensure_database, export_csv, replace_view, write_bucketed

FACT = "job_fact"
ESTIMATES = "estimate_scorecard"
THREADS = 4  # independent tables written at the same time

T = TypeVar("T")


@dataclass(frozen=True)
class Published:
    """The fact and the five scorecards, by name."""

    tables: Mapping[str, DataFrame]

    @property
    def fact(self) -> DataFrame:
        return self.tables[FACT]


def display_order(name: str) -> list[Column]:
    """How a published table is sorted for display; the fact is not."""
    if name in SCORECARDS:
        return SCORECARDS[name].order()
    return estimate_order() if name == ESTIMATES else []


def _side_by_side(spark: SparkSession, work: Callable[[str], T], names: Iterable[str]) -> dict[str, T]:
    """Run independent writes from a few driver threads, so that small ones overlap."""
    names = list(names)
    with ThreadPoolExecutor(THREADS) as pool:
        return dict(zip(names, pool.map(inheritable_thread_target(spark)(work), names)))


def scorecards_over(fact: DataFrame, staged: Staged) -> dict[str, DataFrame]:
    """All five scorecards, lazily; given the stored fact each is a scan of the columns it reads."""
    cards = {name: card.over(fact) for name, card in SCORECARDS.items()}
    cards[ESTIMATES] = estimate_scorecard(staged["estimates"], staged["services"])
    return cards


def constrained_fact(staged: Staged) -> DataFrame:
    """The fact's columns that key constraints read, its own and the scorecards' keys; labor is not among them."""
    keys = [key for card in SCORECARDS.values() for key in card.keys]
    return job_fact(staged).select(*dict.fromkeys((*constrained_columns(FACT), *keys)))


def constrained_tables(fact: DataFrame, staged: Staged) -> Published:
    """What ``check_constraints`` needs of the published tables, from a stored ``constrained_fact``."""
    cards = {name: card.groups(fact) for name, card in SCORECARDS.items()}
    return Published({FACT: fact, **cards, ESTIMATES: estimate_scorecard(staged["estimates"], staged["services"])})


def read_published(spark: SparkSession, database: str = "analytics") -> Published:
    tables = {name: spark.table(f"{database}.{name}") for name in (FACT, *SCORECARDS, ESTIMATES)}
    return Published({**tables, FACT: tables[FACT].select(*FACT_COLUMNS)})


def register_views(staged: Staged) -> None:
    """Replaceable views of the lazy layers, for ad-hoc SQL."""
    for name in staged:
        replace_view(staged[name], f"staged_{name}")
    replace_view(labor_rollup(staged["job_labor"]), "labor_rollup")
    replace_view(economics_of(staged), "job_economics")


def load_raw(release: Release, tables: Mapping[str, DataFrame], database: str = "raw") -> dict[str, DataFrame]:
    """Copy the raw tables into ``database`` of a release, so that CSV text is parsed only once."""
    return _side_by_side(release.spark, lambda name: release.write(tables[name], f"{database}.{name}"), tables)


def store_by_job(staged: Staged, folder: str, database: str, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """Jobs and their summed labor as tables in files by job id: (jobs, rollup).

    Labor is summed before it is stored, map-side first, so a job with a large share of all entries is one row here. Every
    later ``job_economics`` over the two joins them without an exchange.
    """
    ensure_database(staged["jobs"].sparkSession, database, f"{folder}/{database}")
    tables = {"jobs_by_id": staged["jobs"], "labor_by_job": labor_rollup(staged["job_labor"])}
    stored = [write_bucketed(df, f"{database}.{name}", f"{folder}/{name}", "job_id", buckets) for name, df in tables.items()]
    return stored[0], stored[1]


def export(published: Published, folder: str) -> None:
    """One CSV folder per published table; the scorecards in their display order."""
    _side_by_side(
        published.fact.sparkSession,
        lambda name: export_csv(published.tables[name], f"{folder}/{name}", display_order(name)),
        published.tables,
    )


def publish_tables(
    release: Release, staged: Staged, analytics: str = "analytics", seen: Observation | None = None
) -> Published:
    """The fact, partitioned by month, and the scorecards over it, written into ``release``.

    ``seen`` takes what the quality gate counts while the fact is written.
    """
    count = (seen or Observation(), expressions(OBSERVED))
    fact = release.write(job_fact(staged), f"{analytics}.{FACT}", "completed_month", count=count)
    cards = scorecards_over(fact, staged)
    stored = _side_by_side(release.spark, lambda name: release.write(cards[name], f"{analytics}.{name}"), cards)
    return Published({FACT: fact, **stored})


def refresh(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    folder: str,
    show: Callable[[str], None] = print,
    raw: str = "raw",
    analytics: str = "analytics",
) -> Published:
    """The whole run, repeatable: load, stage, write, publish, export, then the quality gate.

    The joins run once, for the fact; the scorecards are scans of the stored fact. All tables belong to one release
    below ``folder/releases``: until its last table is written the catalog shows the release before it, whole, and
    a run that breaks changes nothing. The gate comes last, as a verdict on what was published, from counts taken
    while the fact was written: it raises ``QualityError`` with everything already in place for inspection. ``raw`` and ``analytics`` name the databases, so
    that several refreshes can share a catalog.
    """
    root = f"{folder}/releases"
    for database in (raw, analytics):
        ensure_database(spark, database, f"{folder}/{database}")
    release = Release(spark, root)
    try:
        staged = Staged(load_raw(release, tables, raw))
        seen = Observation()
        published = publish_tables(release, staged, analytics, seen)
        release.publish()
    except Exception:
        release.discard()
        raise
    register_views(staged)
    expire(spark, root)
    export(published, f"{folder}/exports")
    raise_on_failure(observed_gate(staged["jobs"], seen.get), show)
    return published


def check_constraints(staged: Staged, published: Published) -> DataFrame:
    """The key constraints over staged and published tables."""
    return constraint_report({**{name: staged[name] for name in staged}, **published.tables})
