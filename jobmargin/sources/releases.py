"""Releases: several tables written aside and published together.

Every release has a folder of its own under the root. While it is written nobody reads it. When all its tables are
complete a marker is written, one small file that lists them, and the catalog is pointed to the folder, table by table,
with ``ALTER TABLE ... SET LOCATION``. So a run that breaks before the marker leaves the old tables as they were; a
switch that fails half way is undone; and after a driver that died inside the switch ``recover`` completes it.

Partitions are found by listing the folder, not kept in the catalog: a new location then takes effect at once, and
filters still prune.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from jobmargin.sources.writers import file_exists, hadoop_path, remove_folder, write_parquet, write_small_file

MARKER = "released.json"
_TRACKED = "spark.sql.hive.manageFilesourcePartitions"


def read_small_file(spark: SparkSession, path: str) -> str:
    return "\n".join(row[0] for row in spark.read.option("wholetext", True).text(path).collect())


def released(spark: SparkSession, root: str) -> list[str]:
    """The folders of all published releases under ``root``, oldest first."""
    folder, files = hadoop_path(spark, root)
    if not files.exists(folder):
        return []
    found = [str(entry.getPath()) for entry in files.listStatus(folder) if entry.isDirectory()]
    return sorted(f for f in found if file_exists(spark, f"{f}/{MARKER}"))


def _location(spark: SparkSession, table: str) -> str | None:
    if not spark.catalog.tableExists(table):
        return None
    return spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'").first()["data_type"]


def _partition_columns(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table) if c.isPartition]


def point(spark: SparkSession, table: str, path: str, partition_by: str | None = None) -> None:
    """Make ``table`` (database.name) the Parquet folder ``path``: a switch of its location, or a new entry."""
    schema = spark.read.parquet(path).schema
    described = [(f.name, f.dataType) for f in schema]
    if spark.catalog.tableExists(table):
        now = [(f.name, f.dataType) for f in spark.table(table).schema]
        if now == described and _partition_columns(spark, table) == ([partition_by] if partition_by else []):
            spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
            spark.catalog.refreshTable(table)
            return
        spark.sql(f"DROP TABLE {table}")  # another shape: the files of earlier releases stay
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parts = f"PARTITIONED BY (`{partition_by}`)" if partition_by else ""
    tracked = spark.conf.get(_TRACKED)
    spark.conf.set(_TRACKED, "false")
    try:
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {parts} LOCATION '{path}'")
    finally:
        spark.conf.set(_TRACKED, tracked)


def switch(spark: SparkSession, tables: Mapping[str, tuple[str, str | None]], point: Callable[..., None] = point) -> None:
    """Point every ``{table: (path, partition column)}``; if one fails, those before it go back to where they were."""
    before = {table: _location(spark, table) for table in tables}
    done = []
    try:
        for table, (path, partition_by) in tables.items():
            done.append(table)
            point(spark, table, path, partition_by)
    except Exception:
        for table in done:
            if before[table]:
                point(spark, table, before[table], tables[table][1])
            elif spark.catalog.tableExists(table):
                spark.sql(f"DROP TABLE {table}")
        raise


class Release:
    """One release while it is being made."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.folder = f"{root}/{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
        self._tables: dict[str, tuple[str, str | None]] = {}

    def write(self, df: DataFrame, table: str, partition_by: str | None = None, **options) -> DataFrame:
        """Write ``df`` as the coming ``table`` (database.name) and return it as read from its files."""
        path = f"{self.folder}/{table.replace('.', '/')}"
        stored = write_parquet(df, path, partition_by, **options)
        self._tables[table] = (path, partition_by)
        return stored

    def publish(self) -> None:
        """Mark the release as complete, then switch the catalog; a failed switch takes the mark back."""
        marker = f"{self.folder}/{MARKER}"
        write_small_file(self.spark, marker, json.dumps(self._tables))
        try:
            switch(self.spark, self._tables)
        except Exception:
            remove_folder(self.spark, marker)
            raise

    def discard(self) -> None:
        """Remove what was written; for a release that is not published."""
        remove_folder(self.spark, self.folder)


def recover(spark: SparkSession, root: str) -> str | None:
    """Point the catalog to the newest published release and return its folder: completes a switch that was cut off."""
    found = released(spark, root)
    if not found:
        return None
    tables = json.loads(read_small_file(spark, f"{found[-1]}/{MARKER}"))
    for table in tables:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS `{table.split('.')[0]}`")
    switch(spark, tables)
    return found[-1]


def expire(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove all but the newest ``keep`` published releases; queries that still read the one before go on."""
    for folder in released(spark, root)[:-keep]:
        remove_folder(spark, folder)
