"""Parquet folders, views and CSV exports. Every write replaces its target; ``sources.releases`` publishes several at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

LINE_BREAKS = "_line_breaks"


def ensure_database(spark: SparkSession, name: str, location: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` LOCATION '{location}'")


def replace_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def write_parquet(
    df: DataFrame, path: str, partition_by: str | None = None, count: tuple[Observation, Sequence[Column]] | None = None
) -> DataFrame:
    """Write ``df`` as a Parquet folder and return it as read back.

    ``count`` names aggregates to take on the way. They are placed after the last shuffle, in the tasks that write:
    Spark counts each of those once, also when lost executors make it repeat the stages before.

    A partitioned write is preceded by a rebalance on the partition column: adaptive
    execution then cuts each value into files of the advisory size, so a month that holds
    a third of all rows is written by many tasks and a thin month by one.
    """
    schema = df.schema
    if partition_by:
        df = df.hint("rebalance", partition_by)
    if count:
        df = df.observe(count[0], *count[1])
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path).select(*schema.names)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int) -> DataFrame:
    """Write ``df`` as the catalog table ``table`` in files by ``key``, and return it.

    Tables with equal keys and numbers of buckets join and aggregate on the key without moving a row. A bucket is
    read by one task, so this is for tables that are unique on ``key``; sum a table with a hot key first.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    sorted_files = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    sorted_files.format("parquet").option("path", path).saveAsTable(table)
    return spark.table(table)


def hadoop_path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def file_exists(spark: SparkSession, path: str) -> bool:
    found, files = hadoop_path(spark, path)
    return files.exists(found)


def write_small_file(spark: SparkSession, path: str, text: str) -> None:
    """A file that is there whole or not at all: written under another name, then renamed."""
    target, files = hadoop_path(spark, path)
    aside, _ = hadoop_path(spark, f"{path}.part")
    stream = files.create(aside, True)
    stream.write(text.encode())
    stream.close()
    files.delete(target, False)
    if not files.rename(aside, target):
        raise OSError(f"could not name {path}")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder or file that a run wrote and nothing reads any more."""
    folder, files = hadoop_path(spark, path)
    files.delete(folder, True)


def _plain_decimal(column: str) -> Column:
    """A double as text without an exponent where twelve decimals hold it exactly."""
    text = f"cast(`{column}` as string)"
    plain = f"cast(try_cast({text} as decimal(38, 12)) as string)"
    exact = f"{text} like '%E%' and try_cast({plain} as double) = `{column}`"
    trimmed = f"regexp_replace(regexp_replace({plain}, '0+$', ''), '[.]$', '.0')"
    return F.expr(f"case when {exact} then {trimmed} else {text} end").alias(column)


def export_csv(df: DataFrame, path: str, order: Sequence[Column] = ()) -> None:
    """CSV folder with a header line per part file.

    Texts keep their blanks, an empty text is written in quotes and NULL as nothing, doubles as plain
    decimals. With ``order`` the part files are in global order. A scorecard is small enough for
    adaptive execution to leave it in one part; a large table keeps many. Where a text holds a line break,
    which is counted while the files are written, the folder says so in a file that CSV readers skip.
    """
    if order:
        df = df.orderBy(*order)
    breaks = [f"locate('\\n', `{c}`) > 0 or locate('\\r', `{c}`) > 0" for c, t in df.dtypes if t == "string"]
    seen = Observation()
    observed = df.observe(seen, F.expr(f"coalesce(bool_or({' or '.join(breaks) or 'false'}), false) as line_breaks"))
    (
        observed.select([_plain_decimal(c) if t == "double" else c for c, t in df.dtypes])
        .write.mode("overwrite")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    if seen.get["line_breaks"]:
        write_small_file(df.sparkSession, f"{path}/{LINE_BREAKS}", "texts hold line breaks")
