"""Raw tables in: CSV folders or Parquet, nine tables by name."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobmargin.sources.schemas import RAW_TABLES, require_columns
from jobmargin.sources.writers import LINE_BREAKS, file_exists


def read_csv_table(spark: SparkSession, path: str, table: str, multi_line: bool | None = None) -> DataFrame:
    """One raw table as strings, matched to its declaration by header name.

    Without ``inferSchema`` the reader takes names from the header and types every column
    as string; ``enforceSchema=false`` then checks the header of each further file, and
    FAILFAST rejects torn records. Unquoted blanks become NULL. ``multi_line`` allows line
    breaks inside quotes but makes files unsplittable. By default it is on for a folder that ``export_csv`` marked as
    holding such texts, and off for all others.
    """
    if multi_line is None:
        multi_line = file_exists(spark, f"{path}/{LINE_BREAKS}")
    df = (
        spark.read.option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("multiLine", multi_line)
        .csv(path)
    )
    require_columns(table, df.columns)
    # A quoted blank is as empty as an unquoted one.
    return df.select([F.nullif(F.col(f.source), F.lit("")).alias(f.source) for f in RAW_TABLES[table]])


def read_csv_tables(
    spark: SparkSession, folder: str, tables: Iterable[str] = RAW_TABLES, suffix: str = ".csv"
) -> dict[str, DataFrame]:
    """Every declared table from ``folder/<table>.csv`` (a file or a folder of part files)."""
    return {t: read_csv_table(spark, f"{folder}/{t}{suffix}", t) for t in tables}


def read_parquet_tables(
    spark: SparkSession, folder: str, tables: Iterable[str] = RAW_TABLES, suffix: str = ".parquet"
) -> dict[str, DataFrame]:
    """As ``read_csv_tables`` for Parquet, typed or all-string; staging casts either."""
    found = {}
    for table in tables:
        found[table] = spark.read.parquet(f"{folder}/{table}{suffix}")
        require_columns(table, found[table].columns)
    return found
