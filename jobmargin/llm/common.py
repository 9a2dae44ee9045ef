"""What the text operators share: stored intermediate tables, text keys, gapless numbering.

Rules that hold for every operator of this package unless its docstring says otherwise:

* Only the named input columns are read; further columns, whatever their names, do not disturb.
  Columns that an operator adds to a caller's own frame start with ``llm__``.
* A NULL text counts as empty. A NULL ``doc_id`` is an id like any other.
* Rows with equal ``doc_id`` and equal text are repeated rows: each gets the result of that document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from jobmargin.session import run_folder
from jobmargin.sources.writers import write_parquet

# The characters that separate words, \x20 and \x09 to \x0D.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: what follows survives lost executors."""
    return write_parquet(df, run_folder(df.sparkSession, label))


def drop_stored(df: DataFrame) -> None:
    """Remove the folder behind a ``stored`` frame that nothing reads any more."""
    session = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = session._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def text_key(column: str = "text") -> Column:
    """Tells rows apart that share an id."""
    return F.xxhash64(text_of(column))


def words_of(text: Column) -> Column:
    """Words between white space, as an array without empty strings."""
    return F.array_remove(F.split(text, WORD_BREAK), "")


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, buckets: int = 1024) -> DataFrame:
    """Adds a gapless number from 0 within each value of ``keys``.

    No task sees a whole key: rows are counted in hash buckets of the ``order`` columns, the bucket
    counts become offsets, and a window numbers the rows of one bucket. The number of a row depends
    on its ``order`` values only; rows that tie in all of them take neighbouring numbers.
    """
    inside = [*keys, "llm__bucket"]
    df = df.withColumn("llm__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = df.groupBy(*inside).agg(F.count(F.lit(1)).alias("llm__size"))
    before = Window.partitionBy(*keys).orderBy("llm__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*inside, F.coalesce(F.sum("llm__size").over(before), F.lit(0)).alias("llm__offset"))
    rank = F.row_number().over(Window.partitionBy(*inside).orderBy(*order))
    ranked = df.withColumn("llm__rank", rank)
    return (
        ranked.join(offsets, inside)
        .withColumn(name, F.col("llm__offset") + F.col("llm__rank") - 1)
        .drop("llm__bucket", "llm__offset", "llm__rank")
    )
