"""From raw documents to packed shards: five operators in a row, each over all that the one before it kept.

Every stage function takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again
for the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobmargin.llm import decontaminate, mixing, quality_rules, sharding, simhash
from jobmargin.llm.common import read, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the cascade."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component."""
    return simhash.keep_one(docs, shingle=4, max_bits=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, those of rarer languages more often."""
    return mixing.mixed(docs, mixing.language_labels(spark, docs, sf_dir), least=1.0, grow=True)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents in eight shards of nearly equal size."""
    return sharding.sharding(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", mix),
    ("sharding", shards),
]

# Fingerprints, fitted rates and packing are beyond SQL; tests/llm checks run() against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
