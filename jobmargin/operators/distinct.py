"""Exact distinct counts that merge: bitmaps of customer ids, stored per month and selection.

Monthly counts of customers do not add up to a year's, but their bitmaps do: ids are dealt to buckets of 32,768
neighbouring ids, a bucket's ids are bits, and bitmaps of the same bucket are or-ed. A stored bitmap takes about as many
bytes as it has set bits, at most four kilobytes; in memory it takes four kilobytes. So this state pays where the
customers of a selection have neighbouring ids, as generated keys have; ids spread at random over the whole bigint
range would give one bitmap each.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, functions as F

from jobmargin.operators.filters import JobFilter

BIT_KEYS = ("completed_month", "city", "service_name", "crew_name")


def customer_bits(fact: DataFrame, keys: Sequence[str] = BIT_KEYS) -> DataFrame:
    """``keys, bucket, bits``: the customers with a job, as bitmaps; built map-side, one per key and bucket."""
    bucket = F.expr("bitmap_bucket_number(customer_id)").alias("bucket")
    ids = fact.filter("customer_id is not null").groupBy(*keys, bucket)
    return ids.agg(F.expr("bitmap_construct_agg(bitmap_bit_position(customer_id))").alias("bits"))


def merged_bits(bits: DataFrame, *keys: str) -> DataFrame:
    return bits.groupBy(*keys, "bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))


def count_customers(bits: DataFrame, *keys: str, name: str = "active_customers") -> DataFrame:
    """Distinct customers per ``keys``, or overall as one row; groups without any customer are absent."""
    counted = merged_bits(bits, *keys).withColumn("n", F.expr("bitmap_count(bits)"))
    return counted.groupBy(*keys).agg(F.expr("coalesce(sum(n), 0L)").alias(name))


def selected_customers(bits: DataFrame, fact: DataFrame, chosen: JobFilter) -> DataFrame:
    """Distinct customers of a selection: whole months from the stored bitmaps, cut months from their jobs.

    Of the fact only the first and last month are read, and those only if the selection cuts them.
    """
    stored = bits.filter("completed_month is not null")
    for rule in chosen.picks():
        stored = stored.filter(rule)
    stored = chosen.semi_joined(stored)
    bounds = chosen.bounds()
    if bounds is not None:
        month = F.col("completed_month")
        whole = (month >= F.lit(bounds[0])) & (F.last_day(month) <= F.lit(bounds[1]))
        cut = [day.replace(day=1) for day, edge in zip(bounds, _edges(bounds)) if day != edge]
        stored = stored.filter(month.between(F.lit(bounds[0]), F.lit(bounds[1].replace(day=1))) & whole)
        if cut:
            jobs = chosen.apply(fact.filter(month.isin(*cut)))
            stored = stored.unionByName(customer_bits(jobs, BIT_KEYS))
    return count_customers(stored)


def _edges(bounds: tuple) -> tuple:
    """The first day of the first month and the last day of the last one."""
    first, last = bounds
    following = (last.replace(day=28) + timedelta(days=4)).replace(day=1)
    return first.replace(day=1), following - timedelta(days=1)
