"""Connected components of an edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobmargin.llm.common import drop_stored, stored


def _fold(edges: DataFrame) -> tuple:
    """Tells two edge sets apart."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows."""
    both = edges.union(edges.select(F.col("v"), F.col("u")))
    least = stored(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")), "least")
    moved = both.where("v > u").join(least, F.col("u") == F.col("node"))
    return moved.select(F.col("v").alias("u"), F.least("u", "least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the smallest of them."""
    least = stored(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least")), "least")
    moved = edges.join(least, F.col("u") == F.col("node")).where("v > least")
    return moved.select(F.col("v").alias("u"), F.col("least").alias("v")).union(least.toDF("u", "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs in, (u, v) out: each node that is not the smallest of its component, with the smallest.

    Groups only ever feed a minimum, which combines before the shuffle, so a hub costs one row per
    task. The minima are written before they are joined: with both sides read from files adaptive execution
    splits the links of a hub, which it cannot do beside an aggregate of the same exchange. Each round is a
    written table. Rounds grow with the logarithm of a component's length.
    """
    current = stored(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    seen = _fold(current)
    while seen[0]:
        moved = stored(_large_star(current), "moved")
        following = stored(_small_star(moved), "edges")
        for done in (current, moved):
            drop_stored(done)
        current, before = following, seen
        seen = _fold(current)
        if seen == before:
            break
    return current
