"""Shards by best-fit-decreasing bin packing of indivisible groups.

Documents with equal texts form a group, which stays in one shard. Groups are taken from large to small, each
into the shard with the tightest remaining capacity that still holds it; the remaining capacities are kept in a
balanced tree. Groups of equal size are interchangeable, so the packing runs over a histogram of sizes, and a
shard takes as many of a size as fit at once. Which groups those are follows from a gapless number that
Spark gives each group within its size. Sizes are rounded up to ``DIGITS`` binary digits for the packing, which
bounds the histogram at about ``2 ** DIGITS`` rows per power of two, whatever the corpus.

``pack`` packs into as few shards of a fixed capacity as the rule gives. ``plan_count`` wants a given number of
shards of nearly equal size. A group of an even share or more fills a shard by itself and is set aside, largest
first, as long as the rest has such a group in its own even share; for the rest it bisects the smallest capacity
for which the rule needs no more than the shards left.

Cases: a NULL text has no bytes and shares the group of the empty text; every row counts as size 1 more than its
bytes; equal rows are rows of one group; NULL ids are numbered like others; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobmargin.llm.common import numbered, stored, text_of

SHARDS = 8
DIGITS = 12
FINENESS = 4096  # the capacity is found to this part of an even share
LAW = "bytes"


class CapacityTree:
    """Shards ordered by (remaining capacity, shard): a treap with priorities from the shard number."""

    def __init__(self) -> None:
        self._root = None

    @staticmethod
    def _priority(shard: int) -> int:
        return (shard * 0x9E3779B1 + 0x7F4A7C15) * 0x85EBCA6B & 0xFFFFFFFF

    def _split(self, node, key):
        """Trees of the keys below ``key`` and of the others. A node is [key, priority, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            below, rest = self._split(node[3], key)
            node[3] = below
            return node, rest
        below, rest = self._split(node[2], key)
        node[2] = rest
        return below, node

    def _merge(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] >= high[1]:
            low[3] = self._merge(low[3], high)
            return low
        high[2] = self._merge(low, high[2])
        return high

    def add(self, remaining: int, shard: int) -> None:
        below, rest = self._split(self._root, (remaining, shard))
        self._root = self._merge(self._merge(below, [(remaining, shard), self._priority(shard), None, None]), rest)

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the smallest (remaining, shard) that holds ``size``; None if none does."""
        below, rest = self._split(self._root, (size, -1))
        if rest is None:
            self._root = below
            return None
        least = rest
        while least[2] is not None:
            least = least[2]
        key = least[0]
        _, rest = self._split(rest, (key[0], key[1] + 1))
        self._root = self._merge(below, rest)
        return key


Run = tuple[int, int, int, int]  # size, first number of that size, number after the last, shard


def pack(sizes: Iterable[tuple[int, int]], capacity: int) -> list[Run]:
    """Best-fit decreasing over (size, number of groups), largest first. A group above the capacity gets its own shard."""
    tree, runs, shards = CapacityTree(), [], 0
    for size, count in sorted(sizes, reverse=True):
        done = 0
        while done < count:
            found = tree.take_tightest(size)
            if found is None:
                found = (max(capacity, size), shards)
                shards += 1
            remaining, shard = found
            fit = min(count - done, remaining // size)
            runs.append((size, done, done + fit, shard))
            tree.add(remaining - fit * size, shard)
            done += fit
    return runs


def plan_count(sizes: Sequence[tuple[int, int]], shards: int) -> list[Run]:
    """The packing of the smallest capacity found that needs at most ``shards`` shards."""
    rest, total = dict(sizes), sum(size * count for size, count in sizes)
    alone: list[Run] = []
    # At most one group a shard is set aside, whatever the number of groups.
    for size in sorted(rest, reverse=True):
        done = 0
        while done < rest[size] and len(alone) < shards - 1 and size * (shards - len(alone)) >= total:
            alone.append((size, done, done + 1, len(alone)))
            total, done = total - size, done + 1
        rest[size] -= done
        if rest[size]:
            break
    first = {size: after for size, _, after, _ in alone}
    left = [(size, count) for size, count in rest.items() if count]
    packed = _plan_even(left, shards - len(alone))
    moved = [(size, at + first.get(size, 0), after + first.get(size, 0), shard + len(alone)) for size, at, after, shard in packed]
    return alone + moved


def _plan_even(sizes: Sequence[tuple[int, int]], shards: int) -> list[Run]:
    total = sum(size * count for size, count in sizes)
    if not total:
        return []
    low, high = -(-total // shards), total
    best = pack(sizes, high)
    while high - low > total // shards // FINENESS:
        middle = (low + high) // 2
        tried = pack(sizes, middle)
        if max(run[3] for run in tried) < shards:
            best, high = tried, middle
        else:
            low = middle + 1
    return best


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, text_hash) per row of ``docs``; the texts themselves are read once and never moved."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text_of()) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text_of(), 256)).alias("text_hash"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    """(text_hash, class, number): each group with its rounded size and its number among groups of that size."""
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("bytes"))
    spare = F.greatest(F.length(F.bin("bytes")) - DIGITS, F.lit(0))
    classed = groups.withColumn("spare", spare).withColumn(
        "class", F.expr("shiftleft(shiftright(bytes + shiftleft(1L, spare) - 1, spare), spare)")
    )
    return numbered(classed.select("text_hash", "class"), ["class"], ["text_hash"], "number", buckets=64)


def shard_groups(rows: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """(text_hash, shard) for ``sized`` rows: a number of shards, or a capacity in bytes."""
    groups = stored(_groups(rows), "groups")
    histogram = [(r["class"], r["n"]) for r in groups.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()]
    runs = pack(histogram, capacity) if capacity else plan_count(histogram, shards)
    placed = _local(groups.sparkSession, runs)
    here = (groups["class"] == placed["class"]) & (groups["number"] >= placed["first"]) & (groups["number"] < placed["after"])
    return groups.join(placed, here).select("text_hash", "shard")


def _local(spark: SparkSession, runs: Sequence[Run]) -> DataFrame:
    return spark.createDataFrame(list(runs) or [(0, 0, 0, 0)], "class long, first long, after long, shard int")


def sharded(rows: DataFrame, shards: int | None = SHARDS, capacity: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, text_hash, shard, slot) for ``sized`` rows."""
    placed = rows.join(shard_groups(rows, shards, capacity), "text_hash")
    return numbered(placed, ["shard"], ["doc_id", "text_crc32"], "slot")


def sharding(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (the law ``bytes`` has none) of each document."""
    return sharded(stored(sized(docs), "sized"), shards).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
