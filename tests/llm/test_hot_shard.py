"""Shards of equal bytes beside groups above an even share."""

from collections import Counter

import pytest

from jobmargin.llm import sharding


def totals_of(sizes, runs):
    placed, totals = Counter(), Counter()
    for size, first, after, shard in sorted(runs):
        assert placed[size] == first
        placed[size] = after
        totals[shard] += size * (after - first)
    assert placed == Counter(dict(sizes))
    return totals


@pytest.mark.parametrize("hot", [[50_000], [50_000, 50_000], [300_000, 20_000], [400_000, 14_500, 14_400]])
def test_the_rest_is_even_beside_hot_groups(hot):
    sizes = Counter(hot) + Counter({100 + i % 37: 25 for i in range(37)})
    sizes[100] += 1000 - sum(n for s, n in sizes.items() if s < 200)
    totals = totals_of(sizes.items(), sharding.plan_count(list(sizes.items()), 8))
    rest = sorted(totals.values())[: 8 - len(hot)]
    assert len(totals) == 8 and max(rest) <= 1.03 * sum(rest) / len(rest)


def test_more_hot_groups_than_shards():
    sizes = [(1000, 20), (7, 3)]
    totals = totals_of(sizes, sharding.plan_count(sizes, 8))
    assert len(totals) == 7 or len(totals) == 8
    assert max(totals.values()) <= 3021


def test_a_group_of_a_third_of_the_bytes(spark):
    texts = ["hot " * 20] * 200 + [f"own text {i} " * 4 for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    totals = Counter()
    for r in sharding.sharding(docs).collect():
        totals[r["shard"]] += r["size"]
    _, *rest = sorted(totals.values(), reverse=True)
    assert len(rest) == 7 and max(rest) < 1.1 * sum(rest) / 7
