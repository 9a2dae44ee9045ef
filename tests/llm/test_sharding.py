import random
import zlib
from collections import Counter, defaultdict

import pytest

from jobmargin.llm import sharding
from tests.llm.conftest import rows_of


def plain_best_fit(sizes, capacity):
    """(remaining, items) per shard by the textbook rule; ties go to the lower shard."""
    remaining = []
    for size in sorted(sizes, reverse=True):
        fitting = [(r, i) for i, r in enumerate(remaining) if r >= size]
        if fitting:
            remaining[min(fitting)[1]] -= size
        else:
            remaining.append(max(capacity, size) - size)
    return remaining


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = [rng.choice((1, 2, 3, 5, 8, 13, 40, rng.randint(1, 120))) for _ in range(400)]
    runs = sharding.pack(Counter(sizes).items(), 100)
    used = defaultdict(int)
    for size, first, after, shard in runs:
        used[shard] += size * (after - first)
    want = plain_best_fit(sizes, 100)
    got = [max(100, used[s]) - used[s] for s in range(len(used))]
    assert sorted(got) == sorted(want)
    placed = Counter()
    for size, first, after, _ in runs:
        assert placed[size] == first
        placed[size] = after
    assert placed == Counter(sizes)


def check(docs, found, shards=8):
    source = [(r[0], (r[1] or "").encode()) for r in docs.select("doc_id", "text").collect()]
    rows = found.collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is not None) == sorted(
        (i, len(t) + 1, zlib.crc32(t)) for i, t in source if i is not None
    )
    assert len(rows) == len(source)
    by_shard, of_text = defaultdict(list), defaultdict(set)
    for r in rows:
        by_shard[r["shard"]].append(r["slot"])
        of_text[r["size"], r["text_crc32"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert all(len(s) == 1 for s in of_text.values())


def test_documents(documents):
    found = sharding.sharding(documents)
    check(documents, found)
    totals = Counter()
    for r in found.collect():
        totals[r["shard"]] += r["size"]
    assert len(totals) == 8 and max(totals.values()) < 1.03 * sum(totals.values()) / 8


def test_edges(edge_docs, no_docs):
    check(edge_docs, sharding.sharding(edge_docs))
    assert sharding.sharding(no_docs).collect() == []


def test_fixed_capacity(documents):
    rows = sharding.sized(documents)
    found = sharding.sharded(rows, capacity=20_000)
    largest = max(sum(r[1] for r in g) for g in [[x] for x in rows_of(rows, "doc_id", "size")])
    sums = Counter()
    for r in found.collect():
        sums[r["shard"]] += r["size"]
    assert max(sums.values()) <= max(20_000, 4 * largest)
