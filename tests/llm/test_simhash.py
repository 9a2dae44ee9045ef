import random

import numpy as np
import xxhash

from jobmargin.llm import simhash
from jobmargin.llm.components import components
from tests.llm.conftest import rows_of


def plain_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\t\n\x0b\f\r" else c for c in lowered).split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, max_bits=4):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= max_bits:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(prints)):
        r = root(i)
        known = [x for x in (least.get(r), ids[i]) if x is not None]
        least[r] = min(known) if known else None
    return [least[root(i)] for i in range(len(prints))]


def check(docs):
    source = docs.select("doc_id", "text").collect()
    ids, prints = [r[0] for r in source], [plain_fingerprint(r[1]) for r in source]
    want = sorted(zip(ids, (f"{p:016x}" for p in prints), plain_components(ids, prints)), key=repr)
    assert rows_of(simhash.simhash_dedup(docs)) == want


def test_against_all_pairs(documents):
    check(documents)


def test_edge_rows(edge_docs):
    check(edge_docs)


def test_empty(no_docs):
    assert simhash.simhash_dedup(no_docs).collect() == []
    assert simhash.keep_one(no_docs).collect() == []


def test_keep_one(edge_docs):
    kept = simhash.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    found = simhash.simhash_components(edge_docs).select("root").distinct().count()
    assert kept.count() == found
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} >= {1, 5, 7}


def test_trie_links_match_all_pairs_in_dense_and_sparse_groups():
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    dense = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(300)}
    sparse = {rng.getrandbits(14) << 50 | rng.getrandbits(8) for _ in range(500)}
    rows = sorted((block, value) for block, values in ((-3, dense), (9, sparse)) for value in values)
    label = simhash.trie_links(np.array([b for b, _ in rows]), np.array([v for _, v in rows], np.uint64))
    for block in (-3, 9):
        at = [i for i, (b, _) in enumerate(rows) if b == block]
        want = plain_components(at, [rows[i][1] for i in at])
        assert label[at].tolist() == want


def test_hot_band_values_are_cut_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TRIE_ROWS", 40)
    rng = random.Random(7)
    prints = list({(rng.getrandbits(20) << 3) for _ in range(300)} | {0xFFFF0000 + i for i in range(50)})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    roots = {r["u"]: r["v"] for r in components(simhash.links(df)).collect()}
    got = [roots.get(p, p) for p in prints]
    want = plain_components(list(range(len(prints))), prints)
    assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 200)]
    found = dict(rows_of(components(spark.createDataFrame(edges, "u long, v long"))))
    assert found == {**{i: 0 for i in range(1, 61)}, 200: 100}
