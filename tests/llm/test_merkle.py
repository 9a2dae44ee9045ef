"""The manifest against a plain Merkle tree."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from jobmargin.llm import merkle
from tests.llm.conftest import SCHEMA

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, drop_breaks=False):
    values = [row[f] for f in FIELDS]
    if drop_breaks and values[-1] is not None:
        values[-1] = values[-1].replace("\n", "")
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes, fanout=3):
    """The root and, for each node, its (before, after) pairs from the bottom up."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, path in enumerate(paths):
            first = at[i] // fanout * fanout
            path.append(("".join(nodes[first : at[i]]), "".join(nodes[at[i] + 1 : first + fanout])))
            at[i] //= fanout
        nodes = [h(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
    return nodes[0], paths


def brute_force(rows, fanout=3):
    parts = {}
    for row in rows:
        parts.setdefault(row["source"], []).append(row)
    order = sorted(parts, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        members = sorted(parts[source], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        trees[source] = (members, *plain_tree([plain_leaf(r) for r in members], fanout))
    root, upper = plain_tree([trees[s][1] for s in order], fanout)
    found = []
    for source, above in zip(order, upper):
        members, subroot, inner = trees[source]
        for row, path in zip(members, inner):
            proof = path + above
            odd = row["doc_id"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 2
            folded = plain_leaf(row, drop_breaks=not odd)
            for before, after in proof:
                folded = h(before, folded, after)
            digest = h(*[b + a for b, a in proof])
            found.append((row["doc_id"], plain_leaf(row), subroot, root, digest, folded, folded == root))
    return sorted(found, key=repr)


def result(docs, **options):
    changed = F.when(
        F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0,
        merkle.leaf([F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS]),
    )
    proven = merkle.manifest(docs, carry={"tampered": changed}, **options)
    found = proven.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("p"), merkle.fold("coalesce(tampered, leaf)").alias("f")
    ).withColumn("verified", F.expr("f = root"))
    return sorted((tuple(r) for r in found.collect()), key=repr)


def documents_of(spark, sizes, seed=1):
    rng = random.Random(seed)
    rows = [
        (rng.randrange(10**6), rng.choice(["a\nb", "c", None, "", "é\n\n"]) , rng.choice(["en", None]), source, rng.choice([3, None]))
        for source, n in sizes.items() for _ in range(n)
    ]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("options", [
    {}, {"block_levels": 1, "lanes": 3}, {"block_levels": 0, "lanes": 9}, {"block_levels": 1, "lanes": 81}, {"block_levels": 2, "lanes": 1},
])
def test_every_proof(spark, options):
    sizes = {"b": 100, None: 5, "": 1, "a": 28, "é": 3, "z": 4, "Z": 10, "aa": 27}
    docs = documents_of(spark, sizes)
    assert result(docs, **options) == brute_force(docs.collect())


def test_other_fanout(spark):
    docs = documents_of(spark, {"a": 37, "b": 1, "c": 8}, seed=2)
    assert result(docs, fanout=2, block_levels=2, lanes=4) == brute_force(docs.collect(), 2)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_one_part(spark, n):
    docs = documents_of(spark, {"only": n}, seed=n)
    assert result(docs, block_levels=0) == brute_force(docs.collect())


def test_edge_rows(spark, edge_docs):
    rows = sorted((tuple(r) for r in merkle.merkle_manifest(edge_docs).collect()), key=repr)
    assert rows == brute_force(edge_docs.collect())


def test_equal_rows_of_one_part(spark):
    docs = spark.createDataFrame([(1, "same", "en", "s", 4)] * 40 + [(2, "x\ny", "en", "s", 3)], SCHEMA).repartition(4)
    assert result(docs, block_levels=1) == brute_force(docs.collect())


def test_verification_fails_where_a_line_break_went(spark):
    docs = spark.createDataFrame([(i, "two\nlines" if i % 3 else "one", "en", f"s{i % 2}", 3) for i in range(60)], SCHEMA)
    for row in merkle.merkle_manifest(docs).collect():
        changed = zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and row["doc_id"] % 3
        assert row["verified"] == (not changed) and (row["folded_root"] == row["root"]) == row["verified"]


def test_a_round_moves_a_few_rows_for_each_key(spark):
    """A part of 729 blocks beside parts of one block: no listener key has many rows."""
    rows = [(0, b, 729, f"{b}") for b in range(729)] + [(p, 0, 1, f"p{p}") for p in range(1, 9)]
    state = spark.createDataFrame(rows, "part long, block long, part_blocks long, hash string")
    found = merkle.butterfly(state, lanes=27).collect()
    assert len(found) == len(rows) and len({r["hash"] for r in found}) == 1
    assert {len(r["path"]) for r in found} == {8, 2}


def test_empty(spark, no_docs):
    found = merkle.merkle_manifest(no_docs)
    assert found.collect() == []
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
