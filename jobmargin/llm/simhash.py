"""Near-duplicate documents by SimHash and a self-join of binary tries.

Each document gets a 64-bit fingerprint of its word shingles. Distinct fingerprints are linked when at
most ``max_bits`` bits differ, and linked documents form components.

How the join is dealt out: with ``max_bits + 1`` bands of bits, two fingerprints within the distance agree
in one band at least, so each fingerprint goes to one trie per band, that of its band's value. A task holds
the tries of many band values. It walks pairs of trie nodes downwards from (root, root), adds up the
differing bits, and drops a pair that exceeds the budget. Pairs of nodes that are already known to be
connected are dropped too, so a dense group costs about its size, and each trie gives at most one link per
fingerprint. A band value with more than ``TRIE_ROWS`` fingerprints is cut into hash parts, one trie for each
two of them.

Cases: a text without words has fingerprint 0 and is linked like any other; fewer words than a shingle are one
shingle; NULL ids take part and a component's id is its smallest id that is not NULL (NULL if there is none);
equal rows share a fingerprint; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from jobmargin.llm.common import stored, text_key
from jobmargin.llm.components import components

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BITS = 64
SHINGLES_AT_ONCE = 1 << 16
# Rows of one trie, those of a batch of tries walked together, node pairs walked together, leaf pairs compared outright.
TRIE_ROWS = 1 << 17
BATCH_ROWS = 1 << 16
PAIRS_AT_ONCE = 1 << 18
LEAF_PAIRS = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The majority bits of the shingles' XXH64; whole text, in bounded steps."""
    words = (text or "").encode().lower().split()  # bytes: lower() knows A-Z only, split() the ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], blanks + 1))
    ends = np.concatenate((blanks, [len(joined)]))
    if len(words) >= shingle:
        starts, ends = starts[: len(words) - shingle + 1], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[part].tolist(), ends[part].tolist())]
        hashes = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(hashes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    majority = np.packbits(ones * 2 > len(starts), bitorder="little")
    return int(majority.view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fingerprint) as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "text_key", "fingerprint"]
            )

    narrow = docs.select(F.col("doc_id").cast("long"), text_key().alias("text_key"), "text")
    return narrow.mapInArrow(run, "doc_id long, text_key long, fingerprint long")


def _join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Unites the rows i and j; every label stays the smallest row of its set."""
    while True:
        a, b = label[i], label[j]
        differ = a != b
        if not differ.any():
            return
        i, j = i[differ], j[differ]
        np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while True:
            further = label[label]
            if np.array_equal(further, label):
                break
            label[:] = further


def _leaf_pairs(a_lo, a_hi, b_lo, b_hi) -> tuple[np.ndarray, np.ndarray]:
    """All row pairs under the given node pairs."""
    wide = b_hi - b_lo
    sizes = (a_hi - a_lo) * wide
    which = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return a_lo[which] + within // wide[which], b_lo[which] + within % wide[which]


def trie_links(block: np.ndarray, prints: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Rows sorted by (block, fingerprint): for each row the smallest row it is connected with in its block.

    Rows of one block under a common prefix are a trie node, kept as a range of rows; a pair of nodes is two
    ranges and the number of bits in which their prefixes differ.
    """
    label = np.arange(len(prints))
    edges = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1], [True])))
    lo, hi = edges[:-1], edges[1:]
    start = (lo, hi, lo, hi, np.zeros(len(lo), np.int64))
    stack = [(0, start)]
    while stack:
        depth, pairs = stack.pop()
        if len(pairs[0]) > PAIRS_AT_ONCE:
            stack.append((depth, tuple(x[PAIRS_AT_ONCE:] for x in pairs)))
            pairs = tuple(x[:PAIRS_AT_ONCE] for x in pairs)
        a_lo, a_hi, b_lo, b_hi, used = pairs
        # Neither lone rows paired with themselves nor nodes that hang together already.
        changes = np.concatenate(([0], np.cumsum(label[1:] != label[:-1])))
        one = (changes[a_lo] == changes[a_hi - 1]) & (changes[b_lo] == changes[b_hi - 1]) & (label[a_lo] == label[b_lo])
        pairs = tuple(x[~one] for x in pairs)
        a_lo, a_hi, b_lo, b_hi, used = pairs
        small = (a_hi - a_lo) * (b_hi - b_lo) <= LEAF_PAIRS
        if depth == BITS:
            small[:] = True
        if small.any():
            i, j = _leaf_pairs(*(x[small] for x in pairs[:4]))
            near = (i != j) & (np.bitwise_count(prints[i] ^ prints[j]) <= max_bits)
            _join_labels(label, i[near], j[near])
        if small.all():
            continue
        a_lo, a_hi, b_lo, b_hi, used = (x[~small] for x in pairs)
        ones = np.concatenate(([0], np.cumsum((prints >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)))
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        cross = a_lo != b_lo  # a node paired with itself has the mixed pair of its children once
        children = (
            (a_lo, a_mid, b_lo, b_mid, used),
            (a_mid, a_hi, b_mid, b_hi, used),
            (a_lo, a_mid, b_mid, b_hi, used + 1),
            (a_mid[cross], a_hi[cross], b_lo[cross], b_mid[cross], used[cross] + 1),
        )
        joined = tuple(np.concatenate(parts) for parts in zip(*children))
        live = (joined[0] < joined[1]) & (joined[2] < joined[3]) & (joined[4] <= max_bits)
        if live.any():
            stack.append((depth + 1, tuple(x[live] for x in joined)))
    return label


def _linked(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Sorted (block, fingerprint) rows in, links out; whole blocks at a time."""

    def links(block: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        prints = prints.view(np.uint64)
        order = np.lexsort((prints, block))  # Spark sorts fingerprints as signed numbers
        block, prints = block[order], prints[order]
        label = trie_links(block, prints, max_bits)
        moved = label != np.arange(len(label))
        signed = prints.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[moved]), pa.array(signed[label[moved]])], ["u", "v"])

    held = [np.empty(0, np.int64), np.empty(0, np.int64)]
    for batch in batches:
        held = [np.concatenate((h, c.to_numpy(zero_copy_only=False))) for h, c in zip(held, batch.columns)]
        whole = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        if whole >= BATCH_ROWS:
            yield links(held[0][:whole], held[1][:whole])
            held = [h[whole:].copy() for h in held]
    if len(held[0]):
        yield links(*held)


def _bands(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each band."""
    edges = [round(i * BITS / (max_bits + 1)) for i in range(max_bits + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _blocks(prints: DataFrame, max_bits: int) -> DataFrame:
    """(block, fingerprint): each distinct fingerprint once per band, more often where a band value is hot.

    A block number holds the band, its value, and the two hash parts of the fingerprints it joins. There are at
    most bands x 2^13 counts, and only those of the hot values are joined back.
    """
    value = F.array(*[
        F.struct(
            F.lit(band).alias("band"),
            F.shiftrightunsigned("fingerprint", low).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias("value"),
        )
        for band, (low, width) in enumerate(_bands(max_bits))
    ])
    dealt = prints.select("fingerprint", F.inline(value))
    parts = F.ceil(F.count(F.lit(1)) / F.lit(TRIE_ROWS)).cast("int")
    hot = dealt.groupBy("band", "value").agg(parts.alias("parts")).where("parts > 1")
    joined = dealt.join(hot, ["band", "value"], "left")
    own = F.expr("pmod(xxhash64(fingerprint), coalesce(parts, 1))").cast("int")
    pairs = joined.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")))
    block = F.expr(
        """shiftleft(cast(band as bigint), 59) | shiftleft(cast(value as bigint), 40)
           | shiftleft(cast(least(own, other) as bigint), 20) | cast(greatest(own, other) as bigint)"""
    )
    return pairs.select(block.alias("block"), "fingerprint")


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(u, v) fingerprints within ``max_bits``: enough of them to connect all that are linked."""
    dealt = _blocks(prints.select("fingerprint").distinct(), max_bits)
    dealt = dealt.repartition("block").sortWithinPartitions("block")
    return dealt.mapInArrow(lambda batches: _linked(batches, max_bits), "u long, v long")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, text_key, fingerprint, root, component_id) for each row of ``docs``; root: a fingerprint of the component."""
    prints = stored(fingerprints(docs, shingle), "fingerprints")
    first = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(prints, max_bits)).select(F.col("u").alias("fingerprint"), F.col("v").alias("root"))
    rooted = first.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    rooted = stored(rooted, "rooted")
    # Written before the join, as a component may hold a large share of the fingerprints: see components.
    least = stored(rooted.groupBy(F.col("root").alias("of_root")).agg(F.min("first_id").alias("component_id")), "least")
    labels = stored(rooted.join(least, F.col("root") == F.col("of_root")).select("fingerprint", "root", "component_id"), "labels")
    return prints.join(labels, "fingerprint").select("doc_id", "text_key", "fingerprint", "root", "component_id")


def hex_digits(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def simhash_dedup(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document."""
    return simhash_components(docs, shingle, max_bits).select(
        "doc_id", hex_digits("fingerprint").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, that with the smallest id (NULL ids last), with its own columns."""
    first = F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "text_key")).alias("first")
    kept = (
        simhash_components(docs, shingle, max_bits)
        .groupBy("root")
        .agg(first)
        .select(F.col("first.doc_id").alias("llm__id"), F.col("first.text_key").alias("llm__key"))
    )
    keyed = docs.withColumns({"llm__own": F.col("doc_id").cast("long"), "llm__text": text_key()})
    matched = keyed.join(
        kept, F.col("llm__own").eqNullSafe(F.col("llm__id")) & (F.col("llm__text") == F.col("llm__key")), "left_semi"
    )
    # Rows that repeat both id and text: the join has dealt them to one task already.
    rank = F.row_number().over(Window.partitionBy("llm__own", "llm__text").orderBy(F.lit(0)))
    return matched.withColumn("llm__rank", rank).where("llm__rank = 1").select(*docs.columns)
