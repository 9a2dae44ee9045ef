"""Merkle manifest of a table: a leaf per row, a tree per part, a tree over the parts, and a proof for every row.

Rows become leaves (SHA-256 over length-prefixed fields, hex text). Within a part leaves ascend by id; runs of
``FANOUT`` neighbours, the last run maybe shorter, become their hash until one node, the part's subroot, remains.
Subroots in the order of the parts give the root in the same way.

A range sort places the leaves; numbers of rows per sorted partition turn places into gapless slots. Aligned blocks of
``FANOUT ** BLOCK_LEVELS`` leaves, the partitions of the method, hash the levels inside them. Above that, blocks take part
in a butterfly: in each round aligned groups of ``FANOUT`` subtrees swap their roots, block by block with the blocks
at the same place in the other subtrees, and every block hashes the common ancestor for itself and notes the siblings
it was sent. So after as many rounds as there are levels each block holds the root and its own upper proof, and
nothing is handed down. A subtree at the ragged end has fewer blocks than its siblings: those it has send once for each
missing place. From ``LANES`` places on, places repeat, and in the rounds over parts the blocks of the first part of a
subtree send for it; this keeps an exchange at a few rows per key whatever one part holds.

Only digests move: texts are read once, where the leaves are made. A block is one row of at most
``FANOUT ** BLOCK_LEVELS`` leaves. Each round is a written table.

Cases: NULL fields count as ``-``, so NULL and empty texts have different leaves; the NULL part comes first and is
not the empty one; NULL ids come first within a part; equal ids are ordered by their leaves, and equal rows, which
have equal leaves, are leaves of their own; a part of one row is its own subroot, and a table of one part has that
subroot as root; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from jobmargin.llm.common import stored

FANOUT = 3
BLOCK_LEVELS = 7
LANES = FANOUT**4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NOTHING = "cast(array() as array<struct<before: string, after: string>>)"


def leaf(values: Sequence[Column]) -> Column:
    """Hash of fields in order: ``-`` for NULL, else length in bytes, colon, value."""
    framed = []
    for value in values:
        value = value.cast("string")
        framed.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*framed), 256)


def leaves(docs: DataFrame, fields: Sequence[str], part: str, row_id: str, carry: Mapping[str, Column]) -> DataFrame:
    """``part_key, row_id, leaf``, the place in the scan, and ``carry``. Part keys are never NULL and sort like the parts."""
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(part)), F.lit("")).alias("part_key"),
        F.col(row_id).alias("row_id"),
        leaf([F.col(f) for f in fields]).alias("leaf"),
        F.monotonically_increasing_id().alias("scanned"),
        F.struct(F.lit(0).alias("none"), *[value.alias(name) for name, value in carry.items()]).alias("carried"),
    )


def placed(found: DataFrame) -> DataFrame:
    """Adds ``part`` (0, 1, ... in part order), ``slot`` (0, 1, ... in each part) and ``part_rows``.

    The place in the scan only spreads equal rows over tasks. Rows are written with their sorted place, so a lost
    executor cannot change it; what is summed afterwards is one row per part and sorted partition.
    """
    order = ["part_key", "row_id", "leaf", "scanned"]
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = stored(ranged.drop("scanned"), "sorted").withColumn("file_of", F.expr("shiftright(at, 33)"))
    runs = ranged.groupBy("part_key", "file_of").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("run_rows"))
    of_part = Window.partitionBy("part_key").orderBy("file_of")
    runs = stored(
        runs.select(
            "*",
            F.coalesce(F.sum("run_rows").over(of_part.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rows_before"),
            F.sum("run_rows").over(Window.partitionBy("part_key")).alias("part_rows"),
            F.row_number().over(of_part).alias("run"),
        ),
        "runs",
    )
    # Parts are numbered by the file that holds their first row: one row per file goes to the only unpartitioned window.
    parts = runs.where("run = 1")
    begun = parts.groupBy("file_of").agg(F.count(F.lit(1)).alias("parts_here"))
    earlier = Window.orderBy("file_of").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.select("file_of", F.coalesce(F.sum("parts_here").over(earlier), F.lit(0)).alias("parts_before"))
    here = F.row_number().over(Window.partitionBy("file_of").orderBy("first_at"))
    numbered = parts.join(begun, "file_of").select("part_key", (F.col("parts_before") + here - 1).alias("part"))
    runs = runs.join(numbered, "part_key").select("part_key", "file_of", "part", "part_rows", "first_at", "rows_before")
    slot = F.col("rows_before") + F.col("at") - F.col("first_at")
    return ranged.join(runs, ["part_key", "file_of"]).select("part", "part_rows", slot.alias("slot"), "row_id", "leaf", "carried")


def _hash_runs(nodes: str, fanout: int) -> str:
    """SQL: the hashes of the runs of an array of digests."""
    run = f"slice({nodes}, cast(i * {fanout} + 1 as int), {fanout})"
    return f"transform(sequence(0, (size({nodes}) - 1) div {fanout}), i -> sha2(array_join({run}, ''), 256))"


def with_levels(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """Adds ``level0`` to ``level<levels>``. A part of one block stops at one node; other blocks go through all levels."""
    blocks = blocks.withColumn("level0", F.expr("transform(members, m -> m.leaf)"))
    for k in range(levels):
        done = f"part_blocks = 1 and size(level{k}) = 1"
        blocks = blocks.withColumn(f"level{k + 1}", F.expr(f"if({done}, level{k}, {_hash_runs(f'level{k}', fanout)})"))
    return blocks


def _inner_path(fanout: int, levels: int) -> str:
    """SQL: siblings before and after the ``i``-th leaf of a block, level by level."""
    steps = []
    for k in range(levels):
        node, run = f"(i div {fanout**k})", f"(i div {fanout ** (k + 1)} * {fanout})"
        before = f"array_join(slice(level{k}, cast({run} + 1 as int), cast({node} - {run} as int)), '')"
        after = f"array_join(slice(level{k}, cast({node} + 2 as int), cast({run} + {fanout - 1} - {node} as int)), '')"
        steps.append(f"if(part_blocks = 1 and size(level{k}) = 1, null, struct({before} as before, {after} as after))")
    return f"filter(array({', '.join(steps)}), step -> step is not null)" if steps else NOTHING


def exchange(state: DataFrame, tree: str, node: str, nodes: str, place: str, width: str, listens: str, lanes: int, fanout: int) -> DataFrame:
    """One round: each block receives the roots of its subtree's group, hashes the ancestor and notes the siblings.

    ``place`` is a block's place among the ``width`` blocks that send for its subtree, NULL if it does not send;
    ``listens`` the place it listens at. A subtree that is alone in its tree (``nodes`` is 1) waits.
    """
    state = state.selectExpr(
        "*", f"{tree} as tree", f"{node} % {fanout} as digit", f"if({nodes} > 1, {node} div {fanout}, -1L) as parent",
        f"{listens} as lane", f"{place} as place", f"{width} as width",
    )
    sent = state.where(f"parent >= 0 and place < {lanes}").selectExpr(
        "tree", "parent", f"explode(sequence(place, {lanes - 1}L, width)) as lane", "struct(digit, hash) as root"
    )
    swapped = sent.groupBy("tree", "parent", "lane").agg(F.sort_array(F.collect_list("root")).alias("group"))
    joined = state.join(swapped, ["tree", "parent", "lane"], "left")
    before, after = [f"array_join(transform(filter(group, g -> g.digit {side} digit), g -> g.hash), '')" for side in "<>"]
    return joined.selectExpr(
        "part", "block", "part_blocks", "subroot",
        "if(group is null, hash, sha2(array_join(transform(group, g -> g.hash), ''), 256)) as hash",
        f"if(group is null, path, concat(path, array(struct({before} as before, {after} as after)))) as path",
    )


def _levels_above(count: int, fanout: int) -> int:
    levels = 0
    while fanout**levels < count:
        levels += 1
    return levels


def butterfly(state: DataFrame, fanout: int = FANOUT, lanes: int = LANES) -> DataFrame:
    """``part, block, subroot, hash`` (the root) and ``path`` for every block of ``part, block, part_blocks, hash``."""
    state = stored(state.selectExpr("part", "block", "part_blocks", "cast(null as string) as subroot", "hash", f"{NOTHING} as path"), "blocks")
    most, parts = state.agg(F.max("part_blocks"), F.max("part") + 1).first()
    for level in range(_levels_above(most or 0, fanout)):
        under = fanout**level
        open_lanes = min(under, lanes)
        state = stored(
            exchange(
                state, "part", f"(block div {under})", f"ceil(part_blocks / {under})", f"block % {under}",
                f"least({under}L, part_blocks - block div {under} * {under})", f"block % {open_lanes}", open_lanes, fanout,
            ),
            "round",
        )
    state = state.withColumn("subroot", F.col("hash"))
    for level in range(_levels_above(parts or 0, fanout)):
        under = fanout**level
        state = stored(
            exchange(
                state, "0", f"(part div {under})", f"ceil({parts} / {under})", f"if(part % {under} = 0, block, null)",
                "part_blocks", f"(block + part) % {lanes}", lanes, fanout,
            ),
            "round",
        )
    return state


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    part: str = "source",
    row_id: str = "doc_id",
    carry: Mapping[str, Column] | None = None,
    fanout: int = FANOUT,
    block_levels: int = BLOCK_LEVELS,
    lanes: int = LANES,
) -> DataFrame:
    """``row_id, leaf, subroot, root``, ``path`` and the ``carry`` expressions, for every row of ``docs``.

    ``path`` is the proof, from the leaf up: digests before and after the node in its run, put together.
    """
    carry = carry or {}
    found = placed(stored(leaves(docs, fields, part, row_id, carry), "leaves"))
    size = fanout**block_levels
    member = F.struct("slot", "row_id", "leaf", "carried")
    blocks = found.groupBy("part", F.expr(f"slot div {size}").alias("block"), F.expr(f"ceil(part_rows / {size})").alias("part_blocks"))
    blocks = stored(blocks.agg(F.sort_array(F.collect_list(member)).alias("members")), "members")
    roots = with_levels(blocks, fanout, block_levels).select("part", "block", "part_blocks", F.expr(f"level{block_levels}[0]").alias("hash"))
    upper = butterfly(roots, fanout, lanes).selectExpr("part", "block", "subroot", "hash as root", "path as upper")
    whole = with_levels(blocks.join(upper, ["part", "block"]), fanout, block_levels)
    inner = f"transform(members, (m, i) -> struct(m as member, {_inner_path(fanout, block_levels)} as inner))"
    rows = whole.select("subroot", "root", "upper", F.explode(F.expr(inner)).alias("row"))
    own = [F.col(f"row.member.carried.{name}").alias(name) for name in carry]
    return rows.select(
        F.col("row.member.row_id").alias(row_id), F.col("row.member.leaf").alias("leaf"), "subroot", "root",
        F.expr("concat(row.inner, upper)").alias("path"), *own,
    )


def fold(start: str, path: str = "path") -> Column:
    """The root that a leaf and a proof lead to."""
    return F.expr(f"aggregate({path}, {start}, (node, step) -> sha2(concat(step.before, node, step.after), 256))")


def proof_digest(path: str = "path") -> Column:
    """Hash of all siblings of a proof, from the leaf up and left to right."""
    return F.expr(f"sha2(array_join(transform({path}, step -> concat(step.before, step.after)), ''), 256)")


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of ``docs`` and, for the documents whose id has an even CRC-32, verification against a text without line breaks."""
    tampered = [F.replace(F.col(f), F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS]
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(even & F.col("text").contains("\n"), leaf(tampered))
    proven = manifest(docs.select(*FIELDS), carry={"tampered": changed})
    folded = proven.select(
        "doc_id", "leaf", "subroot", "root", proof_digest().alias("proof_sha256"), fold("coalesce(tampered, leaf)").alias("folded_root")
    )
    return folded.withColumn("verified", F.expr("folded_root = root"))
