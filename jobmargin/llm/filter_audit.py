"""Filter interaction audit: what every order of a set of filters keeps and loses, per part of the corpus.

Each document fails a subset of the filters, its mask. Documents with equal part and mask behave alike in every order,
so they are summed to cells first: at most 2**filters of them a part. Each cell then folds, with higher-order
functions, across the array of all orders, a constant of the plan: ``aggregate`` walks one order, filter by filter,
and ``transform`` does so for all of them. The outcome, one weighted struct for each order and step (600 for five
filters), is summed element by element over the cells of a part.

One of the filters may be "identical to the text of a smaller document id", which no row can tell by itself. It is
counted without joining copies to each other: every document with an id counts as a copy, and the documents with the
least id of their text (by SHA-256) are moved back to the cell without that filter. A frequent text is one row per task
before the shuffle that finds its least id.

Texts are read once and never moved; what is shuffled and stored is id, part, mask and digest.

Cases: a NULL or blank text is empty and NULL and empty texts are identical; a NULL part counts with the empty one; a
document without id is never a copy and makes no other one a copy; equal rows are documents of their own and not
copies of each other; a document is labelled by any of its label rows, and labels of unknown or NULL ids count for
nothing; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import DataFrame, functions as F

from jobmargin.llm.common import stored, text_of, words_of

# Failure conditions over llm__text, llm__words, llm__n_words. Their limits are fixed values.
FILTERS: dict[str, str] = {
    "A": "llm__n_words < 50",
    "B": "100 * size(array_distinct(llm__words)) < 65 * llm__n_words",
    "C": "100 * (length(llm__text) - length(regexp_replace(llm__text, '[A-Z]+', ''))) > 5 * length(llm__text)",
    "D": "llm__text rlike '[#$%&*|]'",
}
COPIES = "E"
WEIGHTS = ("n", "good", "toxic")
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def masks(docs: DataFrame, filters: Mapping[str, str], text: str, part: str) -> DataFrame:
    """``doc_id, part, digest, mask``: bit k of the mask is set where the k-th filter fails the document."""
    read = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_of(text).alias("llm__text"))
    counted = read.withColumn("llm__words", words_of(F.col("llm__text"))).withColumn("llm__n_words", F.size("llm__words"))
    bits = [f"if({failed}, {1 << k}, 0)" for k, failed in enumerate(filters.values())]
    return counted.select(
        "doc_id", "part", F.expr("unhex(sha2(llm__text, 256))").alias("digest"), F.expr(" + ".join(bits) or "0").alias("mask")
    )


def with_flags(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic``, 0 or 1, by document id.

    The flags are stored before the join: with both sides read from files, adaptive execution can split an id, or the
    lack of one, that holds a large share of the rows.
    """
    flags = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.expr("int(quality <=> 1)")).alias("good"), F.max(F.expr("int(toxic <=> 1)")).alias("toxic")
    )
    flags = stored(flags.withColumnRenamed("doc_id", "labelled_id"), "flags")
    joined = rows.join(flags, F.col("doc_id") == F.col("labelled_id"), "left")
    return joined.select(*rows.columns, F.expr("coalesce(good, 0) as good"), F.expr("coalesce(toxic, 0) as toxic"))


def cells(rows: DataFrame, copies_bit: int = 0) -> DataFrame:
    """``part, mask`` with the numbers of documents, good and toxic ones; with a bit, copies of a text fail it too."""
    weights = {"n": F.lit(1), "good": F.col("good"), "toxic": F.col("toxic")}

    def entries(df: DataFrame, mask: str, sign: int) -> DataFrame:
        return df.select("part", F.expr(mask).alias("mask"), *[(sign * w).cast("long").alias(k) for k, w in weights.items()])

    if not copies_bit:
        found = entries(rows, "mask", 1)
    else:
        with_id = rows.where("doc_id is not null")
        least = with_id.groupBy(F.col("digest").alias("of_text")).agg(F.min("doc_id").alias("least_id"))
        firsts = with_id.join(least, F.expr("digest = of_text and doc_id = least_id"))
        found = (
            entries(rows, f"if(doc_id is null, mask, mask | {copies_bit})", 1)
            .union(entries(firsts, f"mask | {copies_bit}", -1))
            .union(entries(firsts, "mask", 1))
        )
    summed = found.groupBy("part", "mask").agg(*[F.sum(w).alias(w) for w in WEIGHTS])
    return summed.where("n > 0")


def _fold(cell: str, orders: str) -> str:
    """SQL: a cell's figures for all orders and steps, one struct each; orders list bits by their number."""
    fails = f"(shiftright({cell}.mask, k) & 1) = 1"
    lost = {"removed": "n", "good_lost": "good", "toxic_lost": "toxic"}
    removed = f"{fails} and not gone.already"
    fields = {
        "kept": f"if(gone.already or {fails}, 0L, {cell}.n)",
        **{name: f"if({removed}, {cell}.{weight}, 0L)" for name, weight in lost.items()},
        "redundant": f"if({fails} and gone.already, {cell}.n, 0L)",
        "unique_fails": f"if({cell}.mask = shiftleft(1, k), {cell}.n, 0L)",
        "shapley": f"{cell}.n * {cell}.first_in[k]",
    }
    struct = ", ".join(f"{fields[name]} as {name}" for name in FIGURES)
    kind = ", ".join(f"{name}: bigint" for name in FIGURES)
    return f"""flatten(transform({orders}, steps -> aggregate(steps,
        struct(false as already, cast(array() as array<struct<{kind}>>) as figures),
        (gone, k) -> struct(gone.already or {fails} as already,
          concat(gone.figures, array(struct({struct}))) as figures),
        gone -> gone.figures)))"""


def _first_in(mask: str, orders: str, bits: int) -> str:
    """SQL: for each bit the number of orders in which it is the first one set in ``mask``."""
    firsts = f"transform({orders}, steps -> get(filter(steps, k -> (shiftright({mask}, k) & 1) = 1), 0))"
    count = "aggregate(firsts, 0L, (n, first) -> n + if(first <=> bit, 1L, 0L))"
    return f"transform(array({firsts}), firsts -> transform(sequence(0, {bits - 1}), bit -> {count}))[0]"


def audit(found: DataFrame, letters: str) -> DataFrame:
    """``part, filter_order, step`` and the figures, from the cells; ``letters`` names the bits, lowest first."""
    every = list(permutations(range(len(letters))))
    orders = "array(" + ", ".join(f"array({', '.join(map(str, order))})" for order in every) + ")"
    names = "array(" + ", ".join(f"'{''.join(letters[k] for k in order)}'" for order in every) + ")"
    # At most one cell for each subset of the filters, so the list of a part is short whatever the part holds.
    by_part = found.groupBy("part").agg(F.collect_list(F.struct("mask", *WEIGHTS)).alias("cells"))
    sums = ", ".join(f"total.{name} + one.{name} as {name}" for name in FIGURES)
    merged = f"""aggregate(slice(cells, 2, size(cells)), {_fold('cells[0]', 'orders')},
        (totals, cell) -> zip_with(totals, {_fold('cell', 'orders')}, (total, one) -> struct({sums})))"""
    with_orders = by_part.select("part", "cells", F.expr(orders).alias("orders"))
    fields = ", ".join(f"c.{name}" for name in ("mask", *WEIGHTS))
    counted = f"transform(cells, c -> struct({fields}, {_first_in('c.mask', 'orders', len(letters))} as first_in)) as cells"
    figures = with_orders.selectExpr("part", "orders", counted).select("part", F.expr(merged).alias("figures"))
    rows = figures.select("part", F.posexplode("figures").alias("at", "figure"))
    return rows.select(
        "part",
        F.expr(f"{names}[at div {len(letters)}]").alias("filter_order"),
        F.expr(f"int(at % {len(letters)} + 1)").alias("step"),
        "figure.*",
    )


def filter_audit(
    docs: DataFrame,
    labels: DataFrame,
    filters: Mapping[str, str] = FILTERS,
    copies: str | None = COPIES,
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """All orders of ``filters`` (name of one letter: failure condition), and of ``copies`` if given, over ``docs``."""
    letters = "".join(filters) + (copies or "")
    rows = stored(with_flags(masks(docs, filters, text, part), labels), "masks")
    return audit(cells(rows, 1 << len(filters) if copies else 0), letters)
