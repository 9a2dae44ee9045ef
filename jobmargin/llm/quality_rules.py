"""Quality rules as a cascade: rules run in the order of what they reject per unit of cost.

Every document gets the base statistics. Documents that fail a base rule are rejected. On the others
a list of further rules runs as one CASE expression, so a document that one rule rejects is not looked
at by the next. A hash sample of the documents gives each rule's cost (characters and words it visits)
and selectivity; the order decides what a verdict costs and which rule is named, never the verdict.

Nulls and blanks: a NULL or blank text has no words and fails the base rules. Empty table: no rows, rules
stay in declared order. Any length of text is read whole. Built-in expressions only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from jobmargin.llm.common import text_of, words_of

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words


@dataclass(frozen=True)
class Rule:
    """``rejects`` and ``work`` are SQL over the ``llm__`` columns; work is what one evaluation visits."""

    name: str
    rejects: str
    work: str


# With the marks that belong to them: scripts with vowel signs write up to half of a word as marks.
LETTERS = r"length(regexp_replace(llm__text, '[^\\p{L}\\p{M}]+', ''))"
CAPITALS = r"length(regexp_replace(llm__text, '\\P{Lu}+', ''))"
TEXT_WORK = "2 * length(llm__text)"

RULES = (
    Rule("shouting", f"{CAPITALS} > 0.4 * {LETTERS}", f"2 * {TEXT_WORK}"),
    Rule("few_letters", f"{LETTERS} < 0.5 * llm__word_chars", TEXT_WORK),
    Rule(
        "wordless_tokens",
        r"size(filter(llm__words, w -> not w rlike '\\p{L}')) > 0.3 * llm__n_words",
        "4 * llm__n_words",
    ),
    Rule("marks", r"size(regexp_extract_all(llm__text, '[!?]{2,}', 0)) > 0.2 * llm__n_words", "length(llm__text)"),
    Rule("word_length", "llm__word_chars not between 2 * llm__n_words and 15 * llm__n_words", "1"),
    Rule("symbols", "llm__n_symbols > 0.1 * llm__n_words", "1"),
    Rule("repeated_lines", "llm__n_dup_lines > 0.5 * llm__n_lines", "1"),
)


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The caller's columns and the base statistics, all but those prefixed with ``llm__``.

    Words in repeated three-word windows: windows become 64-bit hashes, and only a document that has
    an equal pair goes on. There one sort by hash and position makes equal windows neighbours, and the
    positions they cover are counted.
    """
    own = docs.columns
    symbols = F.length("llm__text") - F.length(F.regexp_replace("llm__text", r"[#*$%&|<>]+", ""))
    with_words = docs.withColumns({"llm__text": text_of(text)}).withColumns(
        {
            "llm__words": words_of(F.col("llm__text")),
            "llm__lines": F.filter(F.split("llm__text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")),
        }
    )
    counted = with_words.select(
        *own,
        "llm__text",
        "llm__words",
        F.size("llm__words").alias("llm__n_words"),
        F.length(F.array_join("llm__words", "")).alias("llm__word_chars"),
        symbols.alias("llm__n_symbols"),
        F.size("llm__lines").alias("llm__n_lines"),
        (F.size("llm__lines") - F.size(F.array_distinct("llm__lines"))).alias("llm__n_dup_lines"),
        F.expr(
            """if(size(llm__words) < 3, cast(array() as array<bigint>),
               transform(sequence(2, size(llm__words) - 1), i ->
                 xxhash64(get(llm__words, i - 2), get(llm__words, i - 1), get(llm__words, i))))"""
        ).alias("llm__windows"),
    )
    sorted_windows = counted.withColumn(
        "llm__sorted",
        F.expr(
            """if(size(array_distinct(llm__windows)) = size(llm__windows), cast(array() as array<struct<h: bigint, i: int>>),
               sort_array(transform(llm__windows, (h, i) -> struct(h as h, i as i))))"""
        ),
    )
    repeated = sorted_windows.withColumn(
        "llm__repeated",
        F.expr(
            """transform(
                 filter(llm__sorted, (w, k) -> w.h = get(llm__sorted, k - 1).h or w.h = get(llm__sorted, k + 1).h),
                 w -> w.i)"""
        ),
    )
    covered = F.expr(
        "size(array_distinct(concat(llm__repeated, transform(llm__repeated, p -> p + 1), transform(llm__repeated, p -> p + 2))))"
    )
    # A generator of one row: filters on the statistics are not pushed below it, which would repeat their work.
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    done = repeated.withColumn("llm__n_repeat_words", covered)
    figures = F.struct(*[F.col(f"llm__{name}") for name in names])
    return done.select(*own, "llm__text", "llm__words", F.inline(F.array(figures)))


def _base_failed():
    return F.expr(f"llm__n_words < {LEAST_WORDS} or 100 * llm__n_repeat_words > {MOST_REPEATED} * llm__n_words")


def ordered_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", one_in: int = 64) -> list[Rule]:
    """Rules by rejections per unit of cost, from one aggregate over about one in ``one_in`` documents.

    The sample follows a hash of the text, so it is the same in every run and for every partitioning.
    """
    sample = docs.select(text).where(F.pmod(F.xxhash64(F.col(text), F.lit(one_in)), F.lit(one_in)) == 0)
    judged = with_statistics(sample, text).where(~_base_failed())
    measures = []
    for rule in rules:
        measures += [F.expr(f"avg(double({rule.work}))"), F.expr(f"avg(if({rule.rejects}, 1D, 0D))")]
    seen = judged.agg(*[m.alias(f"m{i}") for i, m in enumerate(measures)]).first()
    if seen["m0"] is None:
        return list(rules)
    gain = {rule.name: seen[2 * i + 1] / max(seen[2 * i], 1e-9) for i, rule in enumerate(rules)}
    return sorted(rules, key=lambda rule: -gain[rule.name])


def judge(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """The caller's columns with ``llm__`` statistics, ``llm__base_failed`` and ``llm__failed_rule`` (NULL: kept)."""
    rules = ordered_rules(docs, text=text) if rules is None else rules
    cascade = " ".join(f"when {rule.rejects} then '{rule.name}'" for rule in rules)
    verdict = f"case when llm__base_failed then 'base' {cascade} end"
    judged = with_statistics(docs, text).withColumn("llm__base_failed", _base_failed())
    return judged.withColumn("llm__failed_rule", F.expr(verdict)).drop("llm__text", "llm__words")


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: base statistics, ``base_failed``, ``kept``."""
    counts = [F.col(f"llm__{name}").cast("long").alias(name) for name in BASE]
    return judge(docs.select("doc_id", "text")).select(
        "doc_id", *counts, F.col("llm__base_failed").alias("base_failed"), F.isnull("llm__failed_rule").alias("kept")
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    return judge(docs).where("llm__failed_rule is null").select(*docs.columns)
