"""Mixing by soft domain membership: how often each document is taken so that domain totals match targets.

1. A multinomial naive Bayes model over hashed words is fitted on labelled documents, a hash sample of at most
   about ``FIT_ROWS`` of them (a documented bound of the fit only).
2. Every document gets posteriors over the domains, from the mean log-likelihood per word times at most
   ``EVIDENCE`` words: long texts do not turn into certainties.
3. Rates x minimise the weighted squares sum_k (sum_d x_d n_d p_dk - T_k)^2 / S_k over x_d >= ``least``, with n_d
   words, targets T and S_k the domain's words at rate 1. As the posteriors of a document sum to 1, the
   curvature of this sum along the documents is at most 1 and projected gradient steps of length 1 descend:
   x_d <- max(least, x_d - sum_k p_dk (M_k - T_k) / S_k). A step is one aggregate of K sums over the posteriors;
   only these K sums reach the driver.
4. A document is taken floor(x + u) times, u a uniform hash of its id and text.

Cases: a text without words has the model's prior as posterior, no weight, and a rate like any other; labels
that are NULL, or of unknown documents, are ignored; documents labelled twice with the same domain count
once; no labelled words at all: one domain ``none`` that holds everything; equal rows get the same rate and copies;
empty tables give no rows. Built-in expressions only.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from jobmargin.llm.common import drop_stored, read, stored, text_key, text_of, words_of

LOG = logging.getLogger(__name__)

FEATURES = 1 << 14
FIT_ROWS = 20_000
DOMAINS = 256
EVIDENCE = 2
SMOOTHING = 0.5
STEPS = 200
STEPS_AT_ONCE = 6
CLOSE = 1e-4
STILL = 1e-4
HEADROOM = 1.1
UNIFORM = 1 << 30


def _words() -> Column:
    """Lower-cased words; the text is lower-cased as a whole, which is far cheaper than word by word."""
    return words_of(F.lower(text_of()))


def _feature(word: str) -> Column:
    """NULL for no word, which meets no feature of the model."""
    return F.when(F.col(word).isNotNull(), F.pmod(F.xxhash64(word), F.lit(FEATURES))).cast("int")


def fit_domains(docs: DataFrame, labelled: DataFrame, fit_rows: int = FIT_ROWS) -> tuple[list[str], DataFrame, list[float]]:
    """Domain names, (feature, l0, l1, ...) log-probabilities, and log priors.

    ``labelled``: (doc_id, domain). The model has FEATURES x domains numbers, whatever the corpus.
    """
    known = labelled.where("doc_id is not null and domain is not null").select("doc_id", F.col("domain").cast("string")).distinct()
    known = stored(known, "labelled")
    total = max(1, known.count())
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(UNIFORM)) < int(min(1.0, fit_rows / total) * UNIFORM))
    priors = {r["domain"]: r["n"] for r in chosen.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    # The sample is broadcast, as its rows are counted here; labels whose sample came out larger are joined as Spark sees fit.
    side = F.broadcast(chosen) if sum(priors.values()) <= 2 * FIT_ROWS else chosen
    words = docs.select("doc_id", "text").join(side, "doc_id").select("domain", F.explode(_words()).alias("word"))
    counts = stored(words.groupBy("domain", _feature("word").alias("feature")).agg(F.count(F.lit(1)).alias("n")), "counts")
    totals = {r["domain"]: r["n"] for r in counts.groupBy("domain").agg(F.sum("n").alias("n")).collect()}
    domains = sorted(totals)
    if len(domains) > DOMAINS:
        raise ValueError(f"{len(domains)} domains; the model is made for at most {DOMAINS}")
    if not domains:
        return ["none"], counts.select("feature", F.lit(0.0).alias("l0")), [0.0]
    logs = []
    for i, domain in enumerate(domains):
        seen = F.sum(F.when(F.col("domain") == domain, F.col("n")).otherwise(0))
        logs.append(F.log((seen + SMOOTHING) / (totals[domain] + SMOOTHING * FEATURES)).alias(f"l{i}"))
    labels = sum(priors[d] for d in domains)
    return domains, counts.groupBy("feature").agg(*logs), [math.log(priors[d] / labels) for d in domains]


def posteriors(docs: DataFrame, domains: Sequence[str], model: DataFrame, log_priors: Sequence[float]) -> DataFrame:
    """(doc, n_words, p0, p1, ...): ``doc`` holds id and text key; ``n_words`` covers all rows of the document.

    Words meet the model, whose size is fixed, in a broadcast join, and are summed up in the task that read
    them; one row per document and task is shuffled. The key of the text is made in a step before the one that
    lists the words: beside the generator it would be hashed again for every word.
    """
    k = range(len(domains))
    keyed = docs.select("doc_id", text_key().alias("text_key"), _words().alias("words"))
    words = keyed.select("doc_id", "text_key", F.explode_outer("words").alias("word"))
    scored = words.select("doc_id", "text_key", "word", _feature("word").alias("feature")).join(F.broadcast(model), "feature", "left")
    sums = (
        scored.groupBy("doc_id", "text_key")
        .agg(F.count("word").alias("n_words"), F.count("l0").alias("known"), *[F.sum(f"l{i}").alias(f"s{i}") for i in k])
        .withColumn("doc", F.struct("doc_id", "text_key"))
    )
    # Words that the fit has not met say nothing about the domain.
    weight = F.least(F.col("known"), F.lit(EVIDENCE)) / F.greatest(F.col("known"), F.lit(1))
    logs = sums.select(
        "doc", "n_words", *[(F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * weight + F.lit(log_priors[i])).alias(f"g{i}") for i in k]
    )
    most = F.greatest(*[F.col(f"g{i}") for i in k]) if len(domains) > 1 else F.col("g0")
    raised = logs.withColumn("most", most).select("doc", "n_words", *[F.exp(F.col(f"g{i}") - F.col("most")).alias(f"e{i}") for i in k])
    whole = reduce(lambda a, b: a + b, [F.col(f"e{i}") for i in k])
    return raised.withColumn("whole", whole).select("doc", "n_words", *[(F.col(f"e{i}") / F.col("whole")).alias(f"p{i}") for i in k])


def fit_rates(soft: DataFrame, targets: Sequence[float], least: float = 0.0) -> DataFrame:
    """``soft`` with the column ``rate``; ``targets`` are word totals in the order of the domains.

    The descent ends where all totals are within ``CLOSE`` of their targets, or where no rate moves by ``STILL`` any more:
    then the rates are about the closest to targets that rates of at least ``least`` cannot meet. Where a target is
    missed, and after ``STEPS`` steps in any case, the gap that is left is logged as a warning.
    """
    k = range(len(targets))

    def totals(df: DataFrame, rate: Column, moved: Column) -> list[float]:
        sums = [F.sum(rate * F.col("n_words") * F.col(f"p{i}")) for i in k]
        return [value or 0.0 for value in df.agg(*[s.alias(f"m{i}") for i, s in enumerate(sums)], F.max(moved)).first()]

    start = F.lit(max(1.0, least))
    scale = [max(s, 1e-9) for s in totals(soft, F.lit(1.0), F.lit(0.0))[:-1]]
    current, (*mixed, moved) = soft.withColumn("rate", start), totals(soft, start, F.lit(1.0))
    folder = None
    for step in range(1, STEPS + 2):
        gaps = [(m - t) / s for m, t, s in zip(mixed, targets, scale)]
        worst = max(abs(g) * s / max(t, 1e-9) for g, s, t in zip(gaps, scale, targets))
        if worst < CLOSE:
            break
        if moved < STILL or step > STEPS:
            LOG.warning("after %d steps a domain is still %.2f %% from its target", step - 1, 100 * worst)
            break
        slope = reduce(lambda a, b: a + b, [F.col(f"p{i}") * F.lit(gaps[i]) for i in k])
        stepped = F.greatest(F.lit(float(least)), F.col("rate") - slope)
        current = current.withColumns({"before": F.col("rate"), "rate": stepped})
        if step % STEPS_AT_ONCE == 0:  # keeps the expression, and what a lost executor repeats, short
            current, before = stored(current, "rates"), folder
            folder = current
            if before is not None:
                drop_stored(before)
        *mixed, moved = totals(current, F.col("rate"), F.abs(F.col("rate") - F.col("before")))
    return current.select(*soft.columns, "rate")


def word_targets(soft: DataFrame, domains: Sequence[str], weights: Mapping[str, float] | None, power: float, grow: bool) -> list[float]:
    """Word totals per domain.

    Weights are the given ones, or the domains' own shares raised to ``power``. The sum is that of the corpus, or,
    with ``grow``, ``HEADROOM`` times as large as is needed for no domain to shrink: documents that are partly of a
    domain that need not grow then still have rates above 1, and the targets can be met.
    """
    own = [v or 0.0 for v in soft.agg(*[F.sum(F.col("n_words") * F.col(f"p{i}")) for i in range(len(domains))]).first()]
    raw = [(weights.get(d, 0.0) if weights is not None else own[i] ** power if own[i] else 0.0) for i, d in enumerate(domains)]
    whole = sum(raw) or 1.0
    shares = [r / whole for r in raw]
    total = HEADROOM * max([o / s for o, s in zip(own, shares) if s > 0], default=0.0) if grow else sum(own)
    return [total * s for s in shares]


def source_rates(
    docs: DataFrame,
    labelled: DataFrame,
    weights: Mapping[str, float] | None = None,
    power: float = 0.5,
    least: float = 0.0,
    grow: bool = False,
    fit_rows: int = FIT_ROWS,
) -> DataFrame:
    """(doc, n_words, domain, membership, rate, copies), one row per document."""
    domains, model, log_priors = fit_domains(docs, labelled, fit_rows)
    soft = stored(posteriors(docs, domains, model, log_priors), "posteriors")
    rates = fit_rates(soft, word_targets(soft, domains, weights, power, grow), least)
    best = F.greatest(*[F.col(f"p{i}") for i in range(len(domains))]) if len(domains) > 1 else F.col("p0")
    named = F.coalesce(*[F.when(F.col(f"p{i}") == F.col("membership"), F.lit(d)) for i, d in enumerate(domains)])
    uniform = F.pmod(F.xxhash64("doc.doc_id", "doc.text_key", F.lit("copies")), F.lit(UNIFORM)) / UNIFORM
    return rates.withColumn("membership", best).select(
        "doc", "n_words", named.alias("domain"), "membership", "rate", F.floor(F.col("rate") + uniform).alias("copies")
    )


def source_mixing(docs: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, domain, membership, rate and copies of each document."""
    return source_rates(docs, labelled, **options).select("doc.doc_id", "n_words", "domain", "membership", "rate", "copies")


def mixed(docs: DataFrame, labelled: DataFrame, **options) -> DataFrame:
    """Each document as often as its rate says, with its own columns."""
    copies = source_rates(docs, labelled, **options).select(F.col("doc").alias("llm__doc"), "copies")
    copies = copies.where("copies > 0").withColumnRenamed("copies", "llm__copies")
    joined = docs.join(copies, F.struct("doc_id", text_key().alias("text_key")) == F.col("llm__doc"))
    return joined.select(*docs.columns, F.explode(F.expr("array_repeat(0, cast(llm__copies as int))")).alias("llm__copy")).drop("llm__copy")


def language_labels(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, domain): the language of the documents in table ``labels``."""
    return docs.select("doc_id", F.col("lang").alias("domain")).join(read(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi")
