"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

P(grade >= j) = sigmoid(w . x - c_j): one weight vector for all thresholds c_1 < c_2 < ..., so a word moves a text
along one scale. Features are hashed lower-cased words and their first four and five letters, with the value
log(1 + occurrences). The model keeps features that are significantly more frequent in documents of a grade above
0, at most ``MOST_FEATURES``. A document's expected severity is the sum of P(grade >= j).

The fit uses a hash sample of about ``FIT_ROWS`` labelled documents at most (a documented bound of the fit only), first of
ids, then of their rows, so that an id with many texts does not pass the bound. Frequencies are counted by Spark; the
driver gets, for the sample, the selected features alone.

Cases: a NULL or wordless text has no features and so the severity of the base rate; labels that are NULL or of unknown
documents are ignored; a document labelled twice takes its higher grade; repeated rows count once in the fit; without
documents of two grades everything has severity 0; equal rows get equal results; long texts are read whole; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from jobmargin.llm.common import stored

HASH_SPACE = 1 << 22
FIT_ROWS = 20_000
MOST_FEATURES = 4096
LEAST_Z = 3.0
LEAST_LOG_ODDS = 1.5
PENALTY = 1e-3
ROUNDS = 400
UNIFORM = 1 << 30
REMEMBERED = 1 << 17  # words whose features a Python worker keeps at hand
WORD = re.compile(r"\w+")


@lru_cache(REMEMBERED)
def _hashed(word: str) -> tuple[int, ...]:
    return tuple([xxhash.xxh32_intdigest(name) % HASH_SPACE for name in (f"w {word}", f"4 {word[:4]}", f"5 {word[:5]}")])


def features(text: str | None, only: Mapping[int, float] | None = None) -> dict[int, int]:
    """Hashed feature -> occurrences; just of the features in ``only``, if given."""
    found: Counter[int] = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for feature in _hashed(word):
            if only is None or feature in only:
                found[feature] += n
    return found


@dataclass(frozen=True)
class Severity:
    """``weights`` by feature, ``cuts`` ascending."""

    weights: dict[int, float]
    cuts: tuple[float, ...]

    def at_least(self, text: str | None) -> np.ndarray:
        """P(grade >= j) for j = 1, 2, ..."""
        if not self.cuts:
            return np.zeros(0)
        lean = sum(self.weights[f] * math.log1p(n) for f, n in features(text, self.weights).items())
        return 1.0 / (1.0 + np.exp(np.clip(np.array(self.cuts) - lean, -700, 700)))


def fit_ordinal(rows: list[list[tuple[int, float]]], grades: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending cuts that minimise the penalised negative log-likelihood of the cumulative links."""
    lengths = [len(r) for r in rows]
    of = np.repeat(np.arange(len(rows)), lengths)
    column = np.fromiter((f for r in rows for f, _ in r), np.int64, len(of))
    value = np.fromiter((v for r in rows for _, v in r), float, len(of))
    top = int(grades.max())
    above = np.array([(grades >= j).mean() for j in range(1, top + 1)])
    free = np.log((1 - above) / above)
    free[1:] = np.log(np.maximum(np.diff(free), 1e-2))  # first cut, then logs of the steps between cuts
    x = np.concatenate((np.zeros(size), free))
    mean, square = np.zeros_like(x), np.zeros_like(x)

    def cuts_of(free: np.ndarray) -> np.ndarray:
        return np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))

    for step in range(1, ROUNDS + 1):
        weights, cuts = x[:size], cuts_of(x[size:])
        lean = np.bincount(of, value * weights[column], len(rows))
        # P(grade >= j), with certain and impossible ends.
        links = 1.0 / (1.0 + np.exp(np.clip(cuts[None, :] - lean[:, None], -30, 30)))
        full = np.hstack((np.ones((len(rows), 1)), links, np.zeros((len(rows), 1))))
        low, high = full[np.arange(len(rows)), grades], full[np.arange(len(rows)), grades + 1]
        chance = np.maximum(low - high, 1e-12)
        d_low, d_high = low * (1 - low) / chance, high * (1 - high) / chance
        by_lean = -(d_low - d_high) / len(rows)
        by_cut = np.zeros(top)
        np.add.at(by_cut, grades[grades > 0] - 1, d_low[grades > 0] / len(rows))
        np.add.at(by_cut, grades[grades < top], -d_high[grades < top] / len(rows))
        tail = np.cumsum(by_cut[::-1])[::-1]  # a step moves all later cuts
        slope = np.concatenate((
            np.bincount(column, value * by_lean[of], size) + PENALTY * weights,
            tail * np.concatenate(([1.0], np.exp(x[size + 1 :]))),
        ))
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        x -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return x[:size], cuts_of(x[size:])


def _featured(docs: DataFrame) -> DataFrame:
    """(grade, features, counts) of (grade, text) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [features(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(x, pa.list_(pa.int32())) for x in ([list(f) for f in found], [list(f.values()) for f in found]))],
                    ["grade", "features", "counts"],
                )

    return docs.select("grade", "text").mapInArrow(run, "grade int, features array<int>, counts array<int>")


def _telling(featured: DataFrame) -> list[int]:
    """Features that are more frequent above grade 0, by document frequency and its standard error."""
    sizes = featured.agg(F.sum(F.expr("if(grade > 0, 1, 0)")), F.sum(F.expr("if(grade > 0, 0, 1)"))).first()
    if not sizes[0] or not sizes[1]:
        return []
    seen = featured.select(F.col("grade") > 0, F.explode("features")).toDF("above", "feature").groupBy("feature").agg(
        F.sum(F.expr("if(above, 1, 0)")).alias("a"), F.sum(F.expr("if(above, 0, 1)")).alias("b")
    )
    odds = f"ln((a + 0.5) / {sizes[0] + 1}) - ln((b + 0.5) / {sizes[1] + 1})"
    ranked = seen.selectExpr("feature", f"{odds} as odds", f"({odds}) / sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) as z")
    telling = ranked.where(f"z >= {LEAST_Z} and odds >= {LEAST_LOG_ODDS}").orderBy(F.desc("z"), "feature").limit(MOST_FEATURES)
    return [r["feature"] for r in telling.collect()]


def _only(featured: DataFrame, place: dict[int, int]) -> DataFrame:
    """``featured`` with the features in ``place``, by their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [
                [(place[f], n) for f, n in zip(features, counts) if f in place]
                for features, counts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            ]
            lists = (pa.array([[pair[k] for pair in row] for row in pairs], pa.list_(pa.int32())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["grade", "features", "counts"])

    return featured.mapInArrow(run, featured.schema)


def _sample(docs: DataFrame, graded: DataFrame, fit_rows: int) -> DataFrame:
    def sampled(df: DataFrame, n: int, *key: str) -> DataFrame:
        return df if n <= fit_rows else df.where(F.pmod(F.xxhash64(*key), F.lit(UNIFORM)) < int(fit_rows / n * UNIFORM))

    known = graded.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").cast("int").alias("grade"))
    # About ``fit_rows`` ids and grades: small enough for every task, and an id with many rows is not one task's work.
    chosen = F.broadcast(stored(sampled(known, known.count(), "doc_id"), "chosen"))
    n = docs.select("doc_id").join(chosen, "doc_id").count()
    rows = sampled(docs.select("doc_id", "text"), n, "text", "doc_id").join(chosen, "doc_id")
    return rows.distinct().select("grade", "text")


def fit_severity(docs: DataFrame, graded: DataFrame, fit_rows: int = FIT_ROWS, levels: int = 1) -> Severity:
    """The model from (doc_id, grade) labels, grades 0, 1, 2, ...

    ``levels`` above 1 serves labels that only tell toxic from not: documents of grade 1 are then graded 1 to ``levels`` by how
    often the telling features occur in them, in groups of about equal size.
    """
    featured = stored(_featured(_sample(docs, graded, fit_rows)), "labelled")
    telling = _telling(featured)
    if not telling:
        return Severity({}, ())
    place, rows, grades = {f: i for i, f in enumerate(telling)}, [], []
    for row in _only(featured, place).collect():
        rows.append([(f, math.log1p(n)) for f, n in zip(row["features"], row["counts"])])
        grades.append(row["grade"])
    grades = np.array(grades)
    if levels > 1:
        strength = np.array([sum(v for _, v in r) for r in rows])
        cuts = np.quantile(strength[grades > 0], np.arange(1, levels) / levels)
        grades = np.where(grades > 0, 1 + np.searchsorted(np.unique(cuts), strength), 0)
    kinds = np.unique(grades)  # grades that occur, in order
    weights, cuts = fit_ordinal(rows, np.searchsorted(kinds, grades), len(telling))
    return Severity({f: float(w) for f, w in zip(telling, weights)}, tuple(float(c) for c in cuts))


def severities(docs: DataFrame, model: Severity) -> DataFrame:
    """doc_id, severity (expected grade), grade (the largest j with P(grade >= j) of one half or more), toxic (grade above 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                links = [shared.value.at_least(t) for t in part.column(1).to_pylist()]
                grade = np.array([int((p >= 0.5).sum()) for p in links], np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([float(p.sum()) for p in links], pa.float64()), pa.array(grade), pa.array(grade > 0)],
                    ["doc_id", "severity", "grade", "toxic"],
                )

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, severity double, grade int, toxic boolean")


def toxicity(docs: DataFrame, labels: DataFrame, levels: int = 3) -> DataFrame:
    """Severity of every document, learned from table ``labels`` (doc_id, toxic 0 or 1)."""
    return severities(docs, fit_severity(docs, labels.select("doc_id", F.col("toxic").alias("grade")), levels=levels))
