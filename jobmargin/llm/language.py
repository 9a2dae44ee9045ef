"""Language of a text by multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else becomes one blank; n-grams of ``ORDERS`` characters are hashed into
``FEATURES`` buckets. The model is a matrix of log-probabilities, buckets by languages, broadcast to all tasks: its
size is fixed by these two numbers and bounded, as more than ``MOST_LANGUAGES`` values of ``lang`` are an error. A batch of
texts is a sparse matrix of counts, a row per text, and is scored by one product with the model in numpy. The fit counts
a hash sample of about ``FIT_ROWS`` labelled documents at most (a documented bound of the fit only); rows that are equal in
all columns come into it together, each with its weight.

Cases: a NULL text, or one without a letter, is ``und`` with score 0, and so is everything where no language could be
learned; long texts are scored whole, in steps; ties go to the first language by name; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

FEATURES = 1 << 14
ORDERS = (1, 2, 3)
FIT_ROWS = 20_000
SMOOTHING = 0.5
MOST_LANGUAGES = 256
CHARS_AT_ONCE = 1 << 18
CELLS_AT_ONCE = 1 << 20  # of a product, before its rows are summed
UNKNOWN = "und"
UNIFORM = 1 << 30


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def features(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in steps; nothing if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[codes]
    if not letter.any():
        return
    codes = np.where(letter, codes, 32)
    keep = letter | np.concatenate(([True], letter[:-1]))  # one blank after each word
    codes = np.concatenate(([32], codes[keep], [32])).astype(np.uint64)
    step = max(ORDERS) - 1
    for at in range(0, len(codes), CHARS_AT_ONCE):
        part = codes[at : at + CHARS_AT_ONCE + step]
        found = []
        for n in ORDERS:
            size = min(CHARS_AT_ONCE, len(part) - n + 1)
            if size > 0:
                mixed = np.full(size, n, np.uint64)
                for k in range(n):
                    mixed = (mixed ^ part[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
                    mixed ^= mixed >> np.uint64(29)
                found.append(mixed % np.uint64(FEATURES))
        yield np.concatenate(found).astype(np.int64)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Buckets that occur in a text, ascending, and how often; None if it has no letter."""
    counts = None
    for part in features(text):
        own = np.bincount(part, minlength=FEATURES)
        counts = own if counts is None else counts + own
    if counts is None:
        return None
    seen = np.flatnonzero(counts)
    return seen, counts[seen]


def fit_languages(
    labelled: DataFrame, fit_rows: int = FIT_ROWS, most_languages: int = MOST_LANGUAGES
) -> tuple[list[str], np.ndarray]:
    """Languages by name and the log-probabilities, one row per bucket and a last one of log priors.

    ``labelled``: (text, lang) rows; further columns only help to spread the sample over copies of a text. Counts are
    made where the texts are; the sums come to the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = sums.setdefault(lang, np.zeros(FEATURES + 1, np.int64))
                own[FEATURES] += 1
                for part in features(text.as_py()):
                    own[:FEATURES] += np.bincount(part, minlength=FEATURES)
        for lang, own in sums.items():
            seen = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen)), pa.array(seen), pa.array(own[seen])], ["lang", "feature", "n"])

    known = labelled.where("lang is not null and text is not null")
    sizes = known.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    chance = int(min(1.0, fit_rows / max(1, sum(r["count"] for r in sizes))) * UNIFORM)
    chosen = known.where(F.pmod(F.xxhash64(*known.columns), F.lit(UNIFORM)) < chance).select("lang", "text")
    rows = chosen.mapInArrow(count, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in rows})
    counts = np.zeros((FEATURES + 1, len(langs)))
    place = {lang: i for i, lang in enumerate(langs)}
    for r in rows:
        counts[r["feature"], place[r["lang"]]] = r["n"]
    grams, texts = counts[:FEATURES] + SMOOTHING, counts[FEATURES:]
    return langs, np.log(np.vstack((grams / grams.sum(axis=0), texts / max(1.0, texts.sum()))))


def score(texts: list[str | None], langs: list[str], model: np.ndarray) -> tuple[list[str], list[float]]:
    """Best language and its posterior for each text."""
    names, posteriors = [UNKNOWN] * len(texts), [0.0] * len(texts)
    rows: list[tuple[int, np.ndarray, np.ndarray]] = []

    def flush() -> None:
        buckets, counts = (np.concatenate([row[k] for row in rows]) for k in (1, 2))
        starts = np.cumsum([0, *(len(row[1]) for row in rows[:-1])])
        totals = model[FEATURES] + np.add.reduceat(model[buckets] * counts[:, None], starts, axis=0)
        best = totals.argmax(axis=1)
        top = np.take_along_axis(totals, best[:, None], axis=1)
        for (at, *_), lang, p in zip(rows, best, 1.0 / np.exp(totals - top).sum(axis=1)):
            names[at], posteriors[at] = langs[lang], float(p)
        rows.clear()

    cells = 0
    for at, text in enumerate(texts):
        own = counted(text) if langs else None
        if own is None:
            continue
        more = len(own[0]) * len(langs)
        if rows and cells + more > CELLS_AT_ONCE:
            flush()
            cells = 0
        rows.append((at, *own))
        cells += more
    if rows:
        flush()
    return names, posteriors


def languages(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """(doc_id, lang_pred, score); only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                names, posteriors = score(part.column(1).to_pylist(), langs, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(names, pa.string()), pa.array(posteriors, pa.float64())], ["doc_id", "lang_pred", "score"]
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """One document in three, by the checksum of its id; NULL ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from documents that are not held out and have an id."""
    learned = docs.where(~held_out() & F.col("doc_id").isNotNull())
    found = languages(docs, *fit_languages(learned.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
