"""Language identification and toxicity: held-out accuracy and edge rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from jobmargin.llm import language, toxicity
from tests.llm.conftest import rows_of


def test_language_on_held_out_documents(documents):
    found = language.language_id(documents).join(documents.select("doc_id", "lang"), "doc_id")
    rows = found.collect()
    assert len(rows) == documents.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_edges(spark, edge_docs, no_docs):
    rows = language.language_id(edge_docs).collect()
    texts = {1: "und", 2: "und", 3: "und", 9: "und"}
    assert all(r["lang_pred"] == texts[r["doc_id"]] for r in rows if r["doc_id"] in texts)
    assert language.language_id(no_docs).collect() == []
    unlabelled = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {(r["lang_pred"], r["score"]) for r in language.language_id(unlabelled).collect()} == {("und", 0.0)}


def test_language_features_do_not_depend_on_the_step(monkeypatch):
    text = "Das ist, ein Text 123 mit Wörtern! " * 40
    whole = np.sort(np.concatenate(list(language.features(text))))
    monkeypatch.setattr(language, "CHARS_AT_ONCE", 17)
    assert np.array_equal(np.sort(np.concatenate(list(language.features(text)))), whole)


def test_language_model_against_plain_counts(documents):
    langs, model = language.fit_languages(documents.select("text", "lang"))
    counts = np.full((language.FEATURES, len(langs)), language.SMOOTHING)
    for r in documents.collect():
        for part in language.features(r["text"]):
            np.add.at(counts[:, langs.index(r["lang"])], part, 1)
    assert np.allclose(model[:-1], np.log(counts / counts.sum(axis=0)))


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    fit = labels.where("pmod(xxhash64(doc_id), 4) <> 0").select("doc_id", F.col("toxic").alias("grade"))
    model = toxicity.fit_severity(docs, fit, levels=3)
    english = docs.where("lang = 'en'")
    rows = toxicity.severities(english, model).join(labels.where("pmod(xxhash64(doc_id), 4) = 0").withColumnRenamed("toxic", "label"), "doc_id").collect()
    assert len(rows) > 40
    assert sum(r["toxic"] == bool(r["label"]) for r in rows) >= 0.95 * len(rows)
    assert list(model.cuts) == sorted(model.cuts)


def test_ordinal_fit_recovers_the_order():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (600, 3))
    lean = x @ np.array([2.0, 0.0, -2.0])
    grades = np.digitize(lean + rng.logistic(0, 0.5, 600), [-2.0, 2.0])
    rows = [[(k, float(v)) for k, v in enumerate(r) if v] for r in x]
    weights, cuts = toxicity.fit_ordinal(rows, grades, 3)
    assert weights[0] > 1 > abs(weights[1]) and weights[2] < -1 and cuts[0] < cuts[1]


def test_toxicity_edges(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (5, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    found = toxicity.toxicity(edge_docs, labels)
    assert rows_of(found, "severity", "grade", "toxic") == [(0.0, 0, False)] * edge_docs.count()
    assert toxicity.toxicity(no_docs, labels).collect() == []
    assert toxicity.toxicity(edge_docs, labels.limit(0)).count() == edge_docs.count()


def plain_grams(text):
    """Bucket -> occurrences, character by character."""
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not letters.strip():
        return Counter()
    shown = " " + "".join(c for at, c in enumerate(letters) if c != " " or at == 0 or letters[at - 1] != " ") + " "
    found = Counter()
    for size in language.ORDERS:
        for at in range(len(shown) - size + 1):
            mixed = size
            for c in shown[at : at + size]:
                mixed = (mixed ^ ord(c)) * 0x9E3779B97F4A7C15 % 2**64
                mixed ^= mixed >> 29
            found[mixed % language.FEATURES] += 1
    return found


def test_language_scores_against_a_plain_scorer(spark, documents, edge_docs, monkeypatch):
    langs, model = language.fit_languages(documents.select("text", "lang"))
    monkeypatch.setattr(language, "CELLS_AT_ONCE", 5_000)  # many products for one batch
    short = [r["text"] for r in documents.where("length(text) < 3000").limit(60).collect()]
    texts = [*short, None, "", " 1 2 !", "é", "\U0001f600", "a" * 3000, short[0]]
    names, posteriors = language.score(texts, langs, model)
    for text, name, posterior in zip(texts, names, posteriors):
        grams = plain_grams(text)
        if not grams:
            assert (name, posterior) == ("und", 0.0)
            continue
        logs = [model[language.FEATURES, k] + sum(n * model[f, k] for f, n in grams.items()) for k in range(len(langs))]
        assert name == langs[logs.index(max(logs))]
        assert posterior == pytest.approx(1 / sum(math.exp(x - max(logs)) for x in logs), abs=1e-9)
    found = rows_of(language.languages(edge_docs, langs, model), "doc_id", "lang_pred", "score")
    source = edge_docs.select("doc_id", "text").collect()
    assert found == sorted(((r[0], *(x[0] for x in language.score([r[1]], langs, model))) for r in source), key=repr)


def test_more_languages_than_the_model_may_hold(spark):
    rows = spark.createDataFrame([(f"text {i}", f"l{i}") for i in range(4)], "text string, lang string")
    assert len(language.fit_languages(rows, most_languages=4)[0]) == 4
    with pytest.raises(ValueError, match="3 languages"):
        language.fit_languages(rows, most_languages=3)


def test_language_sample_splits_copies(spark):
    copies = spark.range(4000).selectExpr("id as doc_id", "'one text of many copies' as text", "if(id % 2 = 0, 'a', 'b') as lang")
    langs, model = language.fit_languages(copies, fit_rows=400)
    assert langs == ["a", "b"]
    grams = math.exp(model[: language.FEATURES].min() * -1)  # (occurrences + smoothing) / smoothing
    assert 100 < grams * language.SMOOTHING / len("one text of many copies") / len(language.ORDERS) < 1000


def plain_severity(text, model):
    if not model.cuts:
        return 0.0
    found = Counter()
    for word in re.findall(r"\w+", (text or "").lower()):
        for name in (f"w {word}", f"4 {word[:4]}", f"5 {word[:5]}"):
            found[xxhash.xxh32(name.encode()).intdigest() % toxicity.HASH_SPACE] += 1
    lean = sum(model.weights.get(f, 0.0) * math.log(1 + n) for f, n in found.items())
    return sum(1 / (1 + math.exp(cut - lean)) for cut in model.cuts)


def test_toxicity_against_a_plain_scorer_edge_rows_too(spark, edge_docs):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    everything = docs.select("doc_id", "text").union(edge_docs.select(F.col("doc_id") + 10_000_000, "text"))
    model = toxicity.fit_severity(everything, labels.select("doc_id", F.col("toxic").alias("grade")), levels=3)
    assert len(model.cuts) == 3 and model.weights
    rows = toxicity.severities(everything, model).collect()
    texts = sorted(((r[0], plain_severity(r[1], model)) for r in everything.collect()), key=repr)
    got = sorted(((r["doc_id"], r["severity"]) for r in rows), key=repr)
    assert [g[0] for g in got] == [t[0] for t in texts]
    assert [g[1] for g in got] == pytest.approx([t[1] for t in texts], abs=1e-9)
    base = plain_severity(None, model)
    assert all(r["severity"] == pytest.approx(base) for r in rows if r["doc_id"] in (10_000_001, 10_000_002, 10_000_003))


def test_toxicity_sample_holds_its_bound_on_repeated_ids(spark):
    docs = spark.range(6000).selectExpr("if(id < 3000, 1L, id) as doc_id", "concat('text ', id) as text")
    graded = spark.range(1, 6000).selectExpr("id as doc_id", "cast(id % 2 as int) as grade")
    n = toxicity._sample(docs, graded, 500).count()
    assert n < 700
    repeated = spark.range(5000).selectExpr("1L as doc_id", "'same' as text")
    assert toxicity._sample(repeated, graded, 500).count() <= 1
    few = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, None), (None, "c")], "doc_id long, text string")
    assert rows_of(toxicity._sample(few, graded, 10_000)) == sorted([(0, None), (1, "a"), (1, "b")], key=repr)
