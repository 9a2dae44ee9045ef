import pytest
from pyspark.sql import functions as F

from jobmargin.llm import mixing
from jobmargin.llm.common import stored
from tests.llm.conftest import rows_of


def soft_rows(spark):
    rows = [(i, 10 + 7 * i % 90, 0.1 + 0.8 * (i % 5) / 4) for i in range(200)]
    return spark.createDataFrame([(i, n, p, 1 - p) for i, n, p in rows], "doc long, n_words long, p0 double, p1 double")


def plain_rates(rows, targets, least, rounds):
    x, moved = [1.0] * len(rows), 1.0
    scale = [sum(n * p[k] for n, p in rows) for k in range(len(targets))]
    for _ in range(rounds):
        gaps = [(sum(x_ * n * p[k] for x_, (n, p) in zip(x, rows)) - targets[k]) / scale[k] for k in range(len(targets))]
        if max(abs(g) * s / t for g, s, t in zip(gaps, scale, targets)) < mixing.CLOSE or moved < mixing.STILL:
            break
        new = [max(least, x_ - sum(g * q for g, q in zip(gaps, p))) for x_, (_, p) in zip(x, rows)]
        x, moved = new, max(abs(a - b) for a, b in zip(x, new))
    return x


@pytest.mark.parametrize("targets, least", [((9000.0, 2000.0), 0.0), ((4000.0, 9000.0), 0.5), ((6000.0, 6000.0), 1.0)])
def test_rates_against_plain_descent(spark, targets, least):
    soft = stored(soft_rows(spark), "soft")
    got = {r["doc"]: r["rate"] for r in mixing.fit_rates(soft, targets, least).collect()}
    rows = [(r["doc"], r["n_words"], (r["p0"], r["p1"])) for r in soft.orderBy("doc").collect()]
    want = plain_rates([r[1:] for r in rows], targets, least, mixing.STEPS)
    assert [got[r[0]] for r in rows] == pytest.approx(want, abs=1e-9)
    assert min(want) >= least


def test_totals_meet_reachable_targets(spark):
    soft = stored(soft_rows(spark), "soft")
    rated = mixing.fit_rates(soft, (6000.0, 5000.0))
    totals = rated.agg(F.sum(F.expr("rate * n_words * p0")), F.sum(F.expr("rate * n_words * p1"))).first()
    assert tuple(totals) == pytest.approx((6000.0, 5000.0), rel=1e-3)


def test_documents(spark, documents, sf_dir):
    labelled = mixing.language_labels(spark, documents, sf_dir)
    found = mixing.source_mixing(documents, labelled)
    assert found.count() == documents.count()
    right = found.join(documents.select("doc_id", "lang"), "doc_id").where("domain = lang and n_words >= 20").count()
    assert right >= 0.93 * found.where("n_words >= 20").count()
    assert found.where("copies not between floor(rate) and floor(rate) + 1 or rate < 0").count() == 0
    grown = mixing.source_mixing(documents, labelled, least=1.0, grow=True)
    assert grown.where("copies < 1").count() == 0


def test_edges(spark, edge_docs, no_docs):
    labelled = spark.createDataFrame([(5, "a"), (5, "a"), (7, "b"), (None, "b"), (3, None), (99, "c")], "doc_id long, domain string")
    found = mixing.source_mixing(edge_docs, labelled)
    assert found.count() == edge_docs.select("doc_id", "text").distinct().count()
    assert found.where("membership is null or rate is null or isnan(rate)").count() == 0
    out = mixing.mixed(edge_docs, labelled, least=1.0, grow=True)
    assert out.columns == edge_docs.columns
    assert set(rows_of(out.select("doc_id", "text").distinct())) == set(rows_of(edge_docs.select("doc_id", "text").distinct()))
    assert mixing.source_mixing(no_docs, labelled).collect() == []
    assert mixing.mixed(edge_docs, labelled.limit(0), least=1.0).count() == edge_docs.count()


def test_targets_that_cannot_be_met_are_told(spark, monkeypatch, caplog):
    soft = stored(soft_rows(spark), "soft")
    with monkeypatch.context() as patch:
        patch.setattr(mixing, "STEPS", 8)
        mixing.fit_rates(soft, (1.0, 9000.0), 1.0)
    assert "after 8 steps a domain is still" in caplog.text
    # rates that have come to rest are the closest there are
    one = spark.createDataFrame([(1, 10, 1.0, 0.0), (2, 10, 0.0, 1.0)], "doc long, n_words long, p0 double, p1 double")
    got = {r["doc"]: r["rate"] for r in mixing.fit_rates(stored(one, "soft"), (5.0, 30.0), 1.0).collect()}
    assert got == {1: 1.0, 2: pytest.approx(3.0, rel=1e-3)}


def test_grown_targets_are_met(spark, documents, sf_dir):
    labelled = mixing.language_labels(spark, documents, sf_dir)
    domains, model, log_priors = mixing.fit_domains(documents, labelled)
    soft = stored(mixing.posteriors(documents, domains, model, log_priors), "soft")
    targets = mixing.word_targets(soft, domains, None, 0.5, True)
    rated = mixing.fit_rates(soft, targets, 1.0)
    got = rated.agg(*[F.sum(F.expr(f"rate * n_words * p{i}")) for i in range(len(domains))], F.min("rate")).first()
    assert tuple(got)[:-1] == pytest.approx(targets, rel=mixing.CLOSE) and got[-1] >= 1.0
