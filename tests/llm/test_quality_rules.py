import re
from collections import Counter

from jobmargin.llm import quality_rules as q
from tests.llm.conftest import rows_of


def plain(doc_id, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return (
        doc_id, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(covered), failed,
    )


BASE = ("doc_id", *q.BASE, "base_failed")


def test_base_statistics(documents, edge_docs):
    for docs in (documents, edge_docs):
        want = sorted((plain(*r) for r in docs.select("doc_id", "text").collect()), key=repr)
        assert rows_of(q.quality_rules(docs), *BASE) == want


def test_order_does_not_change_the_verdict(documents):
    kept = [
        rows_of(q.judge(documents, rules).where("llm__failed_rule is null"), "doc_id")
        for rules in (q.RULES, q.RULES[::-1], q.ordered_rules(documents, one_in=1))
    ]
    assert kept[0] == kept[1] == kept[2]
    assert kept[0]


def test_rules_are_ordered_by_rejections_per_cost(spark):
    text = " ".join(f"good{i}" for i in range(60))
    docs = spark.createDataFrame([(i, text + (" ####" * 20 if i < 3 else "")) for i in range(10)], "doc_id long, text string")
    rules = q.ordered_rules(docs, one_in=1)
    assert rules[0].name == "symbols"


def test_labelled_documents(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    good = q.quality_rules(documents).join(labels, "doc_id").where("n_words >= 50")
    assert good.where("not kept").count() <= 0.01 * good.count()


def test_own_columns_and_empty_table(edge_docs, no_docs):
    kept = q.keep_good(edge_docs)
    assert kept.columns == edge_docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= {None, 5, 6}
    assert q.quality_rules(no_docs).collect() == []
    assert q.keep_good(no_docs).collect() == []


def test_prose_with_vowel_signs_is_kept(spark):
    words = "में किताबें मिलीं थीं ने किनारे उन्हें हिन्दी से".split()
    text = " ".join(words[i % 9] + words[i % 7] for i in range(63))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r) for r in q.quality_rules(docs).select("base_failed", "kept").collect()] == [(False, True)]
