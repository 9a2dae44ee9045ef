"""``corpus_pipeline.run`` against the same five stages in plain Python."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

import corpus_pipeline
from jobmargin.llm import decontaminate, mixing, queries
from tests.llm.conftest import rows_of
from tests.llm.test_simhash import plain_components, plain_fingerprint
from tests.oracle_check import connect

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def spark_hash(*values):
    """The 64-bit hash of Spark's ``xxhash64`` over integers and strings."""
    digest = 42
    for value in values:
        data = value.encode() if isinstance(value, str) else value.to_bytes(8, "little", signed=True)
        digest = xxhash.xxh64_intdigest(data, digest)
    return digest - (1 << 64) if digest >> 63 else digest


def plain_quality(sf_dir):
    sql = f"select doc_id from ({queries.QUALITY_SQL}) where kept"
    return {row[0] for row in connect(sf_dir).sql(sql).fetchall()}


def plain_near_dedup(docs):
    ids = [doc_id for doc_id, _, _ in docs]
    roots = plain_components(ids, [plain_fingerprint(text) for _, text, _ in docs], max_bits=4)
    return [doc for doc, root in zip(docs, roots) if doc[0] == root]


def plain_windows(text):
    tokens = re.findall(r"\w+", (text or "").lower().replace("_", " "))
    return [tuple(tokens[i : i + decontaminate.WINDOW]) for i in range(len(tokens) - decontaminate.WINDOW + 1)]


def plain_clean(docs, items):
    wanted = [w for w in (set(plain_windows(text)) for text in items) if len(w) >= decontaminate.LEAST_WINDOWS]
    clean = []
    for doc in docs:
        own = set(plain_windows(doc[1]))
        if all(len(own & w) < decontaminate.SHARE * len(w) for w in wanted):
            clean.append(doc)
    return clean


def plain_posteriors(docs, labelled):
    """Rows of (words, posterior of each domain)."""
    words = {doc_id: [w for w in BLANK.split((text or "").lower()) if w] for doc_id, text, _ in docs}
    counts, priors = defaultdict(Counter), Counter()
    for doc_id, _, lang in docs:
        if lang is not None and doc_id in labelled:
            priors[lang] += 1
            counts[lang].update(spark_hash(w) % mixing.FEATURES for w in words[doc_id])
    domains = sorted(lang for lang in counts if counts[lang])
    met = set().union(*(counts[d] for d in domains))
    rows = []
    for doc_id, _, _ in docs:
        known = [f for f in (spark_hash(w) % mixing.FEATURES for w in words[doc_id]) if f in met]
        weight = min(len(known), mixing.EVIDENCE) / max(len(known), 1)
        logs = []
        for d in domains:
            size = sum(counts[d].values()) + mixing.SMOOTHING * mixing.FEATURES
            lean = sum(math.log((counts[d][f] + mixing.SMOOTHING) / size) for f in known)
            logs.append(lean * weight + math.log(priors[d] / sum(priors[x] for x in domains)))
        raised = [math.exp(x - max(logs)) for x in logs]
        rows.append((len(words[doc_id]), [r / sum(raised) for r in raised]))
    return rows


def plain_rates(rows):
    k = range(len(rows[0][1]))
    own = [sum(n * p[i] for n, p in rows) for i in k]
    shares = [math.sqrt(o) / sum(math.sqrt(x) for x in own) for o in own]
    targets = [mixing.HEADROOM * max(o / s for o, s in zip(own, shares)) * s for s in shares]
    rates, moved = [1.0] * len(rows), 1.0
    for _ in range(mixing.STEPS):
        totals = [sum(x * n * p[i] for x, (n, p) in zip(rates, rows)) for i in k]
        if max(abs(t - w) / w for t, w in zip(totals, targets)) < mixing.CLOSE or moved < mixing.STILL:
            break
        slopes = [sum((totals[i] - targets[i]) / own[i] * p[i] for i in k) for _, p in rows]
        stepped = [max(1.0, x - s) for x, s in zip(rates, slopes)]
        rates, moved = stepped, max(abs(a - b) for a, b in zip(rates, stepped))
    return rates


def plain_copies(docs, labelled):
    rates = plain_rates(plain_posteriors(docs, labelled))
    placed = Counter()
    for (doc_id, text, _), rate in zip(docs, rates):
        uniform = spark_hash(doc_id, spark_hash(text or ""), "copies") % mixing.UNIFORM / mixing.UNIFORM
        data = (text or "").encode()
        placed[doc_id, len(data) + 1, zlib.crc32(data)] += math.floor(rate + uniform)
    return placed


def test_run_against_plain_python(spark, documents, sf_dir):
    source = [(r["doc_id"], r["text"], r["lang"]) for r in documents.collect()]
    good = plain_quality(sf_dir)
    kept = plain_near_dedup([doc for doc in source if doc[0] in good])
    items = [r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = plain_clean(kept, items)
    assert len(clean) < len(kept) < len(good) < len(source)  # every stage has something to do here
    labelled = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    want = plain_copies(clean, labelled)

    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    check_shards(rows)


def check_shards(rows):
    """Gapless slots, copies together, and no shard above an even share by more than the largest group."""
    slots, loads, groups, of_text = defaultdict(list), Counter(), Counter(), defaultdict(set)
    for r in rows:
        assert 0 <= r["shard"] < 8 and r["law"] == "bytes"
        slots[r["shard"]].append(r["slot"])
        loads[r["shard"]] += r["size"]
        groups[r["size"], r["text_crc32"]] += r["size"]
        of_text[r["size"], r["text_crc32"]].add(r["shard"])
    assert all(sorted(found) == list(range(len(found))) for found in slots.values())
    assert all(len(found) == 1 for found in of_text.values())
    assert not rows or max(loads.values()) <= max(1.03 * sum(loads.values()) / 8, max(groups.values()))


@pytest.mark.parametrize("empty", [False, True])
def test_run_on_edge_rows(spark, edge_docs, sf_dir, tmp_path, empty):
    docs = edge_docs.limit(0) if empty else edge_docs
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for table in ("benchmark", "labels"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path))
    rows = found.collect()
    check_shards(rows)
    # Of the edge rows only texts of at least 50 words can pass the base rules.
    long_enough = {r["doc_id"] for r in docs.collect() if len([w for w in BLANK.split(r["text"] or "") if w]) >= 50}
    assert {r["doc_id"] for r in rows} <= long_enough
    assert not empty or rows_of(found) == []
