"""The URL filter against a plain tree, and its parsing and rules against plain Python."""

import math
import random
import re

import pytest

from jobmargin.llm import url_filter as u

WILD, RULES = u.WILD, dict(u.RULES)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), path


def plain_rule(host, path, rules=RULES):
    fits = []
    for rule, verdict in rules.items():
        at = rule.index("/")
        if (host == rule[:at] or host.endswith("." + rule[:at])) and path.startswith(rule[at:]):
            fits.append((len(rule), verdict == "block", rule, verdict))
    return max(fits)[2:] if fits else (None, None)


def similar(one, two):
    if not one["labelled"] or not two["labelled"]:
        return True
    pooled = (one["bad"] + two["bad"] + 1) / (one["labelled"] + two["labelled"] + 2)
    error = math.sqrt(pooled * (1 - pooled) * (1 / one["labelled"] + 1 / two["labelled"]))
    return abs(one["bad"] / one["labelled"] - two["bad"] / two["labelled"]) <= u.SIMILAR * error


def total(rows):
    return {k: sum(r[k] for r in rows) for k in ("n", "labelled", "bad")}


def drawn(sums, parent):
    return (sums["bad"] + u.PRIOR * parent) / (sums["labelled"] + u.PRIOR)


def grow(rows, depth, node, purity, out):
    """Recursive and in memory, where the operator goes level by level."""
    size = total(rows)["n"]
    ended = [r for r in rows if len(r["segments"]) <= depth or size < u.LEAST]
    for r in ended:
        out[r["key"]] = (node + ("/" + WILD if len(r["segments"]) > depth else ""), purity)
    active = [r for r in rows if r not in ended]
    by_segment = {}
    for r in active:
        by_segment.setdefault(r["segments"][depth], []).append(r)
    branches = {}
    for segment, members in by_segment.items():
        n = total(members)["n"]
        literal = n >= u.LEAST and n >= u.SHARE * size and segment != WILD
        branches.setdefault(segment if literal else WILD, []).extend(members)
    groups = []
    for _, segment in sorted((drawn(total(m), purity), s) for s, m in branches.items()):
        sums = total(branches[segment])
        if groups and similar(total(groups[-1][1]), sums):
            groups[-1] = (groups[-1][0] + [segment], groups[-1][1] + branches[segment])
        else:
            groups.append(([segment], list(branches[segment])))
    for names, members in groups:
        names = sorted(names)
        name = names[0] if len(names) == 1 else f"({'|'.join(names[:8])}{f'|+{len(names) - 8}' if len(names) > 8 else ''})"
        grow(members, depth + 1, f"{node}/{name}", drawn(total(members), purity), out)


def brute_force(pages, marks, rules=RULES):
    rows = {}
    for url, n, labelled, bad in [(p, 1, 0, 0) for _, p in pages] + [(m, 0, 1, int(b)) for m, b in marks]:
        host, path = plain_parts(url)
        shape = re.sub("[0-9]+", "{n}", re.sub("[0-9A-Fa-f-]{16,}", "{h}", path))
        row = rows.setdefault((host, shape), {"key": (host, shape), "segments": shape.split("/")[1:], "n": 0, "labelled": 0, "bad": 0})
        row["n"], row["labelled"], row["bad"] = row["n"] + n, row["labelled"] + labelled, row["bad"] + bad
    sums, out = total(rows.values()), {}
    whole = (sums["bad"] + 1) / (sums["labelled"] + 2)
    for host in {h for h, _ in rows}:
        own = [r for r in rows.values() if r["key"][0] == host]
        grow(own, 0, "", drawn(total(own), whole), out)
    found = []
    for page_id, url in pages:
        host, path = plain_parts(url)
        shape = re.sub("[0-9]+", "{n}", re.sub("[0-9A-Fa-f-]{16,}", "{h}", path))
        template, purity = out[host, shape]
        rule, verdict = plain_rule(host, path, rules)
        found.append((page_id, host, path, rule, verdict or ("block" if purity >= u.BLOCK else "allow"), template, round(purity, 9)))
    return sorted(found, key=repr)


def result(spark, pages, marks):
    pages = spark.createDataFrame(pages, "page_id long, url string").repartition(4)
    found = u.judge(pages, spark.createDataFrame(marks, "url string, bad boolean"))
    return sorted(((*r[:6], round(r["purity"], 9)) for r in found.collect()), key=repr)


EDGES = [
    (1, None), (2, ""), (3, "no scheme/x"), (4, "http://"), (5, "HTTP://ÄB.Example.ORG/es/1"), (6, "a://b://c/d"), (6, "a://b://c/d"),
    (None, "https://org/x?y"), (7, "https://org?x=/es/"), (8, "https://neworg/x"), (9, "x://example.org/en/12"), (10, "x://example.org/en/2"),
    (11, "x://example.com/de/#f"), (12, "x://example.com/de"), (13, "x://a.com/fr/9"), (14, "x://com/fr/"), (15, "x://host/{*}/{*}"),
    (16, "x://host/" + "a/" * 400 + "0" * 5000), (17, "x://host//"), (18, "x://user:p@host:80/a\nb/c"), (19, "://h/p"),
]


def test_parts_and_rules(spark):
    assert result(spark, EDGES, []) == brute_force(EDGES, [])
    verdicts = {p: (r, v) for p, _, _, r, v, *_ in result(spark, EDGES, [])}
    assert verdicts[5] == ("example.org/es/", "block") and verdicts[9] == ("example.org/en/1", "block")
    assert verdicts[10] == ("org/", "allow") and verdicts[7][0] is None and verdicts[8][0] is None
    assert verdicts[11] == ("com/de/", "block") and verdicts[12][0] is None and verdicts[13] == ("com/fr/", "allow")


@pytest.mark.parametrize("seed", [1, 2])
def test_tree(spark, seed):
    rng = random.Random(seed)
    pages = list(EDGES)
    for i in range(1500):
        host = rng.choice(["big.net", "big.net", "big.net", "mid.net", f"h{rng.randrange(40)}.net"])
        area = rng.choice(["news", "shop", "wiki", "spam", "ads", "a b"])
        tail = rng.choice([f"{i}.html", f"{rng.getrandbits(80):020x}", f"t{''.join(rng.choices('abcxyz', k=5))}", "", "index"])
        pages.append((100 + i, f"https://{host}/{area}/{rng.choice(['x', 'y', f'u{i}z'])}/{tail}?q={i}"))
    bad = {"news": 0.05, "shop": 0.1, "wiki": 0.05, "spam": 0.95, "ads": 0.8, "a b": 0.2}
    marks = [(url, rng.random() < bad[url.split("/")[3]]) for _, url in pages[len(EDGES) :] if rng.random() < 0.4]
    marks += [("https://unseen.net/only/labelled", True), (None, False)]
    got = result(spark, pages, marks)
    assert got == brute_force(pages, marks)
    blocked = {r[5] for r in got if r[1] == "big.net" and r[4] == "block"}
    assert blocked and all("spam" in t or "ads" in t for t in blocked)
    assert any("|" in r[5] for r in got) and any(WILD in r[5] for r in got)


def test_labels_by_the_number_of_the_page(spark):
    pages = spark.createDataFrame(
        [(1, "x://h/en/7.html", "clash"), (2, "x://h/en/8/", "clash"), (3, "x://h/9?page=10", "c"), (4, "x://h/en", "c"), (5, None, "c")],
        "page_id long, url string, quality string",
    )
    labels = spark.createDataFrame([(7, 1, 0), (8, 0, 0), (9, 1, 1), (10, 0, 0), (None, 0, 0), (7, 1, None)], "doc_id long, quality int, toxic int")
    got = sorted(tuple(r) for r in u.labelled_urls(pages, labels).collect())
    assert got == [("x://h/9?page=10", True), ("x://h/en/7.html", False), ("x://h/en/8/", True)]
    assert u.url_filter(pages, labels).count() == 5


def test_no_python_in_the_plan(spark):
    pages = spark.createDataFrame(EDGES, "page_id long, url string")
    active = spark.createDataFrame([("h", "", ["a"], 5, 0, 0, 50, 0.5)], "host string, node string, rest array<string>, n long, labelled long, bad long, node_n long, purity double")
    read = pages.select("page_id", *u.parts()).withColumn("shape", u.shape()).select("*", *u.rule_columns(u.RULES))
    for df in (read, u._branches(active)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Arrow" not in text and "Pandas" not in text


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    found = u.url_filter(pages, labels)
    assert found.collect() == [] and found.columns == ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
