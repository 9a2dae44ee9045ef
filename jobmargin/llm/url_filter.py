"""URL filter: explicit host and path rules, and a tree of path templates judged by labelled purity.

Rules name a host, which covers its subdomains, and the start of a path; of those that fit the longest decides.

All other URLs are judged by their place in a tree with one root per host. Numbers and long hexadecimal runs are
placeholders from the start, so the tree is built over the distinct (host, shape) pairs with their counts, not over
URLs. It grows level by level. A segment stays literal below a node if it holds at least ``SHARE`` of the node's URLs and
``LEAST`` of them; all others become one wildcard, so no node has more than ``1 / SHARE + 1`` branches. The branches of a
node are put in order of their share of bad labels, and each joins the group before it unless a two-proportion test
tells them apart: statistically similar branches merge, with everything below them. A node's purity is its
share of bad labels, drawn to its parent's with the weight of ``PRIOR`` labels, the root's to that of the whole table.
Nodes with fewer than ``LEAST`` URLs do not branch; what is left of their paths is one wildcard. A template whose
share is at least ``BLOCK`` is rejected.

DataFrame and SQL functions only. Counts combine before they are shuffled; the state of the tree, one row per pair, and
the branches, one short map per node, are written tables, so that adaptive execution broadcasts the small one or
splits a node or host that holds a large share of the rows.

Cases: a NULL URL and one without ``://`` have empty host and path and are judged by the template of those; equal URLs
and ids are judged alike; URLs without any label take their parent's share, in the end that of the table, or one half
in a table without labels; long URLs are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from jobmargin.llm.common import stored

# The rules, by host and path, and their verdicts.
RULES: tuple[tuple[str, str], ...] = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)

SHARE = 0.02
LEAST = 20
PRIOR = 10
SIMILAR = 1.96  # standard errors
BLOCK = 0.5
WILD = "{*}"


def parts(url: str = "url") -> list[Column]:
    """``host`` and ``path`` of a URL, both empty without a scheme."""
    rest = f"if(locate('://', {url}) > 0, substring({url}, locate('://', {url}) + 3), '')"
    rest = f"coalesce({rest}, '')"
    host = f"regexp_extract({rest}, '^[^/?#]*', 0)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return [
        F.expr(f"translate({host}, '{upper}', '{lower}') as host"),
        F.expr(f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) as path"),
    ]


def rule_columns(rules: Sequence[tuple[str, str]]) -> list[Column]:
    """``rule`` and ``rule_verdict`` of the longest fitting rule, by the columns ``host`` and ``path``; block decides a tie."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, outcome in sorted(rules, key=lambda r: (len(r[0]), r[1] == "block")):
        at = text.find("/") if "/" in text else len(text)
        host, path = F.lit(text[:at]), F.lit(text[at:])
        own = (F.col("host") == host) | F.endswith(F.col("host"), F.concat(F.lit("."), host))
        fits = own & F.startswith(F.col("path"), path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(outcome)).otherwise(verdict)
    return [rule.alias("rule"), verdict.alias("rule_verdict")]


def shape() -> Column:
    """The path with placeholders for long hexadecimal runs and for numbers."""
    hexes = F.regexp_replace("path", "[0-9A-Fa-f-]{16,}", "{h}")
    return F.regexp_replace(hexes, "[0-9]+", "{n}").alias("shape")


def _merged() -> str:
    """SQL: branches, in order of their share of bad labels, folded into groups of similar ones."""
    last = "element_at(groups, -1)"
    pooled = f"(({last}.bad + b.bad + 1D) / ({last}.labelled + b.labelled + 2))"
    error = f"sqrt({pooled} * (1 - {pooled}) * (1D / {last}.labelled + 1D / b.labelled))"
    gap = f"abs(double({last}.bad) / {last}.labelled - double(b.bad) / b.labelled)"
    similar = f"({last}.labelled = 0 or b.labelled = 0 or {gap} <= {SIMILAR} * {error})"
    joined = f"""struct(concat({last}.members, array(b.segment)) as members, {last}.n + b.n as n,
        {last}.labelled + b.labelled as labelled, {last}.bad + b.bad as bad)"""
    single = "struct(array(b.segment) as members, b.n as n, b.labelled as labelled, b.bad as bad)"
    kind = "array<struct<members: array<string>, n: bigint, labelled: bigint, bad: bigint>>"
    return f"""aggregate(branches, cast(array() as {kind}), (groups, b) ->
        case when size(groups) > 0 and {similar} then concat(slice(groups, 1, size(groups) - 1), array({joined}))
             else concat(groups, array({single})) end)"""


def _group_name(members: str) -> str:
    first = f"array_join(slice(sort_array({members}), 1, 8), '|')"
    more = f"if(size({members}) > 8, concat('|+', size({members}) - 8), '')"
    return f"if(size({members}) = 1, {members}[0], concat('(', {first}, {more}, ')'))"


def _branches(active: DataFrame) -> DataFrame:
    """``host, node, moves``: for each literal segment, and the wildcard, the group it went to with its count and purity."""
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    children = active.groupBy("host", "node", F.expr("rest[0]").alias("segment")).agg(
        *sums, F.max("node_n").alias("node_n"), F.max("purity").alias("purity")
    )
    literal = f"n >= {LEAST} and n >= {SHARE} * node_n and segment <> '{WILD}'"
    kept = children.withColumn("segment", F.expr(f"if({literal}, segment, '{WILD}')"))
    kept = kept.groupBy("host", "node", "segment").agg(*sums, F.max("purity").alias("purity"))
    order = f"struct((bad + {PRIOR} * purity) / (labelled + {PRIOR}) as share, segment, n, labelled, bad)"
    grouped = kept.groupBy("host", "node").agg(
        F.sort_array(F.collect_list(F.expr(order))).alias("branches"), F.max("purity").alias("purity")
    )
    purity = f"(g.bad + {PRIOR} * purity) / (g.labelled + {PRIOR})"
    entries = f"""flatten(transform({_merged()}, g -> transform(g.members, m -> struct(m as segment,
        struct({_group_name('g.members')} as name, g.n as n, {purity} as purity) as move))))"""
    return grouped.select("host", "node", F.expr(f"map_from_entries({entries})").alias("moves"))


def templates(urls: DataFrame, marks: DataFrame) -> DataFrame:
    """``host, shape, template, purity`` for every pair of host and shape in ``urls`` (url) and ``marks`` (url, bad)."""
    seen = urls.select(*parts()).select("host", shape(), F.lit(1).alias("n"), F.lit(0).alias("labelled"), F.lit(0).alias("bad"))
    told = marks.select(*parts(), F.expr("int(bad)").alias("bad")).select(
        "host", shape(), F.lit(0).alias("n"), F.lit(1).alias("labelled"), "bad"
    )
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "bad")]
    pairs = stored(seen.union(told).groupBy("host", "shape").agg(*sums), "shapes")
    total = pairs.agg(F.sum("labelled"), F.sum("bad")).first()
    whole = ((total[1] or 0) + 1) / ((total[0] or 0) + 2)
    hosts = stored(pairs.groupBy(F.col("host").alias("root")).agg(*[F.sum(c).alias(f"host_{c}") for c in ("n", "labelled", "bad")]), "hosts")
    state = pairs.join(hosts, F.col("host") == F.col("root")).select(
        "host", "shape", "n", "labelled", "bad", F.lit("").alias("node"), F.expr("slice(split(shape, '/'), 2, length(shape) + 1)").alias("rest"),
        F.col("host_n").alias("node_n"), F.expr(f"(host_bad + {PRIOR} * {whole}D) / (host_labelled + {PRIOR})").alias("purity"),
    )
    state = stored(state, "tree")
    grows = f"size(rest) > 0 and node_n >= {LEAST}"
    while state.where(grows).limit(1).count():
        moves = stored(_branches(state.where(grows)), "branches").withColumnsRenamed({"host": "of_host", "node": "of_node"})
        joined = state.join(moves, F.expr(f"host = of_host and node = of_node and {grows}"), "left")
        move = f"coalesce(moves[rest[0]], moves['{WILD}'])"
        moved = joined.select("host", "shape", "n", "labelled", "bad", "node", "rest", "node_n", "purity", F.expr(move).alias("move"))
        state = stored(
            moved.selectExpr(
                "host", "shape", "n", "labelled", "bad", "if(move is null, node, concat(node, '/', move.name)) as node",
                "if(move is null, rest, slice(rest, 2, size(rest))) as rest", "coalesce(move.n, node_n) as node_n",
                "coalesce(move.purity, purity) as purity",
            ),
            "tree",
        )
    return state.selectExpr("host", "shape", f"if(size(rest) > 0, concat(node, '/{WILD}'), node) as template", "purity")


def judge(pages: DataFrame, marks: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` and the ``template`` and ``purity`` of every row of ``pages`` (page_id, url)."""
    found = templates(pages, marks).withColumnsRenamed({"host": "of_host", "shape": "of_shape"})
    read = pages.select("page_id", *parts()).withColumn("shape", shape())
    joined = read.join(found, F.expr("host = of_host and shape = of_shape"))
    judged = joined.select("page_id", "host", "path", *rule_columns(rules), "template", "purity")
    verdict = f"coalesce(rule_verdict, if(purity >= {BLOCK}, 'block', 'allow'))"
    return judged.selectExpr("page_id", "host", "path", "rule", f"{verdict} as verdict", "template", "purity")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """``url, bad`` of the pages whose last number is the id of a labelled document: bad if of low quality or toxic."""
    number = F.expr("try_cast(nullif(regexp_extract(path, '([0-9]+)[^0-9]*$', 1), '') as bigint)")
    numbered = pages.select("url", *parts()).select("url", number.alias("number")).where("number is not null")
    flags = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(
        F.expr("max(coalesce(quality = 0, false) or coalesce(toxic = 1, false)) as bad")
    )
    return numbered.join(flags, F.col("number") == F.col("doc_id")).select("url", "bad")


def url_filter(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The verdict on every page."""
    return judge(pages.select("page_id", "url"), stored(labelled_urls(pages, labels), "marks"))
