"""Registered queries of this package, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from jobmargin.llm import (
    chat_format,
    decontaminate,
    filter_audit,
    language,
    line_dedup,
    merkle,
    mixing,
    quality_rules,
    sharding,
    simhash,
    token_records,
    toxicity,
    url_filter,
)
from jobmargin.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]


def _on_documents(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(read(spark, sf_dir, "documents"))


def _source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.source_mixing(docs, mixing.language_labels(spark, docs, sf_dir))


def _on_two(operator: Callable[[DataFrame, DataFrame], DataFrame], table: str) -> Query:
    return lambda spark, sf_dir: operator(read(spark, sf_dir, "documents"), read(spark, sf_dir, table))


def _token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records.token_records(read(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


QUERIES: dict[str, Query] = {
    "op1_simhash_dedup": _on_documents(simhash.simhash_dedup),
    "op2_toxicity": _on_two(toxicity.toxicity, "labels"),
    "op3_token_records": _token_records,
    "op4_language_id": _on_documents(language.language_id),
    "op5_quality_rules": _on_documents(quality_rules.quality_rules),
    "op6_chat_format": lambda spark, sf_dir: chat_format.chat_format(read(spark, sf_dir, "conversations")),
    "op7_line_dedup": _on_documents(line_dedup.line_dedup),
    "op8_source_mixing": _source_mixing,
    "op9_sharding": _on_documents(sharding.sharding),
    "op10_decontamination": _on_two(decontaminate.decontamination, "benchmark"),
    "op11_filter_audit": _on_two(filter_audit.filter_audit, "labels"),
    "op12_url_filter": lambda spark, sf_dir: url_filter.url_filter(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels")),
    "op13_merkle_manifest": _on_documents(merkle.merkle_manifest),
    "pipeline": corpus_pipeline.run,
}

QUALITY_SQL = r"""
with texts as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
split as (
  select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as lines,
    length(regexp_replace(t, '[^\p{L}\p{M}]+', '', 'g')) as letters, length(regexp_replace(t, '\P{Lu}+', '', 'g')) as capitals
  from texts),
windows as (select r, words, unnest(range(1, len(words) - 1)) as i from split where len(words) >= 3),
repeated as (
  select r, i from (
    select r, i, count(*) over (partition by r, words[i], words[i + 1], words[i + 2]) as n from windows) where n > 1),
covered as (
  select r, count(distinct place) as n_repeat_words
  from (select r, unnest([i, i + 1, i + 2]) as place from repeated) group by r),
counted as (
  select split.*, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words
  from split left join covered using (r)),
judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    capitals > 0.4 * letters or letters < 0.5 * word_chars
      or len(list_filter(words, lambda w: not regexp_matches(w, '\p{L}'))) > 0.3 * n_words
      or len(regexp_extract_all(t, '[!?]{2,}')) > 0.2 * n_words
      or word_chars not between 2 * n_words and 15 * n_words
      or n_symbols > 0.1 * n_words or n_dup_lines > 0.5 * len(lines) as rule_failed
  from counted)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not rule_failed as kept
from judged
"""

CHAT_SQL = r"""
with turns as (
  select conv_id, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as position
  from conversations where conv_id is not null),
prefixes as (
  select conv_id, position, count(*) over (partition by conv_id) as n_turns,
    string_agg(length(role) || ':' || length(text) || ':' || role || text, '') over
      (partition by conv_id order by position) as prefix
  from turns),
logs as (
  select min(conv_id) as conv_id, position, prefix, count(*) as n_logged
  from prefixes where position = n_turns group by position, prefix),
kept as (
  select * from logs where (position, prefix) not in (select (position, prefix) from prefixes where position < n_turns))
select conv_id, any_value(kept.position)::bigint as n_turns, any_value(n_logged)::bigint as n_logged,
  string_agg('<|im_start|>' || regexp_replace(role, '<\|im_(start|end)\|>', '<| im_\1 |>', 'g') || chr(10)
    || regexp_replace(text, '<\|im_(start|end)\|>', '<| im_\1 |>', 'g') || '<|im_end|>' || chr(10), '' order by turns.position) as chat
from kept join turns using (conv_id) group by conv_id
"""

AUDIT_SQL = r"""
with texts as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t from documents),
split as (
  select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') as words,
    min(doc_id) over (partition by t) as least
  from texts),
flags as (
  select doc_id as id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic
  from labels group by doc_id),
failing as (
  select part, len(words) < 50 as a, 100 * len(list_distinct(words)) < 65 * len(words) as b,
    100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
    coalesce(least < doc_id, false) as e, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic
  from split left join flags on id = doc_id),
cells as (
  select part, (case when a then 'A' else '' end) || (case when b then 'B' else '' end) || (case when c then 'C' else '' end)
      || (case when d then 'D' else '' end) || (case when e then 'E' else '' end) as fails,
    count(*) as n, sum(good) as good, sum(toxic) as toxic
  from failing group by all),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (
  select v.x || w.x || x.x || y.x || z.x as filter_order
  from letters v join letters w on w.x <> v.x join letters x on x.x not in (v.x, w.x)
    join letters y on y.x not in (v.x, w.x, x.x) join letters z on z.x not in (v.x, w.x, x.x, y.x)),
steps as (select filter_order, unnest([1, 2, 3, 4, 5]) as step from orders),
walked as (
  select part, filter_order, step, n, good, toxic, fails, substr(filter_order, step, 1) as f,
    contains(fails, substr(filter_order, step, 1)) as hit,
    length(translate(fails, substr(filter_order, 1, step - 1), '')) < length(fails) as gone
  from steps, cells),
summed as (
  select part, filter_order, step, f, sum(case when gone or hit then 0 else n end) as kept,
    sum(case when hit and not gone then n else 0 end) as removed, sum(case when hit and gone then n else 0 end) as redundant,
    sum(case when fails = f then n else 0 end) as unique_fails, sum(case when hit and not gone then good else 0 end) as good_lost,
    sum(case when hit and not gone then toxic else 0 end) as toxic_lost
  from walked group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
  unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
  (sum(removed) over (partition by part, f))::bigint as shapley
from summed
"""

MERKLE_SQL = r"""
with recursive texts as (
  select doc_id, source, '-' as none, lang, n_chars, text,
    list_reduce(
      [4294967295::bigint] || list_transform(string_split_regex(doc_id::varchar, ''), lambda c: ord(c)::bigint),
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: xor(v >> 1, (v & 1) * 3988292384::bigint))) as crc
  from documents),
framed as (
  select doc_id, coalesce('+' || source, '') as k, coalesce(strlen(doc_id::varchar) || ':' || doc_id, none)
      || coalesce(strlen(source) || ':' || source, none) || coalesce(strlen(lang) || ':' || lang, none)
      || coalesce(strlen(n_chars::varchar) || ':' || n_chars, none) as head,
    coalesce(strlen(text) || ':' || text, none) as own,
    case when xor(crc, 4294967295) % 2 = 0 then replace(text, chr(10), '') else text end as other, none
  from texts),
leaves as (
  select doc_id, k, sha256(head || own) as h, sha256(head || coalesce(strlen(other) || ':' || other, none)) as told from framed),
placed as (
  select *, row_number() over (partition by k order by doc_id nulls first, h) - 1 as i, count(*) over (partition by k) as n
  from leaves),
nodes as (
  select 0 as level, k, i, n, h from placed
  union all
  select level + 1, k, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' order by i)) from nodes where n > 1 group by level, k, i // 3),
parts as (select k, h, row_number() over (order by k) - 1 as i, count(*) over () as n from nodes where n = 1),
tops as (
  select 0 as level, i, n, h from parts
  union all
  select level + 1, i // 3, (max(n) + 2) // 3, sha256(string_agg(h, '' order by i)) from tops where n > 1 group by level, i // 3),
steps as (
  select p.k, p.i, 0 as tree, m.level, m.i as other, m.h, (p.i // (3 ** m.level)::bigint) as own
  from placed p join nodes m on m.k = p.k and m.n > 1 and m.i // 3 = p.i // (3 ** (m.level + 1))::bigint
  union all
  select p.k, null, 1, m.level, m.i, m.h, (p.i // (3 ** m.level)::bigint)
  from parts p join tops m on m.n > 1 and m.i // 3 = p.i // (3 ** (m.level + 1))::bigint),
paths as (
  select k, i, tree, level, coalesce(string_agg(h, '' order by other) filter (where other < own), '') as before,
    coalesce(string_agg(h, '' order by other) filter (where other > own), '') as after
  from steps group by k, i, tree, level),
joined as (
  select p.k, p.i, list(before || '|' || after order by tree, level) as path, string_agg(before || after, '' order by tree, level) as proof
  from placed p join paths s on s.k = p.k and (s.i = p.i or s.i is null) group by p.k, p.i),
folded as (
  select p.*, s.h as subroot, (select h from tops where n = 1) as root, sha256(coalesce(proof, '')) as proof_sha256,
    list_reduce([told] || coalesce(path, []),
      lambda node, step: sha256(split_part(step, '|', 1) || node || split_part(step, '|', 2))) as folded_root
  from placed p join parts s on s.k = p.k left join joined j on j.k = p.k and j.i = p.i)
select doc_id, h as leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified from folded
"""

# The other operators hash, learn, encode or pack beyond SQL; tests/llm checks them against plain Python.
ORACLES: dict[str, str] = {"op5_quality_rules": QUALITY_SQL, "op6_chat_format": CHAT_SQL, "op11_filter_audit": AUDIT_SQL, "op13_merkle_manifest": MERKLE_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
