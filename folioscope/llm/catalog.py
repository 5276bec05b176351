"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from .bpe import round_trip as bpe_round_trip
from .common import read_table
from .exact import exact_groups
from .licenses import PHRASES, TEMPLATES, THRESHOLD, license_scan
from .packing import pack
from .private import digests, private_spans
from .quality import quality_rules
from .simhash import simhash_groups
from .substrings import repeated_strings
from .token_counts import token_counts
from .warc import round_trip as warc_round_trip


def op1_simhash(spark, sf_dir):
    return simhash_groups(read_table(spark, sf_dir, "documents"))


def op2_token_counts(spark, sf_dir):
    return token_counts(read_table(spark, sf_dir, "documents"))


def op3_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"))


def op4_bpe(spark, sf_dir):
    return bpe_round_trip(read_table(spark, sf_dir, "documents"))


def op5_quality(spark, sf_dir):
    out = quality_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_exact_dedup(spark, sf_dir):
    return exact_groups(read_table(spark, sf_dir, "documents"))


def op7_private(spark, sf_dir):
    return digests(private_spans(read_table(spark, sf_dir, "documents")))


def op8_warc(spark, sf_dir):
    return warc_round_trip(read_table(spark, sf_dir, "pages"))


def op9_substrings(spark, sf_dir):
    return repeated_strings(read_table(spark, sf_dir, "documents"))


def op10_licenses(spark, sf_dir):
    return license_scan(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_token_counts, op3_packing, op4_bpe, op5_quality, op6_exact_dedup, op7_private, op8_warc, op9_substrings, op10_licenses)}

_OP6 = r"""
with texts as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as k from documents),
grouped as (select doc_id, k, first_value(doc_id) over (partition by k order by length(t) desc, doc_id) as keep_id, count(*) over (partition by k) as group_size from texts)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(k) as text_sha256 from grouped
"""

_ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_OP10 = (
    rf"""
with texts as (select doc_id, translate(coalesce(text, ''), {_ASCII}) as low from documents),
words as (select doc_id, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w, low from texts),
paras as (select doc_id, regexp_extract_all(unnest(string_split_regex(low, '\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
templates as (
    select label, len(string_split(text, ' ')) as reach, list_distinct(string_split(text, ' ')) as t, string_split(tell, ' ') as tell, string_split(bar, ' ') as bar
    from (values {", ".join(f"('{label}', '{text}', '{tell}', '{bar}')" for label, text, tell, bar in TEMPLATES)}) x(label, text, tell, bar)
),
likely as (
    select doc_id, w, label, reach, t, tell, bar from (select distinct doc_id, w from paras) join templates
    on list_has_all(w, tell) and len(list_intersect(list_distinct(w), t)) >= ceil({THRESHOLD} * len(t) - 1e-9)
),
blocks as (select doc_id, label, t, tell, bar, unnest(list_transform(range(1, len(w) + 1), lambda i: w[i:i + reach - 1])) as b from likely),
met as (
    select doc_id, label, len(list_intersect(list_distinct(b), t)) as o, len(t) as k from blocks
    where list_has_all(b, tell) and not list_has_any(b, bar) and len(list_intersect(list_distinct(b), t)) >= ceil({THRESHOLD} * len(t) - 1e-9)
),
more as (select doc_id, list(distinct label) as l, max(o::double / k) as best from met group by doc_id),
base as (
    select doc_id, len(w) as n, """
    + ", ".join(f"list_filter(range(0, len(w)), lambda i: {' and '.join(f"w[i + {k + 1}] = '{part}'" for k, part in enumerate(p.split()))}) as p{i}" for i, (p, _) in enumerate(PHRASES))
    + """
    from words
),
named as (
    select doc_id, n, list_concat(p0, list_concat(p1, p2)) as p,
        list_filter(["""
    + ", ".join(f"case when len(p{i}) > 0 then '{label}' end" for i, (_, label) in enumerate(PHRASES))
    + """], lambda x: x is not null) as l
    from base
)
select doc_id, n::bigint as n_words, len(p)::bigint as n_base, list_min(p)::bigint as first_word, list_max(p)::bigint as last_word,
    array_to_string(list_sort(named.l), ',') as base_labels,
    array_to_string(list_sort(list_distinct(list_concat(named.l, coalesce(more.l, [])))), ',') as labels,
    case when len(named.l) > 0 then 1.0::double else coalesce(best, 0.0::double) end as score
from named left join more using (doc_id)
"""
)
ORACLE = {"op6_exact_dedup": _OP6, "op10_licenses": _OP10}
