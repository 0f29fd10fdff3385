"""The operators over the whole tables they are meant for, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioscope.llm import decontam_prefix, hnsw_dups, langid, line_dedup, shard_shuffle, simhash_vp, sp_tokens, suffix_runs, url_filter, warc
from folioscope.llm.common import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """shares_passage: more than 50 words in a row stand in another document too; many such passages have fewer than 400 bytes."""
    out = suffix_runs.remove_repeats(_table(spark, sf_dir, "documents"), 400, words=51)
    return out.selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long) as n_spans", "kept_sha256", "shares_passage")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_shuffle.placement(_table(spark, sf_dir, "documents"), 40)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_vp.near_duplicates(_table(spark, sf_dir, "documents"), size=4, radius=4)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam_prefix.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), 10)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_dups.near_duplicates(_table(spark, sf_dir, "embeddings"), 0.98)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    return url_filter.filtered(_table(spark, sf_dir, "pages"), rules)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = cut(warc.write_archives(_table(spark, sf_dir, "pages")), "uncompressed")
    members = cut(warc.normalise(archives), "uncompressed")
    return warc.read_records(members).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_tokens.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_sharding, op3_simhash, op4_decontamination, op5_language_id, op6_embedding_dedup, op7_url_filter, op8_warc, op9_line_dedup, op10_sentencepiece)}


_OP4 = r"""
with doc as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
), item as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark
), win as (
  select item_id, least(10, len(w)) as k, list_slice(w, i, i + least(10, len(w)) - 1) as g
  from item, unnest(range(1, greatest(1, len(w) - 9) + 1)) as u(i) where len(w) > 0
), size as (select distinct k from win), gram as (
  select doc_id, i, k, list_slice(w, i, i + k - 1) as g from doc, size, unnest(range(1, len(w) - k + 2)) as u(i) where len(w) >= k
), hit as (select gram.doc_id, gram.i, gram.k, win.item_id from gram join win on gram.k = win.k and gram.g = win.g),
place as (select doc_id, count(distinct p) as n_hit from hit, unnest(range(i, i + k)) as u(p) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
select doc.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from doc left join place using (doc_id) left join named using (doc_id)
"""

_OP7 = r"""
with rules(rule_host, rule_path, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
part as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest
), fit as (
  select page_id, host, path, rule_host || rule_path as rule, v, row_number() over (partition by page_id order by length(rule_host || rule_path) desc, length(rule_host) desc) as k
  from part left join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from fit where k = 1
"""

_OP8 = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
owner as (select html, max(page_id) as owner, count(*) as n from p where strlen(html) >= 1000 group by html)
select page_id, cast(strlen(p.html) as bigint) as payload_bytes, sha1(p.html) as payload_digest,
       case when n > 1 and page_id <> owner then 'revisit' else 'response' end as record_type, case when n > 1 and page_id <> owner then owner end as refers_to
from p left join owner on p.html = owner.html
"""

_OP9 = r"""
with line as (
  select doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as a from documents), unnest(range(1, len(a) + 1)) as u(i), unnest([a[i]]) as v(l)
), owner as (select k, min(doc_id) as owner from line where length(k) >= 10 group by k),
kept as (select doc_id, i, l, owner is null or owner = doc_id as stays from line left join owner using (k))
select doc_id, count(*) as n_lines, count(*) filter (not stays) as n_dropped, sha256(coalesce(string_agg(l, chr(10) order by i) filter (stays), '')) as kept_sha256
from kept group by doc_id
"""

_OP6 = r"""
with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings where label is not null),
link as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
reach as (select vec_id, vec_id as r from v union select reach.vec_id, link.b from reach join link on reach.r = link.a)
select e.vec_id, coalesce(n, 0) as n_links, coalesce(c, e.vec_id) as component_id, coalesce(c, e.vec_id) = e.vec_id as kept
from embeddings e left join (select a, count(*) as n from link group by a) l on l.a = e.vec_id left join (select vec_id, min(r) as c from reach group by vec_id) m on m.vec_id = e.vec_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL where it expresses an operator: fingerprints, models, permutations and tokenizers have none."""
    return {"op4_decontamination": _OP4, "op6_embedding_dedup": _OP6, "op7_url_filter": _OP7, "op8_warc": _OP8, "op9_line_dedup": _OP9}
