"""Queries of the training-data operators: whole tables, production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import (ann, chat_format, decontaminate, gated_lm, hard_negatives, language_id, license_scan, line_dedup,
                            merkle, ngram_join, packing, sharding, url_filter)

SHARDS = [f"shard-{k:02d}" for k in range(48)]
TABLE_SIZE = 5003
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
#: A host is blocked where its posterior puts CONFIDENCE on more than MAX_BAD of its pages being bad.
MAX_BAD, CONFIDENCE = 0.25, 0.9


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. Python workers started from now on also look for this package where the driver
    has it; on a cluster without that path, ship it with ``--py-files``."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, env.get("PYTHONPATH")]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(modulus: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id's decimal text leaves remainder 2 (a null id: the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus == 2


def sharding_query(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id")
    return sharding.assign(docs, "doc_id", SHARDS, TABLE_SIZE).select("doc_id", "slot", "shard")


def lm_query(spark, sf):
    return gated_lm.score_documents(read(spark, sf, "documents"), held_out(7))


def decontamination_query(spark, sf):
    return decontaminate.contaminations(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def line_dedup_query(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def language_id_query(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    out = language_id.identify(docs, held_out(4))
    return out.select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")


def license_query(spark, sf):
    return license_scan.scan(read(spark, sf, "documents"))


def chat_query(spark, sf):
    probe = spark.sql("""select cast(-1 as bigint) conv_id, cast(turn as bigint) turn, role, '</s>[INST] ok [/INST]' text
                         from values (0, 'user'), (1, 'assistant') v(turn, role)""")
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = chat_format.format_conversations(rows)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                      F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                      F.length("formatted").cast("long").alias("formatted_chars"))


def packing_query(spark, sf):
    docs = read(spark, sf, "documents")
    placed = packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def ngram_join_query(spark, sf):
    return ngram_join.join_components(read(spark, sf, "documents"))


def ann_query(spark, sf):
    return ann.search(read(spark, sf, "embeddings"), F.col("id") % 20 == 0)


def merkle_query(spark, sf):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    out = merkle.audit(read(spark, sf, "documents"), {"text": F.replace("text", F.lit("\n"), F.lit(""))}, tampered)
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
                      "folded_root", "verified")


def hard_negatives_query(spark, sf):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read(spark, sf, "embeddings"), F.col("id") % 100 == 0, label)


def url_filter_query(spark, sf):
    """A page is bad where its document is labelled toxic or of low quality."""
    labels = read(spark, sf, "labels").select(F.col("doc_id").alias("id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    out = url_filter.judge(read(spark, sf, "pages"), labels, URL_RULES, MAX_BAD, CONFIDENCE)
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def pipeline_query(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding_query,
        "op2_gated_lm": lm_query,
        "op3_decontamination": decontamination_query,
        "op4_line_dedup": line_dedup_query,
        "op5_language_id": language_id_query,
        "op6_license_scan": license_query,
        "op7_chat_format": chat_query,
        "op8_packing": packing_query,
        "op9_ngram_join": ngram_join_query,
        "op10_ann": ann_query,
        "op11_merkle": merkle_query,
        "op12_hard_negatives": hard_negatives_query,
        "op13_url_filter": url_filter_query,
        "pipeline": pipeline_query,
    }


SHARDING_SQL = f"""
with recursive shards as (
  select i, 'shard-' || lpad(i::varchar, 2, '0') as shard from range({len(SHARDS)}) r(i)),
prefs as (
  select i, shard, ('0x' || substr(md5(shard || '#offset'), 1, 15))::bigint % {TABLE_SIZE} as off,
         ('0x' || substr(md5(shard || '#skip'), 1, 15))::bigint % {TABLE_SIZE - 1} + 1 as skip
  from shards),
fill as (
  select 0 as t, [0::int for x in range({TABLE_SIZE})] as free_of, -1::bigint as slot
  union all
  select t + 1, list_concat(list_concat(free_of[1:s], [1::int]), free_of[s + 2:]), s
  from (select t, free_of, list_extract(list_filter([(p.off + j * p.skip) % {TABLE_SIZE} for j in range({TABLE_SIZE})],
                lambda q: free_of[q + 1] = 0), 1) as s
        from fill join prefs p on p.i = fill.t % {len(SHARDS)} where fill.t < {TABLE_SIZE})),
owner as (select slot, shard from fill join shards on shards.i = (fill.t - 1) % {len(SHARDS)} where t > 0)
select doc_id, slot::int as slot, shard
from (select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % {TABLE_SIZE} as slot
      from documents) join owner using (slot)
"""

LINE_DEDUP_SQL = r"""
with docs as (select row_number() over () as r, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select r, unnest(ls) as line, generate_subscripts(ls, 1) as pos from docs),
keyed as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines),
gone as (select k from keyed where length(k) >= 1 group by k having count(distinct r) >= 10),
marked as (select keyed.*, gone.k is not null as drop_it from keyed left join gone on keyed.k = gone.k)
select any_value(doc_id) as doc_id, count(*)::bigint as n_lines, sum(drop_it::int)::bigint as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not drop_it), '')) as kept_sha256
from marked join docs using (r) group by r
"""

CHAT_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, regexp_matches(text, '<<SYS%?>>|<</SYS>>|\[INST%?\]|\[/INST\]|<s%?>|</s>|\[ROLE%?=[^\[\]<>]*\]|\[/ROLE\]') as esc,
         length(replace(replace(replace(text, '%', '%25'), '[', '%5B'), '<', '%3C')) as esc_len,
         case role when 'system' then 15 when 'user' then 13 when 'assistant' then 7 else 14 + length(replace(replace(replace(
           replace(replace(role, '%', '%25'), '[', '%5B'), '<', '%3C'), ']', '%5D'), '>', '%3E')) end as marks
  from rows)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(marks + case when esc then 1 + esc_len else length(text) end)::bigint as formatted_chars
from marked group by conv_id
"""


# trees by recursion over levels; a row's siblings are looked up by address, not by descent
MERKLE_SQL = r"""
with recursive rows as (
  select *, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1),
              lambda p: ascii(substr(doc_id::varchar, p, 1))::bigint)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)),
                                 lambda x, k: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) & 1 = 1 as tampered
  from documents),
fields as (
  select *, coalesce(strlen(doc_id::varchar) || ':' || doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as front
  from rows),
hashed as (
  select doc_id, source, sha256(front || coalesce(strlen(text) || ':' || text, '-')) as leaf,
         case when tampered then sha256(front || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) end as altered
  from fields),
leaves as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as r, count(*) over (partition by source) as n
  from hashed),
tree as (
  select source, 0 as level, r, n, leaf as h from leaves
  union all
  select source, level + 1, r // 3, (n + 2) // 3, sha256(string_agg(h, '' order by r)) from tree where n > 1
  group by source, level, r // 3, n),
subroots as (
  select source, h as subroot, row_number() over (order by source nulls first) - 1 as r, count(*) over () as n from tree where n = 1),
upper as (
  select 0 as level, r, n, subroot as h from subroots
  union all
  select level + 1, r // 3, (n + 2) // 3, sha256(string_agg(h, '' order by r)) from upper where n > 1 group by level, r // 3, n),
heights as (select source, max(level) as height from tree group by source),
nodes as (
  select l.doc_id, l.source, l.r as leaf_r, l.leaf, coalesce(l.altered, l.leaf) as given, s.subroot, s.r as group_r, h.height
  from leaves l join subroots s on l.source is not distinct from s.source join heights h on l.source is not distinct from h.source),
sides as (
  select x.source, x.leaf_r, t.level, string_agg(t.h, '' order by t.r) filter (where t.r < x.leaf_r // (3 ** t.level)::bigint) as before,
         string_agg(t.h, '' order by t.r) filter (where t.r > x.leaf_r // (3 ** t.level)::bigint) as after
  from nodes x join tree t on t.source is not distinct from x.source and t.n > 1
       and t.r // 3 = x.leaf_r // (3 ** (t.level + 1))::bigint
  group by all
  union all
  select x.source, x.leaf_r, x.height + t.level, string_agg(t.h, '' order by t.r) filter (where t.r < x.group_r // (3 ** t.level)::bigint),
         string_agg(t.h, '' order by t.r) filter (where t.r > x.group_r // (3 ** t.level)::bigint)
  from nodes x join upper t on t.n > 1 and t.r // 3 = x.group_r // (3 ** (t.level + 1))::bigint
  group by x.source, x.leaf_r, x.height, t.level),
folding as (
  select source, leaf_r, 0 as level, given as h from nodes
  union all
  select f.source, f.leaf_r, f.level + 1, sha256(coalesce(s.before, '') || f.h || coalesce(s.after, ''))
  from folding f join sides s on s.source is not distinct from f.source and s.leaf_r = f.leaf_r and s.level = f.level),
folded as (select source, leaf_r, arg_max(h, level) as folded_root from folding group by source, leaf_r),
proofs as (
  select source, leaf_r, sha256(string_agg(coalesce(before, '') || coalesce(after, ''), '' order by level)) as proof
  from sides group by source, leaf_r)
select x.doc_id, x.leaf, x.subroot, (select h from upper where n = 1) as root, coalesce(p.proof, sha256('')) as proof_sha256,
       f.folded_root, f.folded_root = (select h from upper where n = 1) as verified
from nodes x join folded f on f.source is not distinct from x.source and f.leaf_r = x.leaf_r
left join proofs p on p.source is not distinct from x.source and p.leaf_r = x.leaf_r
"""

HARD_NEGATIVES_SQL = """
with v as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as c
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.id as anchor_id, b.id, a.label = b.label as same, list_inner_product(a.c, b.c)::bigint as score
  from v a join v b on a.id % 100 = 0 and a.id <> b.id and len(a.c) = len(b.c)),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank,
       id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""

# the posterior's tail by the power series of the incomplete beta function (all terms positive)
URL_FILTER_SQL = f"""
with recursive parts as (
  select page_id, url, case when contains(url, '://') then substr(url, position('://' in url) + 3) else '' end as rest from pages),
urls as (
  select page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^[^/?#]*')) + 1), '^[^?#]*') as path
  from parts),
known as (select doc_id, bool_or(toxic = 1 or quality = 0) as bad from labels where doc_id is not null and (toxic = 1 or quality = 0) is not null
          group by doc_id),
hosts as (
  select host, count(known.bad) as n, count_if(known.bad) as k, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') as bare
  from urls left join known on page_id = doc_id group by host),
named as (
  select *, string_split(bare, '.') as l,
         case when regexp_matches(bare, '^[0-9.]*$') then len(string_split(bare, '.'))
              when array_to_string(list_slice(string_split(bare, '.'), -2, -1), '.') in
                   ('ac.uk', 'co.jp', 'co.nz', 'co.uk', 'com.au', 'com.br', 'gov.uk', 'org.uk') then 2 else 1 end as s from hosts),
leveled as (
  select host, n, k, array_to_string(list_slice(l, -(s + 1), -1), '.') as domain, array_to_string(list_slice(l, -s, -1), '.') as suffix from named),
overall as (select (sum(k) + 1.0) / (sum(n) + 2.0) as m from leveled),
s0 as (select suffix, sum(n) as n, sum(k) as k, any_value(m) as m from leveled, overall group by suffix),
sw as (select 1 / least(greatest(coalesce(sum((k - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5), 0.001), 0.5) - 1 as w from s0),
s1 as (select suffix, (w * m + k) / (w + n) as m from s0, sw),
d0 as (select domain, sum(n) as n, sum(k) as k, any_value(m) as m from leveled join s1 using (suffix) group by domain),
dw as (select 1 / least(greatest(coalesce(sum((k - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5), 0.001), 0.5) - 1 as w from d0),
d1 as (select domain, (w * m + k) / (w + n) as m from d0, dw),
h0 as (select host, n, k, m from leveled join d1 using (domain)),
hw as (select 1 / least(greatest(coalesce(sum((k - n * m) ** 2 - n * m * (1 - m)) / nullif(sum(n * (n - 1) * m * (1 - m)), 0), 0.5), 0.001), 0.5) - 1 as w from h0),
post as (select host, w * m + k as a, w * (1 - m) + n - k as b from h0, hw),
sides as (  -- the share below {MAX_BAD}, or mirrored the share above, whichever converges
  select host, a, b, {MAX_BAD} <= (a + 1) / (a + b + 2) as direct,
         case when {MAX_BAD} <= (a + 1) / (a + b + 2) then a else b end as p, case when {MAX_BAD} <= (a + 1) / (a + b + 2) then b else a end as q,
         case when {MAX_BAD} <= (a + 1) / (a + b + 2) then {MAX_BAD} else 1 - {MAX_BAD} end as x
  from post),
series as (
  select host, a, b, direct, p, q, x, 0 as i, 1.0::double as term, 1.0::double as total from sides
  union all
  select host, a, b, direct, p, q, x, i + 1, term * x * (p + q + i) / (p + 1 + i), total + term * x * (p + q + i) / (p + 1 + i)
  from series where i < 4000 and term > 1e-17 * total),
summed as (
  select host, direct, exp(p * ln(x) + q * ln(1 - x) + lgamma(p + q) - lgamma(p) - lgamma(q)) / p * max(total) as share
  from series group by host, direct, p, q, x),
judged as (select host, case when (case when direct then 1 - share else share end) >= {CONFIDENCE} then 'block' else 'allow' end as v from summed),
fitting as (
  select page_id, host, path, v, case
    when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
    when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
    when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
    when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from urls join judged using (host))
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' else v end as verdict
from fitting
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": SHARDING_SQL, "op4_line_dedup": LINE_DEDUP_SQL, "op7_chat_format": CHAT_SQL, "op11_merkle": MERKLE_SQL,
            "op12_hard_negatives": HARD_NEGATIVES_SQL, "op13_url_filter": URL_FILTER_SQL}
