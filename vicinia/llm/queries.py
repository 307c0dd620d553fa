"""Registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinia.llm import brown_lm, decontaminate, embed_dedup, importance, jaccard_join, line_dedup, mixing, pii, prefix_trie, quality, token_count, toxicity, url_filter
from vicinia.llm.common import load, remainder

TOKENIZER_FILE = "piece_bpe_32k.model"
#: Key of the registered PII query and pipeline stage; a real run passes its own.
PII_KEY = "registered-query-key"


def _start() -> Column:
    return F.lit("2024-01-01").cast("timestamp_ntz")


def _nibbles(text: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(F.md5(text), at, n), 16, 10).cast("long")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as captures: the table has no fetch time, so it follows from page_id (one an hour over 400 days)."""
    return load(spark, sf_dir, "pages").select("page_id", "url", (_start() + F.make_dt_interval(hours=F.pmod(F.col("page_id") * 7919, F.lit(9600)).cast("int"))).alias("fetched_at"))


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated entries about the hosts that pages name: two lists by host, one by whole URL and one of parent domains, from digests."""
    host = url_filter.host_of(F.col("url"))
    day = lambda base, at: _start() + F.make_dt_interval(days=(F.lit(base) + F.pmod(_nibbles(F.col("p"), at, 3), F.lit(180))).cast("int"))
    row = lambda name, key, action, at: F.struct(F.lit(name).alias("list"), key.alias("key"), F.lit(action).alias("action"), at.alias("at"))
    hosts = pages.select(host.alias("p")).where("p <> ''").distinct()
    pick = _nibbles(F.col("p"), 1, 2)
    key, dom = F.concat(F.lit("h:"), F.col("p")), F.concat(F.lit("d:"), F.col("p"))
    by_host = hosts.select(
        F.explode(
            F.concat(
                F.when(pick % 3 == 0, F.array(row("block_hosts", key, "add", day(0, 3)), row("block_hosts", key, "remove", day(180, 6)))).otherwise(F.array().cast("array<struct<list:string,key:string,action:string,at:timestamp_ntz>>")),
                F.when(pick % 4 == 1, F.array(row("block_domains", dom, "add", day(60, 9)))).otherwise(F.array().cast("array<struct<list:string,key:string,action:string,at:timestamp_ntz>>")),
                F.when(pick % 5 == 2, F.array(row("allow_hosts", key, "add", day(120, 12)))).otherwise(F.array().cast("array<struct<list:string,key:string,action:string,at:timestamp_ntz>>")),
            )
        ).alias("e")
    ).select("e.*")
    exact = pages.select(url_filter.exact_of(F.col("url")).alias("p")).where("p <> ''").distinct().where(pick % 16 == 3)
    by_url = exact.select(F.explode(F.array(row("block_urls", F.concat(F.lit("u:"), F.col("p")), "add", day(0, 3)), row("block_urls", F.concat(F.lit("u:"), F.col("p")), "remove", day(220, 6)))).alias("e")).select("e.*")
    return by_host.unionByName(by_url)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = captures(spark, sf_dir)
    return url_filter.filter_captures(seen, list_entries(seen))


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.class_model_scores(load(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(load(spark, sf_dir, "documents"))


def op4_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(load(spark, sf_dir, "documents").select("doc_id", "text"), quality.graded(load(spark, sf_dir, "labels")))
    return scored.select("doc_id", "held_out", "expected_grade", "p_keep", "predicted_grade", "keep")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op6_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(load(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op7_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_count.token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_FILE))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(load(spark, sf_dir, "documents"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(load(spark, sf_dir, "embeddings"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(load(spark, sf_dir, "conversations"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(load(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_ALL = (op1_url_filter, op2_brown_lm, op3_ngram_jaccard, op4_quality_ordinal, op5_decontaminate, op6_pii_feistel, op7_toxicity_gru, op8_token_counts, op9_mix_sources, op10_embedding_dedup, op11_prefix_trie, op12_importance, op13_line_dedup)
QUERIES = {f.__name__: f for f in _ALL}
_DAY = "timestamp '2024-01-01' + to_days(cast({0} + ('0x' || substr(md5(p), {1}, 3))::integer % 180 as integer))"
_PICK = "('0x' || substr(md5(p), 1, 2))::integer"
_HOST = "regexp_replace(regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '\\.$', '')"
_EXACT = f"concat({_HOST}, regexp_replace(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1), '/$', ''))"

# CRC-32 in SQL: the table of its 256 steps from the polynomial, then one step a byte of the text's hexadecimal form.
_CRC_TABLE = "crc(tab) as materialized (select list(list_reduce(list_concat([n], range(8)), lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by n) from range(256) as t(n))"
_CRC = "xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode({0}))), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::bigint)), lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295)"
_AZ = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_TRIE = f"""
with {_CRC_TABLE},
t as (select conv_id, coalesce(role, '') as role, coalesce("text", '') as "text", row_number() over (partition by conv_id order by turn nulls first, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), ':', coalesce("text", '')))) as n from conversations where conv_id is not null),
l as (select conv_id, list(struct_pack(r := role, x := "text") order by n) as turns from t group by 1),
h as (select conv_id, turns, {_CRC.format("conv_id::varchar")} % 6 as h from l, crc),
r as (select h.conv_id, list_concat(coalesce(b.turns[:h.h], []), h.turns[h.h + 1:]) as turns from h left join l b on b.conv_id = h.conv_id - h.conv_id % 100),
p as (select conv_id, d, turns[:d] as path, len(turns) = d as final from (select conv_id, turns, unnest(range(len(turns) + 1)) as d from r)),
n as (select path, d as depth, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where final), '') as ends, case when d > 0 then (count(*) - 1) * length(path[d].x) else 0 end as saved from p group by path, d),
k as (select path[:depth - 1] as path, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by 1, 2),
u as (select n.*, coalesce(n_children, 0) as n_children, n_children is null as leaf, case when n.depth > 0 then n.path[:n.depth - 1] end as up from n left join k on k.path = n.path and k.depth = n.depth),
s as (select path, depth, sum(leaf::int) as n_leaves, sum(saved) as saved_tokens from (select leaf, saved, whole[:nth] as path, nth as depth from (select leaf, saved, path as whole, unnest(range(depth + 1)) as nth from u)) group by 1, 2)
select u.conv_id, u.depth, q.conv_id as parent_conv_id, u.n_convs, u.n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, sha256(u.ends) as ends_sha256
from u join s on s.path = u.path and s.depth = u.depth left join n q on q.depth = u.depth - 1 and q.path = u.up"""

_IMPORTANCE = f"""
with {_CRC_TABLE},
d as (select row_number() over () as r, doc_id, regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
a as (select regexp_extract_all({_AZ.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
w as (select r, unnest(words) as word from d), v as (select unnest(words) as word from a),
k as (select word, {_CRC.format("word")} % 10000 as bucket from (select word from w union select word from v), crc),
c as (select range as bucket, coalesce(s, 0)::double as s, coalesce(t, 0)::double as t from range(10000) left join (select bucket as sb, count(*) as s from w join k using (word) group by 1) on sb = range left join (select bucket as tb, count(*) as t from v join k using (word) group by 1) on tb = range),
g as (select bucket, floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000))))::bigint as gain from c),
x as (select r, count(*) as n, sum(gain)::bigint as total from w join k using (word) join g using (bucket) group by 1),
f as (select d.r, doc_id, len(words) as n_features, coalesce(floor(total / n), 0)::bigint as weight, ('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8))::bigint as h from d left join x using (r)),
q as (select *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::bigint as score, n_features >= 20 as ok from f),
o as (select *, row_number() over (partition by ok order by score desc, doc_id nulls first, n_features, weight) as place, count(*) filter (where ok) over () as total from q)
select doc_id, n_features, weight, score, case when ok and place <= 10 * total // 100 then place end as rank from o"""

_LINES = f"""
with d as (select row_number() over () as r, doc_id, string_split(coalesce("text", ''), chr(10)) as ls from documents),
l as (select r, doc_id, unnest(ls) as line, unnest(range(len(ls))) as i from d),
k as (select *, {_AZ.format("regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')")} as key from l),
c as (select key, max(doc_id) as last from k where length(key) >= 20 group by 1 having count(distinct doc_id) + max(case when doc_id is null then 1 else 0 end) >= 3),
m as (select k.r, k.i, k.line, last is not null and doc_id is distinct from last as gone from k left join c on c.key = k.key)
select d.doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not gone), '')) as kept_sha256 from d join m on m.r = d.r group by d.r, d.doc_id"""

ORACLES: dict[str, str] = {
    "op11_prefix_trie": _TRIE,
    "op12_importance": _IMPORTANCE,
    "op13_line_dedup": _LINES,
    "op1_url_filter": f"""
with c as (select page_id, {_HOST} as host, {_EXACT} as ex, timestamp '2024-01-01' + to_hours(cast((page_id * 7919) % 9600 as integer)) as fetched_at from pages),
h as (select distinct host as p from c where host <> ''), u as (select distinct ex as p from c where ex <> '' and host <> ''),
e as (select 'block_hosts' as list, p, 'h' as kind, {_DAY.format(0, 3)} as a, {_DAY.format(180, 6)} as z from h where {_PICK} % 3 = 0
union all select 'block_domains', p, 'd', {_DAY.format(60, 9)}, null from h where {_PICK} % 4 = 1
union all select 'allow_hosts', p, 'h', {_DAY.format(120, 12)}, null from h where {_PICK} % 5 = 2
union all select 'block_urls', p, 'u', {_DAY.format(0, 3)}, {_DAY.format(220, 6)} from u where {_PICK} % 16 = 3),
m as (select page_id, list from c join e on a <= fetched_at and (z is null or fetched_at < z) and host <> '' and ((kind = 'h' and host = p) or (kind = 'u' and ex = p) or (kind = 'd' and (host = p or ends_with(host, concat('.', p)))))),
g as (select page_id, string_agg(distinct list, ',' order by list) as lists, count(*) as n, bool_or(list not like 'allow%') and not bool_or(list like 'allow%') as blocked from m group by 1)
select c.page_id, fetched_at, coalesce(blocked, false) as blocked, coalesce(lists, '') as lists, coalesce(n, 0) as n_matches from c left join g on g.page_id = c.page_id"""
}
