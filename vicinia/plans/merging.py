"""Queries of merging, choosing and upserting."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinia.operators import merging as m
from vicinia.plans.registry import Registry
from vicinia.sources.tables import SOURCES, candidates, establishments, load, products, views

query = Registry()

_W = "case source_type when 'merchant_added' then 6 when 'website_extracted' then 4 when 'imported' then 3 when 'rules_generated' then 2 else 1 end"
_CONF = "cast(least(0.99, max(confidence) + case when bool_or(validation_status = 'validated') then 0.03 when bool_or(validation_status = 'likely') then 0.01 else 0 end) as decimal(5,4))"
_STATUS = "case when bool_or(validation_status = 'validated') then 'validated' when bool_or(validation_status = 'likely') then 'likely' when bool_or(validation_status = 'unvalidated') then 'unvalidated' else 'rejected' end"
_MERGED = f"select establishment_id, product_id, first(source_type order by {_W} desc, confidence desc, id) as primary_source, array_to_string(list_sort(list_distinct(list(source_type))), '|') as sources, array_to_string(list_sort(list_distinct(list(generation_method))), '|') as methods, {_CONF} as confidence, {_STATUS} as validation_status, max(checked_at) as last_checked_at, count(*) as n from cand"
_MERGE = f"{_MERGED} group by establishment_id, product_id"
MERGED_WITH = f"{views('est', 'prod', 'cand')}, mrg as ({_MERGE})"
_ST = "case validation_status when 'validated' then 4 when 'likely' then 3 when 'unvalidated' then 2 when 'rejected' then 1 else 0 end"
_SR = "case {0} when 'merchant_added' then 6 when 'website_extracted' then 3 when 'imported' then 2 when 'rules_generated' then 2 when 'ai_generated' then 1 else 0 end"


def merged(spark, sf_dir, **kw):
    return m.merge_candidates(candidates(spark, sf_dir), sources=SOURCES, **kw)


def with_product(spark, sf_dir):
    p = products(spark, sf_dir).select(F.col("id").alias("product_id"), "product_group", "priority")
    return merged(spark, sf_dir).join(p, "product_id")


def _flat(df):
    return df.select("establishment_id", "product_id", "primary_source", F.array_join("merged_sources", "|").alias("sources"), F.array_join("merged_methods", "|").alias("methods"), "confidence", "validation_status", "last_checked_at", "n")


@query(f"{views('cand')} {_MERGE}")
def merge_candidates(spark, sf_dir):
    return _flat(merged(spark, sf_dir))


@query(f"{views('cand')} {_MERGED} where validation_status <> 'rejected' group by establishment_id, product_id")
def merge_candidates_scoped(spark, sf_dir):
    return _flat(merged(spark, sf_dir, exclude_rejected=True))


_ORDER = f"{_ST} desc, confidence desc, {_SR.format('primary_source')} desc, priority desc, product_id"
_RANKED = f"{MERGED_WITH}, r as (select mrg.*, product_group, priority, row_number() over (partition by establishment_id order by {_ORDER}) as store_rank, row_number() over (partition by establishment_id, product_group order by {_ORDER}) as group_rank from mrg join prod on prod.id = product_id)"


@query(f"{_RANKED} select establishment_id, product_id, store_rank from r where store_rank <= 8 and validation_status <> 'rejected'")
def merge_top_k(spark, sf_dir):
    return m.top_k(with_product(spark, sf_dir), 8).select("establishment_id", "product_id", F.col("store_rank").cast("long").alias("store_rank"))


_Q = "product_group in ('promo', 'small') and group_rank = 1 and validation_status <> 'rejected' and confidence >= 0.62 and store_rank > 8"


@query(f"{_RANKED}, q as (select *, ({_Q}) as quota from r), s as (select *, row_number() over (partition by establishment_id order by quota desc, store_rank) as selected_rank from q where store_rank <= 8 or quota) select establishment_id, product_id, quota, selected_rank from s where selected_rank <= 8 and validation_status <> 'rejected'")
def merge_top_k_quota(spark, sf_dir):
    return m.top_k(with_product(spark, sf_dir), 8, ["promo", "small"]).select("establishment_id", "product_id", "quota", F.col("selected_rank").cast("long").alias("selected_rank"))


_SP = "case source_type when 'merchant_added' then 6 when 'website_extracted' then 4 when 'imported' then 3 when 'rules_generated' then 2 else 1 end"


@query(f"{views('cand')}, r as (select *, row_number() over (partition by establishment_id, product_id order by {_SP} desc, confidence desc, checked_at desc, id desc) as rn from cand where validation_status <> 'rejected'), g as (select establishment_id, product_id, array_to_string(list_sort(list(distinct source_type)), '|') as sources, array_to_string(list_sort(list(id)), '|') as ids from r group by 1, 2) select r.establishment_id, r.product_id, id, source_type, confidence, sources, ids from r join g on g.establishment_id = r.establishment_id and g.product_id = r.product_id where rn = 1")
def merge_services(spark, sf_dir):
    """W4, G-A3."""
    show = lambda c: F.array_join(F.col(c).cast("array<string>"), "|")
    return m.service_winner(candidates(spark, sf_dir)).select("establishment_id", "product_id", "id", "source_type", "confidence", show("merged_sources").alias("sources"), show("merged_candidate_ids").alias("ids"))


@query(f"{views('cand')}, r as (select establishment_id, product_id, id, (id % 4) * 1000000 + {_ST} * 100000 + {_SR.format('source_type')} * 10000 + floor(confidence * 1000 + 0.5) as score from cand), k as (select *, row_number() over (partition by establishment_id, product_id order by score desc, id) as rn from r) select establishment_id, product_id, id, cast(score as bigint) as score from k where rn = 1")
def merge_strategy_priority(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("strategy", F.col("id") % 4).withColumn("found", F.col("id"))
    return m.strategy_merge(c).select("establishment_id", "product_id", "id", F.col("score").cast("long").alias("score"))


_OLD = "o as (select establishment_id, product_id, confidence, validation_status from mrg where product_id % 3 <> 0)"
_NEW = "n as (select establishment_id, product_id, case when product_id % 5 = 0 then cast(0.5 as decimal(5,4)) else confidence end as confidence, validation_status from mrg where product_id % 4 <> 0)"


def _old_new(spark, sf_dir):
    g = merged(spark, sf_dir).select("establishment_id", "product_id", "confidence", "validation_status")
    return g.where("product_id % 3 <> 0"), g.where("product_id % 4 <> 0").withColumn("confidence", F.expr("case when product_id % 5 = 0 then cast(0.5 as decimal(5,4)) else confidence end"))


@query(f"{MERGED_WITH}, {_OLD}, {_NEW}, j as (select coalesce(o.establishment_id, n.establishment_id) as establishment_id, coalesce(o.product_id, n.product_id) as product_id, o.confidence as oc, n.confidence as nc, o.validation_status as os, n.validation_status as ns, o.product_id is null as is_new, n.product_id is null as gone from o full join n on o.establishment_id = n.establishment_id and o.product_id = n.product_id), k as (select *, case when is_new then 'insert' when gone or os in ('validated', 'rejected') or (oc is not distinct from nc and os is not distinct from ns) then 'keep' else 'update' end as op from j) select establishment_id, product_id, case when op = 'keep' then oc else nc end as confidence, case when op = 'keep' then os else ns end as validation_status, op from k")
def upsert_guarded(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return m.upsert(old, new, ["establishment_id", "product_id"], ["confidence", "validation_status"], F.col("o_validation_status").isin("validated", "rejected"))


@query(f"{MERGED_WITH}, {_OLD}, {_NEW} select o.* from o where validation_status <> 'validated' and not exists (select 1 from n where n.establishment_id = o.establishment_id and n.product_id = o.product_id)")
def stale_delete(spark, sf_dir):
    return m.stale(*_old_new(spark, sf_dir))


@query("with o as (select o_orderkey, o_orderstatus, cast(floor(o_totalprice) as bigint) as price from orders where o_orderkey % 5 <> 0), n as (select o_orderkey, o_orderstatus, cast(floor(o_totalprice) as bigint) + case when o_orderkey % 7 = 0 then 1 else 0 end as price from orders where o_orderkey % 6 <> 0) select coalesce(o.o_orderkey, n.o_orderkey) as o_orderkey, case when o.o_orderkey is null then 'insert' when n.o_orderkey is null then 'delete' else 'update' end as action, case when o.o_orderkey is not null then concat('{\"o_orderstatus\":\"', o.o_orderstatus, '\",\"price\":', o.price, '}') end as old_row, case when n.o_orderkey is not null then concat('{\"o_orderstatus\":\"', n.o_orderstatus, '\",\"price\":', n.price, '}') end as new_row from o full join n on o.o_orderkey = n.o_orderkey where o.o_orderkey is null or n.o_orderkey is null or o.price <> n.price or o.o_orderstatus <> n.o_orderstatus")
def audit_diff(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.floor("o_totalprice").alias("price"))
    n = o.where("o_orderkey % 6 <> 0").withColumn("price", F.expr("price + case when o_orderkey % 7 = 0 then 1 else 0 end"))
    return m.audit_diff(o.where("o_orderkey % 5 <> 0"), n, "o_orderkey", ["o_orderstatus", "price"])


@query("with r as (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) select o_custkey, o_orderkey from r where rn > 3 and o_orderstatus <> 'P'")
def audit_keep_latest(spark, sf_dir):
    return m.keep_latest(load(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", 3, F.col("o_orderstatus") == "P").select("o_custkey", "o_orderkey")


@query("with r as (select p_partkey, lower(p_name) as slug, row_number() over (partition by lower(p_name) order by p_partkey) as rn from part) select p_partkey, case when rn > 1 then concat(slug, '-', cast(p_partkey as varchar)) else slug end as slug from r")
def slug_suffix(spark, sf_dir):
    return m.suffix_duplicates(load(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("slug")), "slug", "p_partkey")


@query(f"{MERGED_WITH} select establishment_id, product_id, primary_source as source_type, 'coherence_repair' as generation_method, confidence, validation_status from mrg where not exists (select 1 from cand c where c.id % 3 <> 0 and c.establishment_id = mrg.establishment_id and c.product_id = mrg.product_id)")
def coherence_repair(spark, sf_dir):
    return m.coherence_repair(merged(spark, sf_dir), candidates(spark, sf_dir).where("id % 3 <> 0"))


@query(f"{MERGED_WITH} select id, establishment_id, product_id from cand where source_type = 'rules_generated' and validation_status not in ('validated', 'rejected') and establishment_id % 2 = 0 and not exists (select 1 from mrg where mrg.product_id % 3 = 0 and cand.establishment_id = mrg.establishment_id and cand.product_id = mrg.product_id)")
def prune_nonserving(spark, sf_dir):
    return m.prune_nonserving(candidates(spark, sf_dir), merged(spark, sf_dir).where("product_id % 3 = 0"), F.col("establishment_id") % 2 == 0).select("id", "establishment_id", "product_id")


@query(f"{views('est', 'prod', 'cand')} select cand.id, 'rejected' as validation_status from cand join est on est.id = establishment_id join prod on prod.id = product_id where validation_status not in ('validated', 'rejected') and (osm_category, product_group) in (values ('beauty', 'promo'), ('kiosk', 'large'), ('mall', 'small'))")
def category_mismatch_cleanup(spark, sf_dir):
    rules = spark.createDataFrame([("beauty", "promo"), ("kiosk", "large"), ("mall", "small"), ("mall", "small")], "osm_category string, product_group string")
    c = candidates(spark, sf_dir).join(establishments(spark, sf_dir).select(F.col("id").alias("establishment_id"), "osm_category"), "establishment_id").join(products(spark, sf_dir).select(F.col("id").alias("product_id"), "product_group"), "product_id")
    return m.category_mismatch(c, rules).select("id", "validation_status")


@query(f"{views('cand')} select id, case when source_type = 'ai_generated' and generation_method = 'signal' then 'ai_inferred' else source_type end as source_type from cand")
def relabel_legacy(spark, sf_dir):
    return m.relabel_legacy(candidates(spark, sf_dir), "signal").select("id", "source_type")


_PROMOTE = "with s as (select s_suppkey as k, s_name as name, case when s_suppkey % 2 = 0 then 'w' end as website, case when s_suppkey % 3 = 0 then 'h' end as hours from supplier where s_suppkey % 4 <> 0), d as (select s_suppkey as k, s_name as name, case when s_suppkey % 5 = 0 then 'W' end as website, case when s_suppkey % 7 = 0 then 'H' end as hours, s_suppkey / 1000e0 as freshness from supplier where s_suppkey % 6 <> 0) select coalesce(s.k, d.k) as external_id, coalesce(s.website, d.website) as website, coalesce(d.hours, s.hours) as opening_hours, case when s.k is not null then 'active' else 'unknown' end as active_status, case when s.hours is not null then 0.88e0 end as hours_confidence, coalesce(d.freshness, 0.9e0) as freshness from s full join d on s.k = d.k"


@query(_PROMOTE)
def promote_stage(spark, sf_dir):
    b = load(spark, sf_dir, "supplier")
    common = [F.col("s_suppkey").alias("external_id"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("phone"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("source_url")]
    s = b.where("s_suppkey % 4 <> 0").select(*common, F.array(F.lit("a")).alias("app_categories"), F.expr("case when s_suppkey % 2 = 0 then 'w' end as website"), F.expr("case when s_suppkey % 3 = 0 then 'h' end as opening_hours"), F.lit("active").alias("active_status"))
    d = b.where("s_suppkey % 6 <> 0").select(*common, F.array().cast("array<string>").alias("app_categories"), F.expr("case when s_suppkey % 5 = 0 then 'W' end as website"), F.expr("case when s_suppkey % 7 = 0 then 'H' end as opening_hours"), F.lit("unknown").alias("active_status"), F.lit(True).alias("closed_candidate"), F.lit(None).cast("double").alias("hours_confidence"), (F.col("s_suppkey") / F.lit(1000.0)).alias("freshness"))
    return m.promote(s, d).select("external_id", "website", "opening_hours", "active_status", "hours_confidence", "freshness")


@query("select o_orderkey, case when gone then true else false end as closed_candidate, case when gone then 'unknown' else 'active' end as active_status, case when gone then 0.38e0 else 0.5e0 end as freshness from (select o_orderkey, o_orderkey % 3 <> 0 and o_orderdate < timestamp '1997-01-01' - interval 21 day as gone from orders)")
def missing_entity_decay(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("external_id"), F.col("o_orderdate").alias("last_seen_at"), F.lit(False).alias("closed_candidate"), F.lit("active").alias("active_status"), F.lit(0.5).alias("freshness"))
    return m.missing_decay(o, o.where("external_id % 3 = 0").select("external_id"), F.lit("1997-01-01").cast("timestamp_ntz")).select(F.col("external_id").alias("o_orderkey"), "closed_candidate", "active_status", "freshness")


_IMP = "with r as (select c_custkey as seq, concat('x', cast(c_custkey % 700 as varchar)) as external_id, concat('Shop ', cast(c_custkey % 500 as varchar)) as name, case when c_custkey % 2 = 0 then 'Street' else '' end as address, case when c_custkey % 3 = 0 then 'w' end as website, cast(c_custkey % 50 as double) as lat, c_mktsegment as category from customer), s as (select *, 3 + case when address <> '' then 2 else 0 end + case when website is not null then 1 else 0 end as c from r), a as (select *, row_number() over (partition by external_id order by c desc, seq) as rn from s), b as (select * exclude (rn), row_number() over (partition by lower(name), lat, category order by c desc, seq) as rn from a where rn = 1) select seq, external_id, name from b where rn = 1"


@query(_IMP)
def import_dedupe(spark, sf_dir):
    r = load(spark, sf_dir, "customer").selectExpr("c_custkey as seq", "concat('x', cast(c_custkey % 700 as string)) as external_id", "concat('Shop ', cast(c_custkey % 500 as string)) as name", "case when c_custkey % 2 = 0 then 'Street' else '' end as address", "case when c_custkey % 3 = 0 then 'w' end as website", "cast(null as string) as phone", "cast(null as string) as opening_hours", "cast(c_custkey % 50 as double) as lat", "0e0 as lon", "c_mktsegment as category")
    return m.import_dedupe(r).select("seq", "external_id", "name")


@query(f"{views('cand')} select id, case id % 10 when 0 then 'validated' when 1 then 'rejected' else validation_status end as validation_status, round(case id % 10 when 0 then greatest(cast(confidence as double), 0.7e0) when 1 then greatest(0.4e0, least(cast(confidence as double), 0.7e0)) else cast(confidence as double) end, 4) as confidence from cand where id % 10 <> 2")
def manual_decisions(spark, sf_dir):
    c = candidates(spark, sf_dir)
    d = c.where("id % 10 <= 2").selectExpr("id", "case id % 10 when 0 then 'validated' when 1 then 'rejected' else 'removed' end as action", "0.7e0 as new_confidence", "2 as at")
    d = d.unionByName(d.selectExpr("id", "'rejected' as action", "0.1e0 as new_confidence", "1 as at"))
    return m.manual_decisions(c, d).select("id", "validation_status", F.round("confidence", 4).alias("confidence"))


@query(f"{views('est')} select id, case when id % 4 = 0 then 'inactive' else active_status end as active_status, case when id % 4 = 0 then array_to_string(list_sort(list_distinct([app_category, 'pharmacy', 'zoo'])), '|') else app_category end as categories from est")
def bulk_edit(spark, sf_dir):
    e = establishments(spark, sf_dir).withColumn("app_categories", F.array("app_category"))
    return m.bulk_edit(e, e.where("id % 4 = 0"), "inactive", [" Pharmacy", "zoo"]).select("id", "active_status", F.array_join("app_categories", "|").alias("categories"))
