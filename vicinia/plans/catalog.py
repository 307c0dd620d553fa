"""Queries of catalogue maintenance, ingestion and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinia.operators import catalog as k
from vicinia.operators import search as s
from vicinia.operators import seeding as sd
from vicinia.operators.candidates import alias_bootstrap
from vicinia.plans.analytics import _RULES, _rules
from vicinia.plans.merging import _CONF, _ORDER, _Q, _STATUS, _W, MERGED_WITH, merged
from vicinia.plans.registry import Registry
from vicinia.plans.search import SERVING_WITH
from vicinia.plans.text_geo import NORM
from vicinia.sources import osm
from vicinia.sources.tables import candidates, establishments, load, products, views

query = Registry()


@query(f"{views('prod')} select id, array_to_string(list_sort(list_distinct([normalized_name, alias, lower(trim(brand))])), '|') as aliases from prod")
def catalog_assembly(spark, sf_dir):
    p = products(spark, sf_dir)
    return k.assemble(p.drop("alias"), alias_bootstrap(p)).select("id", F.array_join("aliases", "|").alias("aliases"))


@query(f"{MERGED_WITH}, r as (select * from mrg where establishment_id = 7 and validation_status <> 'rejected' order by confidence desc, product_id limit 120) select 7 as id, string_agg(concat(product_id, ':', normalized_name), '|' order by confidence desc, product_id) as products from r join prod on prod.id = product_id")
def establishment_detail(spark, sf_dir):
    p = products(spark, sf_dir)
    d = k.establishment_detail(establishments(spark, sf_dir), merged(spark, sf_dir), p, alias_bootstrap(p), 7)
    return d.select("id", F.array_join(F.transform("products", lambda x: F.concat(x["product_id"].cast("string"), F.lit(":"), x["normalized_name"])), "|").alias("products"))


@query(f"{views('est')} select id, 'establishment_edited' as event_type from est where id % 5 = 0 and name <> 'Kiosk 4' union all select id, 'category_set' from est where id % 10 = 0 and app_category <> 'groceries'")
def manual_edit_events(spark, sf_dir):
    e = establishments(spark, sf_dir).select("id", "name", F.array("app_category").alias("app_categories"))
    new = e.where("id % 5 = 0").select("id", F.when(F.col("name") == "Kiosk 4", F.col("name")).otherwise(F.concat("name", F.lit("!"))).alias("name"), F.when(F.col("id") % 10 == 0, F.array(F.lit("groceries"))).otherwise(F.col("app_categories")).alias("app_categories"), F.lit("x").alias("secret"))
    return k.edit(e, new, ["name", "app_categories"])[1].select("id", "event_type")


@query("select p_partkey as product_id, p_name as alias, case when p_partkey % 2 = 0 then 5 else 1 end as priority, p_partkey % 2 = 0 or p_partkey % 3 <> 0 as active from part union all select p_partkey, concat(p_name, '2'), 5, true from part where p_partkey % 7 = 0")
def alias_upsert(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    old = p.select(F.col("p_partkey").alias("product_id"), F.lit("en").alias("lang"), F.col("p_name").alias("alias"), F.lit(1).alias("priority"), (F.col("p_partkey") % 3 != 0).alias("active"))
    new = old.where("product_id % 2 = 0").withColumn("alias", F.upper("alias")).withColumn("priority", F.lit(5)).unionByName(old.where("product_id % 7 = 0").withColumn("alias", F.concat("alias", F.lit("2"))).withColumn("priority", F.lit(5)))
    return k.alias_upsert(old, new).select("product_id", "alias", "priority", "active")


@query("select p_partkey, coalesce(case when p_partkey % 2 = 0 then p_brand end, lower(p_type)) as group_key, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as family_slug from part")
def sync_groups(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("normalized_name"), F.lower("p_type").alias("product_group"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("group_key"), F.lit(None).cast("string").alias("family_slug"))
    return k.sync_groups(p).select("p_partkey", "group_key", "family_slug")


@query("select r as run_id, items, failed, case when items is null then 'empty' when failed = items then 'failed' else 'done' end as status from range(0, 50) t(r) left join (select user_id % 50 as run_id, count(*) as items, count(*) filter (where event_type = 'error') as failed from events where user_id % 50 < 40 group by 1) on run_id = r")
def run_tracking(spark, sf_dir):
    i = load(spark, sf_dir, "events").where("user_id % 50 < 40").select((F.col("user_id") % 50).alias("run_id"), F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"), F.col("value").alias("cost"))
    return k.finish_runs(spark.range(50).select(F.col("id").alias("run_id")), i).select("run_id", "items", "failed", "status")


@query(f"{views('est')} select id, trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') as slug, round(least(0.99e0, greatest(0.05e0, 1e0 - least(0.58e0, 0.010e0 * seen_days) - least(0.23e0, 0.004e0 * import_days) - least(0.15e0, 0.0025e0 * coalesce(enrich_days, 365)) - case when closed_candidate then 0.18e0 else 0e0 end - case active_status when 'temporarily_closed' then 0.12e0 when 'inactive' then 0.28e0 else 0e0 end)), 4) as freshness from est")
def sql_functions(spark, sf_dir):
    k.register_functions(spark)
    return establishments(spark, sf_dir).selectExpr("id", "canonical_slugify(name) as slug", "compute_freshness(seen_days, import_days, enrich_days, closed_candidate, active_status) as freshness")


@query(f"{views('est')} select id, concat('https://www.google.com/maps/dir/?api=1&destination=', id, ',', id + 1) as url, concat('Hi ', name, '!') as greeting, case when id % 2 = 0 then 'validated' when confidence >= 0.66 then 'likely' else 'unvalidated' end as shown from (select *, (id % 100) / 100e0 as confidence from est)")
def display_projection(spark, sf_dir):
    from vicinia.functions.scores import display_status

    e = establishments(spark, sf_dir)
    return e.select("id", k.directions_url(F.col("id"), F.col("id") + 1).alias("url"), k.fill_template(F.lit("Hi {name}!"), {"name": F.col("name")}).alias("greeting"), display_status(F.when(F.col("id") % 2 == 0, "validated"), (F.col("id") % 100) / 100).alias("shown"))


@query("select p_partkey as product_id, s_suppkey as establishment_id, max(c) as confidence from (select p_partkey, s_suppkey, case when lower(p_type) = 'promo' and s_suppkey % 5 = 0 then 0.7e0 end as c from part, supplier union all select p_partkey, s_suppkey, case when lower(p_name) = 'blue bolt' and s_suppkey % 5 in (0, 2) then 0.9e0 end from part, supplier) where c is not null group by 1, 2")
def seed_pairs(spark, sf_dir):
    r = spark.createDataFrame([("groceries", "group", "promo", 0.7), ("groceries", "name", "blue bolt", 0.9), ("electronics", "name", "blue bolt", 0.9)], "category string, kind string, value string, confidence double")
    return k.seed_pairs(establishments(spark, sf_dir), products(spark, sf_dir), r)


@query("select o_orderkey from orders where o_orderkey % 6 = 0 or o_orderdate < timestamp '1997-01-01' - interval 30 day")
def staleness(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.expr("case when o_orderkey % 6 = 0 then null else o_orderdate end").alias("at"))
    return k.stale(o, "at", 30, F.lit("1997-01-01").cast("timestamp_ntz")).select("o_orderkey")


_ADDR = "case when c_custkey % 3 = 0 then concat_ws(', ', 'Main St 5', case when c_custkey % 2 = 0 then '10115' end, 'Berlin') else concat_ws(', ', case when c_custkey % 5 <> 0 then c_mktsegment end, 'Berlin') end"


@query(f"select c_custkey, {_ADDR} as address, case when c_mktsegment = 'BUILDING' then 'building' when c_mktsegment = 'MACHINERY' then 'machine' end as district from customer")
def address_and_district(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    a = osm.address(F.expr("case when c_custkey % 3 = 0 then 'Main St' end"), F.lit("5"), F.expr("case when c_custkey % 2 = 0 then '10115' else ' ' end"), F.lit("Berlin"), F.expr("case when c_custkey % 5 <> 0 then c_mktsegment end"))
    return c.select("c_custkey", a.alias("address"), osm.district_of(F.col("c_mktsegment"), ["building", "machine"]).alias("district"))


@query("select concat('node/', s_suppkey) as external_id, case when s_suppkey % 4 = 0 then 'second_hand' else 'bakery' end as category from supplier where s_suppkey % 3 <> 0 and s_suppkey % 5 <> 0")
def osm_projection(spark, sf_dir):
    sup = load(spark, sf_dir, "supplier")
    tags = F.create_map(F.lit("name"), F.expr("case when s_suppkey % 3 = 0 then ' ' else s_name end"), F.lit("shop"), F.lit("bakery"), F.lit("second_hand"), F.expr("case when s_suppkey % 4 = 0 then 'only' else 'no' end"))
    e = sup.select(F.lit("node").alias("type"), F.col("s_suppkey").alias("id"), F.expr("case when s_suppkey % 2 = 0 then 52.5e0 end").alias("lat"), F.expr("case when s_suppkey % 2 = 0 then 13.4e0 end").alias("lon"), F.when(F.col("s_suppkey") % 5 != 0, F.struct(F.lit(52.4).alias("lat"), F.lit(13.3).alias("lon"))).alias("center"), tags.alias("tags"))
    e = e.withColumn("lat", F.expr("case when id % 5 = 0 then null else lat end"))
    return osm.project(e, ["bakery", "second_hand"]).select("external_id", "category")


@query("select s_suppkey as store_id, p_partkey as product_id from supplier, part")
def store_product_template(spark, sf_dir):
    return osm.template(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")), products(spark, sf_dir).select("id")).select("store_id", "product_id")


@query(f"{views('cand')} select id from cand order by md5(concat('7:', id)), id limit 25")
def seeded_sample(spark, sf_dir):
    return k.sample_rows(candidates(spark, sf_dir), 25, 7).select("id")


@query("select cast(ts as date) as day, count(*) as n, count(*) filter (where event_type = 'error') as failed from events group by 1")
def daily_window_stream(spark, sf_dir):
    """R3 as a stream over the folder's events, run until nothing is left; each batch writes the complete days anew."""
    from vicinia.sources import scratch
    from vicinia.streaming import events as st

    batch = load(spark, sf_dir, "events")
    src = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)
    e = src.select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("results"))
    root = scratch.new(spark, "daily-window")
    days = st.daily(e, "ts").writeStream.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{root}/days"))
    days.option("checkpointLocation", f"{root}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{root}/days")


@query("select p_partkey as product_id, p_name as alias from part where not (p_partkey % 5 = 0 or p_partkey % 3 = 0)")
def visible_rows(spark, sf_dir):
    """switched-off and rejected rows are not shown; a null switch counts as on."""
    a = load(spark, sf_dir, "part").selectExpr("p_partkey as product_id", "p_name as alias", "case when p_partkey % 5 = 0 then false when p_partkey % 2 = 0 then true end as is_active", "case when p_partkey % 3 = 0 then 'rejected' when p_partkey % 2 = 0 then 'likely' end as validation_status")
    return k.visible(a).select("product_id", "alias")


@query(f"{views('est')} select id, case when id % 3 = 0 then app_category when id % 4 <> 0 then osm_category else 'Other' end as label from est")
def category_label(spark, sf_dir):
    """P8."""
    e = establishments(spark, sf_dir)
    return e.select("id", k.category_label(F.when(F.col("id") % 3 == 0, F.array("app_category", "app_category2")).otherwise(F.array().cast("array<string>")), F.when(F.col("id") % 4 != 0, F.col("osm_category")), "Other").alias("label"))


_OWN = "source_type = 'rules_generated' and generation_method = 'district_refresh'"
_PAIR = "{0}.establishment_id = {1}.establishment_id and {0}.product_id = {1}.product_id"
REFRESH_WITH = f"""{MERGED_WITH}, {_RULES}, cx as (select id, establishment_id, product_id, source_type, case when source_type = 'rules_generated' and id % 2 = 0 then 'district_refresh' else generation_method end as generation_method, confidence, validation_status from cand),
cu as (select * from cx where id in (select min(id) from cx group by establishment_id, product_id, source_type, generation_method)),
de as (select * from est where district ilike '%a%' and active_status in ('active', 'temporarily_closed')), mine as (select cu.* from cu join de on de.id = establishment_id),
lk as (select distinct establishment_id, product_id from mine where {_OWN} and validation_status in ('validated', 'rejected')), ec as (select id as establishment_id, app_category from de union select id, app_category2 from de),
mk as (select establishment_id, p.id as product_id, cast(max(greatest(0.3, least(0.99, base_confidence + case when app_category in ('supermarket', 'pharmacy') then 0.04 else 0 end))) as decimal(5,4)) as confidence from ec join r using (app_category) join prod p on p.product_group = r.product_group group by 1, 2),
nw as (select * from mk where not exists (select 1 from lk where {_PAIR.format('lk', 'mk')})),
af as (select establishment_id, product_id, source_type, confidence, validation_status from mine where not ({_OWN}) or not exists (select 1 from nw where {_PAIR.format('nw', 'mine')}) union all select establishment_id, product_id, 'rules_generated', confidence, case when confidence >= 0.74 then 'likely' else 'unvalidated' end from nw),
m2 as (select establishment_id, product_id, first(source_type order by {_W} desc, confidence desc) as primary_source, {_CONF} as confidence, {_STATUS} as validation_status from af where validation_status <> 'rejected' group by 1, 2),
rk as (select m2.*, product_group, priority, row_number() over (partition by establishment_id order by {_ORDER}) as store_rank, row_number() over (partition by establishment_id, product_group order by {_ORDER}) as group_rank from m2 join prod on prod.id = product_id),
qu as (select *, ({_Q}) as quota from rk), sl as (select *, row_number() over (partition by establishment_id order by quota desc, store_rank) as selected_rank from qu where store_rank <= 8 or quota),
bs as (select establishment_id, product_id, confidence, validation_status from sl where selected_rank <= 8), sa as (select mrg.establishment_id, product_id, mrg.confidence, mrg.validation_status from mrg join de on de.id = mrg.establishment_id where mrg.validation_status = 'validated'),
pt as (select * from bs where validation_status = 'validated' or not exists (select 1 from sa where {_PAIR.format('sa', 'bs')})), done as (select * from pt union all select * from sa where not exists (select 1 from pt where {_PAIR.format('pt', 'sa')}))"""


@query(f"{REFRESH_WITH} select establishment_id, product_id, confidence, validation_status from done")
def district_refresh(spark, sf_dir):
    """K12 for districts with "a" in their name: locked pairs, clamp, merge, best rows, and validated rows that stay."""
    from vicinia.operators.refresh import district_refresh as refresh

    x = candidates(spark, sf_dir).withColumn("generation_method", F.expr("case when source_type = 'rules_generated' and id % 2 = 0 then 'district_refresh' else generation_method end"))
    e = establishments(spark, sf_dir).withColumn("app_categories", F.array("app_category", "app_category2"))
    # Of a pair, source and method there is one row.
    x = x.join(x.groupBy("establishment_id", "product_id", "source_type", "generation_method").agg(F.min("id").alias("id")).select("id"), "id", "left_semi")
    return refresh("a", e, _rules(spark), products(spark, sf_dir), x, merged(spark, sf_dir), 8, ["promo", "small"])[1]


_NAMES = "case p_partkey % 3 when 0 then translate(p_name, 'aou', 'äöü') when 1 then upper(p_name) else p_name end"


@query(f"select row_number() over (order by name collate de, name) as n, name from (select distinct {_NAMES} as name from part)")
def locale_order(spark, sf_dir):
    """The catalogue's names in German order, numbered in that order."""
    from vicinia.operators.ordering import numbered

    names = load(spark, sf_dir, "part").selectExpr(f"{_NAMES} as name").distinct()
    return numbered(names, k.locale_keys("name")).select("n", "name")


_SEEDS = {
    "product_id": "p_partkey",
    "group_key": "lower(p_type)",
    "normalized_name": "lower(p_name)",
    "display_name_en": "p_name",
    "display_name_de": "case when p_partkey % 3 = 0 then upper(p_name) end",
    "display_name_es": "case when p_partkey % 4 = 0 then concat(p_name, ' es') end",
}


def _seeds(spark, sf_dir):
    entry = "named_struct('lang', {0}, 'term', {1}, 'priority', cast({2} as double), 'is_active', {3})"
    more = {
        "synonyms": "split(p_name, ' ')",
        "aliases": f"array({entry.format(chr(39) + 'DE' + chr(39), 'p_brand', 'p_size * 3.0', 'p_size % 2 = 0')}, {entry.format('null', 'lower(p_brand)', 'null', 'null')})",
        "facets": "array(p_brand, upper(p_type), ' ')",
        "use_cases": f"case when p_partkey % 2 = 0 then array({entry.format('null', 'p_container', 'null', 'null')}, {entry.format(chr(39) + 'en' + chr(39), 'lower(p_container)', '-5', 'false')}) end",
    }
    p = load(spark, sf_dir, "part").withColumn("p_container", F.expr("concat('for ', p_type)"))
    return p.selectExpr(*[f"{e} as {n}" for n, e in (_SEEDS | more).items()], "p_size as priority")


_SEED_ROWS = "select p_partkey as product_id, 'und' as lang, lower(p_name) as alias, 100 as priority, true as is_active, 0 as pos from part union all select p_partkey, 'en', p_name, 90, true, 1 from part union all select p_partkey, 'de', upper(p_name), 90, true, 2 from part where p_partkey % 3 = 0 union all select p_partkey, 'es', concat(p_name, ' es'), 90, true, 3 from part where p_partkey % 4 = 0 union all select p_partkey, 'und', w, 75, true, 4 + i from (select p_partkey, unnest(string_split(p_name, ' ')) as w, unnest(range(len(string_split(p_name, ' ')))) as i from part) union all select p_partkey, 'de', p_brand, least(100, floor(p_size * 3.0 + 0.5)), p_size % 2 = 0, 50 from part union all select p_partkey, 'und', lower(p_brand), 70, true, 51 from part"
_SEED_ALIAS = f"sa as (select product_id, lang, alias, cast(priority as integer) as priority, is_active from (select *, row_number() over (partition by product_id, lang, lower(alias) order by pos) as rn from ({_SEED_ROWS})) where rn = 1)"
_SEED_FACET = "sf as (select distinct product_id, facet from (select p_partkey as product_id, unnest([lower(p_type), lower(p_brand)]) as facet from part))"
_SEED_USE = "su as (select p_partkey as product_id, 'und' as lang, concat('for ', p_type) as use_case, 65 as priority, true as is_active from part where p_partkey % 2 = 0 union all select p_partkey, 'en', concat('for ', lower(p_type)), 0, false from part where p_partkey % 2 = 0)"


@query(f"with {_SEED_ALIAS}, {_SEED_FACET}, {_SEED_USE} select 'alias' as kind, product_id, lang, alias as value, priority, is_active from sa union all select 'facet', product_id, null, facet, null, null from sf union all select 'use_case', product_id, lang, use_case, priority, is_active from su")
def seed_children(spark, sf_dir):
    """Aliases, facets and use cases of the whole catalogue."""
    x = _seeds(spark, sf_dir)
    row = lambda df, kind, value, own: df.select(F.lit(kind).alias("kind"), "product_id", F.col("lang") if own else F.lit(None).cast("string").alias("lang"), F.col(value).alias("value"), F.col("priority") if own else F.lit(None).cast("int").alias("priority"), F.col("is_active") if own else F.lit(None).cast("boolean").alias("is_active"))
    return row(sd.seed_aliases(x), "alias", "alias", True).unionByName(row(sd.seed_facets(x), "facet", "facet", False)).unionByName(row(sd.seed_use_cases(x), "use_case", "use_case", True))


_SAMPLE = "{0} as (select product_id, array_to_string(list(v order by rn), '|') as {0}, count(*) as {0}_count from (select product_id, v, row_number() over (partition by product_id order by p desc, v) as rn from (select product_id, {2} as v, max({3}) as p from {1} group by 1, 2)) where rn <= {4} group by 1)"


@query(
    f"{MERGED_WITH}, {_SEED_ALIAS}, {_SEED_FACET}, {_SEED_USE}, {_SAMPLE.format('aliases', 'sa', 'alias', 'priority', 8)}, {_SAMPLE.format('facets', 'sf', 'facet', '0', 6)}, {_SAMPLE.format('use_cases', 'su', 'use_case', 'priority', 5)}, st as (select product_id, count(*) as store_count from mrg where validation_status <> 'rejected' group by 1), "
    "f as (select prod.id as product_id, product_group as \"group\", priority, normalized_name, coalesce(store_count, 0) as store_count, coalesce(aliases, '') as aliases, coalesce(aliases_count, 0) as aliases_count, coalesce(facets, '') as facets, coalesce(use_cases, '') as use_cases from prod left join st on st.product_id = prod.id left join aliases a on a.product_id = prod.id left join facets c on c.product_id = prod.id left join use_cases u on u.product_id = prod.id) "
    "select product_id, \"group\", store_count, aliases, aliases_count, facets, use_cases from f order by priority desc, store_count desc, aliases_count desc, normalized_name, product_id limit 320"
)
def family_connections(spark, sf_dir):
    """G-A12: samples of aliases, facets and use cases."""
    x = _seeds(spark, sf_dir)
    rows = sd.family_connections(x.select("product_id", "group_key", F.col("group_key").alias("product_group"), "normalized_name", "priority"), sd.seed_aliases(x), sd.seed_facets(x), sd.seed_use_cases(x), merged(spark, sf_dir).where("validation_status <> 'rejected'"))
    show = lambda c: F.array_join(c, "|").alias(c)
    return rows.select("product_id", "group", "store_count", show("aliases"), "aliases_count", show("facets"), show("use_cases"))


@query(
    f"with v as (select lower(p_type) as grp, concat(p_name, case when p_partkey % 5 = 0 then '!' else '' end) as term, {NORM.format('p_name')} as n from part union all select 'nothing', null, null union all select 'blank', '?!', ''), t as (select p_name as wrong, case p_partkey % 4 when 0 then p_name when 1 then concat(p_name, 's') when 2 then '' else string_split(p_name, ' ')[1] end as \"right\" from part), tn as (select *, {NORM.format('wrong')} as w, {NORM.format(chr(34) + 'right' + chr(34))} as r from t), "
    "k as (select n as x from v union select unnest(string_split(n, ' ')) from v union select 'misc'), "
    "z as (select 'group_without_terms' as issue, 'error' as severity, grp as subject, null as detail from v group by grp having count(term) = 0 union all select 'empty_term', 'error', grp, term from v where term is not null and n = '' union all select 'duplicate_term', 'error', n, grp from v where n <> '' group by grp, n having count(*) > 1 union all select 'term_in_several_groups', 'warning', n, array_to_string(list_sort(list(distinct grp)), '|') from v where n <> '' group by n having count(distinct grp) > 1 "
    "union all select 'empty_typo', 'error', wrong, \"right\" from tn where w = '' or r = '' union all select 'typo_of_itself', 'warning', w, r from tn where w <> '' and w = r union all select 'unknown_typo_target', 'error', w, r from tn where w <> '' and r <> '' and r not in (select x from k where x is not null)) select issue, severity, subject, detail from z"
)
def vocabulary_lint(spark, sf_dir):
    """G-A24: all that is wrong with a vocabulary of the whole catalogue and with its corrections."""
    p = load(spark, sf_dir, "part")
    v = p.select(F.lower("p_type").alias("group"), F.expr("concat(p_name, case when p_partkey % 5 = 0 then '!' else '' end)").alias("term"))
    v = v.unionByName(spark.createDataFrame([("nothing", None), ("blank", "?!")], "group string, term string"))
    t = p.select(F.col("p_name").alias("wrong"), F.expr("case p_partkey % 4 when 0 then p_name when 1 then concat(p_name, 's') when 2 then '' else split(p_name, ' ')[0] end").alias("right"))
    return sd.vocabulary_lint(v, ["misc"], [], t)


@query(f"""{SERVING_WITH}, j as (select establishment_id, concat('[', string_agg(concat('{{"product_id":', product_id, ',"normalized_name":"', normalized_name, '","confidence":', confidence, ',"website":', coalesce('"' || website || '"', 'null'), '}}'), ',' order by confidence desc, normalized_name, product_id), ']') as products from srv where product_group <> 'promo' and confidence >= 0.9 group by 1) select id as establishment_id, coalesce(products, '[]') as products from est left join j on j.establishment_id = id""")
def products_json(spark, sf_dir):
    """G-A17: the surest products of each establishment as a JSON array, [] where there is none."""
    v = s.serving(merged(spark, sf_dir), establishments(spark, sf_dir), products(spark, sf_dir)).where("product_group <> 'promo' and confidence >= 0.9")
    e = establishments(spark, sf_dir).select(F.col("id").alias("establishment_id"))
    return k.products_json(e, v, ["product_id", "normalized_name", "confidence", "website"], [-F.col("confidence"), F.col("normalized_name"), F.col("product_id")])


@query(f"{SERVING_WITH} select concat('candidate_', establishment_id, '_', product_id, '_', primary_source) as offer_id, cast(confidence as double) as confidence, name as store_name, coalesce(website, 'https://source.example') as website, case when product_id % 2 = 0 then upper(normalized_name) else normalized_name end as product_name from srv")
def result_records(spark, sf_dir):
    """P1, P2, N12."""
    v = s.serving(merged(spark, sf_dir), establishments(spark, sf_dir), products(spark, sf_dir))
    v = v.withColumn("source_url", F.lit("https://source.example")).withColumn("name_en", F.lit(None).cast("string")).withColumn("name_de", F.when(F.col("product_id") % 2 == 0, F.upper("normalized_name"))).withColumn("name_es", F.lit(None).cast("string")).withColumn("rank", F.lit(1.0))
    r = k.valid_results(k.result_record(v))
    return r.select(F.col("offer.id").alias("offer_id"), F.col("offer.confidence").alias("confidence"), F.col("store.name").alias("store_name"), F.col("store.website").alias("website"), F.col("product.name").alias("product_name"))


@query("select l_orderkey, l_linenumber, l_partkey as product_id, s_name as store_name, lower(p_name) as product_name from lineitem join supplier on s_suppkey = l_suppkey join part on p_partkey = l_partkey where l_suppkey % 7 <> 0 and l_partkey % 5 <> 0 and l_quantity >= 45")
def offers_joined(spark, sf_dir):
    """Offers of unknown products and of stores without a place drop out."""
    o = load(spark, sf_dir, "lineitem").where("l_quantity >= 45").selectExpr("l_orderkey", "l_linenumber", "l_suppkey as store_id", "l_partkey as product_id")
    st = load(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_name as name", "case when s_suppkey % 7 <> 0 then 52.5e0 else 99e0 end as lat", "13.4e0 as lng")
    p = load(spark, sf_dir, "part").where("p_partkey % 5 <> 0").selectExpr("p_partkey as id", "lower(p_name) as normalized_name")
    return osm.offers(st, p, o).select("l_orderkey", "l_linenumber", "product_id", F.col("store.name").alias("store_name"), F.col("product.normalized_name").alias("product_name"))


@query("select c_custkey from customer where lower(c_mktsegment) in ('building', 'machinery') and contains(cast(c_custkey + 10000 as varchar), '1010')")
def scope_filter(spark, sf_dir):
    """a named scope and a postal code in the address."""
    c = load(spark, sf_dir, "customer").selectExpr("c_custkey", "c_mktsegment as district", "concat('Main St, ', cast(c_custkey + 10000 as string), ' Berlin') as address")
    return osm.in_scope(c, {"inner": ["Building", "Machinery"]}, "inner", "D-10 10").select("c_custkey")


@query("select distinct concat('node/', s_suppkey) as external_id, 'Mitte' as district from supplier where s_suppkey % 2 = 0 or s_suppkey % 3 = 0")
def subzone_import(spark, sf_dir):
    """Areas that overlap, one forced district."""
    tags = F.create_map(F.lit("name"), F.col("s_name"), F.lit("shop"), F.lit("bakery"), F.lit("addr:suburb"), F.lit("Elsewhere"))
    e = load(spark, sf_dir, "supplier").select(F.lit("node").alias("type"), F.col("s_suppkey").alias("id"), F.lit(52.5).alias("lat"), F.lit(13.4).alias("lon"), F.lit(None).cast("struct<lat:double,lon:double>").alias("center"), tags.alias("tags"))
    return osm.subzones({"north": e.where("id % 2 = 0"), "south": e.where("id % 3 = 0")}, ["bakery"], "Mitte").select("external_id", "district")
