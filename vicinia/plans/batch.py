"""Queries of many searches at once, of plausibility through profiles, and of nearest places."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinia.operators import batch as b
from vicinia.operators import candidates as c
from vicinia.operators import search as s
from vicinia.plans.registry import Registry
from vicinia.plans.search import _FP, _MIN, _SERVICE, _SPECIFIC, LEX, SERVING_WITH, _serving
from vicinia.plans.merging import _SR
from vicinia.plans.text_geo import _FUZ, _TOK, NORM, hav, sql_exists, sql_phrase
from vicinia.sources.scratch import built, written
from vicinia.sources.tables import candidates, establishments, load, products, views

query = Registry()
RULES = s.Plausibility(service_categories=["beauty"], service_hints=["nail"], chains=["rossmann"], fits={"promo": ["supermarket", "household"], "small": ["kiosk"], "economy": ["groceries", "hardware"]}, strict_groups=["large"], service_roles=["sells_services"], product_roles=["sells_products"])

# ---- searches: the first event of each user and day, where the user lives, for a product that the event points to. The same text in Spark and in the checks.
_AT = {"lat": "52.3383e0 + ((user_id * 7919) % 10007) * 0.3372e0 / 10007", "lon": "13.0884e0 + ((user_id * 104729) % 10009) * 0.6728e0 / 10009", "radius_m": "600e0 + ((user_id * 37) % 8) * 500"}
_TEXT = "case when search_id % 50 = 0 then 'misc' when search_id % 17 = 3 then 'phone repair' when search_id % 3 = 1 then substr(normalized_name, 1, length(normalized_name) - 1) else normalized_name end"
_ARRAYS = {"product_ids": ("search_id % 3 = 0", "id"), "groups": ("search_id % 4 <> 3", "product_group"), "intents": ("search_id % 11 = 5", "'groceries'")}
_SEARCHES = (
    f"ev as (select user_id, min(event_id) as search_id from events group by user_id, cast(ts as date)), srch as (select search_id, user_id, {', '.join(f'{e} as {k}' for k, e in _AT.items())}, id as asked, product_group as asked_group, {_TEXT} as query, "
    + ", ".join(f"case when {c} then [{v}] else [] end as {k}" for k, (c, v) in _ARRAYS.items())
    + " from ev join prod on prod.id = 1 + (search_id * 31) % 200)"
)


def searches(spark, sf_dir):
    ev = load(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts")).agg(F.min("event_id").alias("search_id"))
    p = products(spark, sf_dir).select("id", "product_group", "normalized_name")
    j = ev.join(p, F.expr("id = 1 + (search_id * 31) % 200"))
    kinds = {"product_ids": "array<bigint>", "groups": "array<string>", "intents": "array<string>"}
    arrays = [f"case when {c} then array({v}) else cast(array() as {kinds[k]}) end as {k}" for k, (c, v) in _ARRAYS.items()]
    return j.selectExpr("search_id", "user_id", "id as asked", "product_group as asked_group", *[f"{e} as {k}" for k, e in _AT.items()], f"{_TEXT} as query", *arrays)


# ---- profiles: what each source says about a store, from its candidates
_ROLES = "case when osm_category in ('mobile_phone', 'beauty') then {0}('sells_services'{1} when osm_category in ('mall', 'kiosk') then {0}('office'{1} else {0}('sells_products'{1} end"
_PROFILES = """pf as (select establishment_id, source_type as store_type, case when osm_category in ('mobile_phone', 'beauty') then ['sells_services'] when osm_category in ('mall', 'kiosk') then ['office'] else ['sells_products'] end as roles,
coalesce(list_sort(list_distinct(list(normalized_name) filter (where cand.validation_status = 'validated')))[1:3], []) as likely_products, case when osm_category = 'mobile_phone' then ['phone repair'] else [] end as likely_services,
max(confidence) as confidence, case when 2 * count(*) filter (where cand.validation_status = 'validated') > count(*) then 'validated' when 2 * count(*) filter (where cand.validation_status = 'rejected') > count(*) then 'rejected' else 'likely' end as validation_status, max(checked_at) as updated_at
from cand join prod on prod.id = product_id join est on est.id = establishment_id group by 1, 2, osm_category),
bp as (select * from (select establishment_id, roles, likely_products, likely_services, row_number() over (partition by establishment_id order by case validation_status when 'validated' then 4 when 'likely' then 3 when 'rejected' then 0 else 1 end * 1000 + floor(confidence * 100 + 0.5) desc, updated_at desc, store_type desc) as rn from pf) where rn = 1)"""


def profiles(spark, sf_dir):
    rows = candidates(spark, sf_dir).join(products(spark, sf_dir).select(F.col("id").alias("product_id"), "normalized_name"), "product_id").join(establishments(spark, sf_dir).select(F.col("id").alias("establishment_id"), "osm_category"), "establishment_id")
    n = lambda x: F.count_if(F.col("validation_status") == x)
    g = rows.groupBy("establishment_id", F.col("source_type").alias("store_type"), "osm_category").agg(
        F.slice(F.array_sort(F.collect_set(F.when(F.col("validation_status") == "validated", F.col("normalized_name")))), 1, 3).alias("likely_products"),
        F.max("confidence").alias("confidence"),
        F.when(2 * n("validated") > F.count("*"), "validated").when(2 * n("rejected") > F.count("*"), "rejected").otherwise("likely").alias("validation_status"),
        F.max("checked_at").alias("updated_at"),
    )
    return g.selectExpr("*", _ROLES.format("array", ")") + " as roles", "case when osm_category = 'mobile_phone' then array('phone repair') else cast(array() as array<string>) end as likely_services")


def _profiles(spark, sf_dir):
    return built(spark, "profiles", sf_dir, lambda: profiles(spark, sf_dir), lambda df, path: df.write.mode("overwrite").parquet(path))


# ---- the chain of plausibility over rows with query, strategy and the profile's fields
_NEAR = f"(normalized_name <> '' and {sql_phrase('query', 'normalized_name')})"
_TOKEN = sql_exists(f"list_filter({_TOK.format('query')}, lambda x: length(x) >= 4)", "x", sql_exists(_TOK.format("normalized_name"), "y", "contains(x, y) or contains(y, x) or " + _FUZ.format("x", "y")))
_PLACE = NORM.format("name")
_MEETS = lambda items: sql_exists(f"coalesce({items}, [])", "t", f"t <> '' and {sql_phrase('query', 't')}")
_FIT = "((product_group = 'promo' and (osm_category in ('supermarket', 'household') or app_category in ('supermarket', 'household'))) or (product_group = 'small' and (osm_category = 'kiosk' or app_category = 'kiosk')) or (product_group = 'economy' and (osm_category in ('groceries', 'hardware') or app_category in ('groceries', 'hardware'))))"
_FACTS = f"""coalesce(cast(confidence as double), 0) as c, {_NEAR} as near, {_TOKEN} as token, {_SPECIFIC} as specific, {_SERVICE} as service, contains({_PLACE}, 'rossmann') as chain, {_FIT} as fit,
validation_status = 'validated' as validated, validation_status = 'validated' or primary_source in ('merchant_added', 'user_validated') as owner, validation_status = 'validated' or primary_source in ('merchant_added', 'user_validated', 'website_extracted') as trusted,
osm_category = 'beauty' or app_category = 'beauty' as at_service, osm_category = 'beauty' and not contains({_PLACE}, 'rossmann') and ({_PLACE} = '' or contains({_PLACE}, 'nail')) as beauty,
coalesce(list_contains(roles, 'sells_services'), false) or {_MEETS('likely_services')} as served, roles is not null and not coalesce(list_contains(roles, 'sells_products'), false) and not {_MEETS('likely_products')} as against, {_MIN} as least"""
_GUARD = "(case when not specific then true when near or token then true when strategy = 2 then case when fit and c >= 0.55 then true else trusted and c >= 0.85 end when product_group = 'large' and not token and not trusted then false when fit and c >= 0.78 then true else trusted and c >= 0.9 and (fit or c >= 0.97) end)"
_KEEP = f"((not service or served or near or validated) and not (specific and beauty and not owner) and not (specific and not (near or token) and at_service and not chain and not owner) and {_GUARD} and (near or (not (specific and strategy <> 2 and against) and c >= least)))"
_JUDGED = ["blue anvil", "phone repair", "hamer", "snow"]


@query(
    f"{SERVING_WITH}, {_PROFILES}, qs(query) as (values {', '.join(f'({chr(39)}{x}{chr(39)})' for x in _JUDGED)}), x as (select srv.*, query, roles, likely_products, likely_services, case when product_id % 3 = 0 then 2 when product_group in ('promo', 'large') then 1 else 0 end as strategy from srv left join bp using (establishment_id), qs), "
    f"f as (select *, {_FACTS} from x) select establishment_id, product_id, query from f where {_KEEP}"
)
def plausibility_chain(spark, sf_dir):
    """F13 with N19 and W11: each row of the serving dataset for some queries, judged with its store's best profile."""
    e = establishments(spark, sf_dir).select(F.col("id").alias("establishment_id"), "name", "osm_category").distinct()
    asked = products(spark, sf_dir).select("normalized_name").distinct().withColumn("query", F.explode(F.array(*map(F.lit, _JUDGED))))
    # What texts say is judged once for each store and each name, and rows, which are far more, look it up.
    stores = written(s.store_facts(s.with_profiles(e, _profiles(spark, sf_dir)), _JUDGED, RULES), "stores")
    names = written(s.name_facts(asked), "names")
    rows = _serving(spark, sf_dir).join(stores, "establishment_id").withColumn("asked", F.explode("asked")).select("*", "asked.*")
    rows = rows.join(names, ["query", "normalized_name"], "left").fillna(False, ["near", "token"])
    rows = rows.withColumn("strategy", F.when(F.col("product_id") % 3 == 0, 2).when(F.col("product_group").isin("promo", "large"), 1).otherwise(0))
    return s.plausible(rows, F.col("query"), LEX, RULES, known=True).select("establishment_id", "product_id", "query")


@query(f"{views('est', 'prod', 'cand')}, {_PROFILES} select establishment_id, array_to_string(roles, '|') as roles, array_to_string(likely_products, '|') as likely_products, array_to_string(likely_services, '|') as likely_services from bp")
def best_profile(spark, sf_dir):
    """W11 over the profiles that sources give of each store."""
    p = F.col("profile")
    show = lambda k: F.array_join(p[k], "|").alias(k)
    return s.best_profiles(_profiles(spark, sf_dir)).select("establishment_id", show("roles"), show("likely_products"), show("likely_services"))


_ASKED = "qs(query) as (values ('phone repair'), ('blue anvil'), ('cold hammer'))"


@query(f"{views('est', 'prod', 'cand')}, {_PROFILES}, {_ASKED}, x as (select est.id, query, roles, likely_products, likely_services from est left join bp on bp.establishment_id = est.id, qs) select id, query, coalesce(list_contains(roles, 'sells_services'), false) or {_MEETS('likely_services')} as supports, roles is not null and not coalesce(list_contains(roles, 'sells_products'), false) and not {_MEETS('likely_products')} as contradicts from x")
def profile_judgement(spark, sf_dir):
    """F16: what each store's best profile says about some queries."""
    p = F.col("profile")
    e = establishments(spark, sf_dir).select(F.col("id").alias("establishment_id"))
    x = s.with_profiles(e, _profiles(spark, sf_dir)).withColumn("query", F.explode(F.array(*map(F.lit, ("phone repair", "blue anvil", "cold hammer")))))
    return x.select(F.col("establishment_id").alias("id"), "query", s.profile_supports(p["likely_services"], p["roles"], F.col("query"), ["sells_services"]).alias("supports"), s.profile_contradicts(p.isNotNull(), p["likely_products"], p["roles"], F.col("query"), ["sells_products"]).alias("contradicts"))


@query(f"{views('est', 'prod', 'cand')}, {_PROFILES} select id, coalesce(len(likely_products) > 0, false) as supports_products, coalesce(len(likely_services) > 0, false) as supports_services, coalesce(len(list_filter(likely_services, lambda j: j ilike '%repair%')) > 0, false) as supports_repair from est left join bp on bp.establishment_id = id")
def capability_flags(spark, sf_dir):
    """What the best profile of each store supports."""
    p = F.col("profile")
    rows = s.with_profiles(establishments(spark, sf_dir).select(F.col("id").alias("establishment_id")), _profiles(spark, sf_dir))
    flags = c.capabilities(p["roles"], p["likely_products"], p["likely_services"])
    return rows.select(F.col("establishment_id").alias("id"), *[F.coalesce(x, F.lit(False)).alias(k) for k, x in flags.items()])


_NC = "(contains(normalized_name, query) or contains(query, normalized_name))"
_RANK = f"case when normalized_name = query then 100000 when {_NC} then 50000 when near then 8000 else 0 end + 2000 * cast(confidence as double) + case validation_status when 'validated' then 1500 when 'likely' then 700 when 'rejected' then -10000 else 0 end + 230 * {_SR.format('primary_source')} + 280 * est_freshness - case when osm_category in ('mall', 'department_store') then 1800 else 0 end - m - 2"
_BATCH = f"""{SERVING_WITH}, {_SEARCHES}, {_PROFILES},
pt as (select distinct lat as qlat, lon as qlon, radius_m from srch),
pre as (select * from (select pt.*, srv.*, row_number() over (partition by qlat, qlon, radius_m order by confidence desc, last_checked_at desc, establishment_id, product_id) as rn from pt join srv on lat between qlat - radius_m / 111320e0 and qlat + radius_m / 111320e0 and abs(lon - qlon) <= radius_m / (111320e0 * cos(radians(qlat)))) where rn <= 450),
tg as (select pre.*, search_id, query, case when len(intents) > 0 then case when list_contains(intents, app_category) then 3 end when list_contains(product_ids, product_id) then 2 when list_contains("groups", product_group) then 1 when contains(normalized_name, query) then 0 end as strategy
from srch join pre on srch.lat = qlat and srch.lon = qlon and srch.radius_m = pre.radius_m where query <> 'misc'),
ct as (select *, count(*) filter (where strategy in (1, 2)) over (partition by search_id) as strong from tg where strategy is not null),
f as (select *, {_FACTS}, {hav('qlat', 'qlon', 'lat', 'lon')} as m from ct left join bp using (establishment_id) where strategy > 0 or strong < 110),
rk as (select *, {_RANK} as "rank" from f where {_KEEP} and m <= radius_m),
dd as (select *, row_number() over (partition by search_id, {_FP} order by "rank" desc, establishment_id, product_id) as rn2 from rk),
best as (select *, row_number() over (partition by search_id order by "rank" desc, establishment_id, product_id) as nth from dd where rn2 = 1)"""


def _found(spark, sf_dir):
    return b.search_batch(searches(spark, sf_dir), _serving(spark, sf_dir), LEX, profiles=_profiles(spark, sf_dir), rules=RULES)


@query(f'{_BATCH} select search_id, establishment_id, product_id, strategy, round(m, 1) as distance_m, round("rank", 2) as "rank", nth from best where nth <= 80')
def search_batch(spark, sf_dir):
    """Q10 for all users' searches of all days, each with its own place, radius, query and intent, through the chain of plausibility."""
    return _found(spark, sf_dir).select("search_id", "establishment_id", "product_id", "strategy", F.round("distance_m", 1).alias("distance_m"), F.round("rank", 2).alias("rank"), F.col("nth").cast("long").alias("nth"))


@query(
    f"{_BATCH}, hs as (select srch.search_id, asked_group, b.product_id is not null as found, coalesce(b.product_id = asked, false) as canonical, coalesce({sql_phrase('srch.query', 'normalized_name')}, false) as hit, cast(confidence as double) as conf, coalesce(primary_source in ('merchant_added', 'user_validated') or validation_status = 'validated', false) as trusted, m from srch left join best b on b.search_id = srch.search_id and nth <= 12), "
    "sc as (select search_id, asked_group, coalesce(bool_or(canonical or hit), false) as hit, max(case when found then case when canonical then 2 else 0 end + case when hit then 2 else 0 end + least(1.2e0, conf) + case when trusted then 1 else 0 end + greatest(0, 1 - m / 3000) end) as best from hs group by 1, 2) "
    "select asked_group as persona, count(*) as searches, count(*) filter (where hit) as hits, round(count(*) filter (where hit) / count(*), 4) as hit_rate, round(avg(coalesce(best, 0)), 4) as mean_best from sc group by 1"
)
def persona_hit_rate(spark, sf_dir):
    """G-A21 and Q14: whether all searches of those who ask for a group of products find what they asked for among the first twelve."""
    asked = searches(spark, sf_dir).select("search_id", F.col("asked_group").alias("persona"), F.array("asked").alias("product_ids"), F.array("query").alias("words"))
    return b.hit_rates(_found(spark, sf_dir), asked)


_CUSTOMERS = "cu as (select c_custkey as search_id, 52.3383e0 + ((c_custkey * 7919) % 10007) * 0.3372e0 / 10007 as qlat, 13.0884e0 + ((c_custkey * 104729) % 10009) * 0.6728e0 / 10009 as qlon, (c_custkey % 9) * 0.5e0 + 0.5e0 as km from customer)"


def _customers(spark, sf_dir):
    return load(spark, sf_dir, "customer").selectExpr("c_custkey as search_id", "52.3383e0 + ((c_custkey * 7919) % 10007) * 0.3372e0 / 10007 as lat", "13.0884e0 + ((c_custkey * 104729) % 10009) * 0.6728e0 / 10009 as lon", "(c_custkey % 9) * 0.5e0 + 0.5e0 as current_km")


def _places(spark, sf_dir):
    return establishments(spark, sf_dir).select(F.col("id").alias("place_id"), "lat", "lon")


@query(f"{views('est')}, {_CUSTOMERS}, d as (select search_id, id as place_id, {hav('qlat', 'qlon', 'lat', 'lon')} as m from cu, est), r as (select *, row_number() over (partition by search_id order by m, place_id) as nth from d where m <= 15000) select search_id, place_id, round(m, 1) as distance_m, nth from r where nth <= 3")
def nearest_places(spark, sf_dir):
    """L9 as a join: the three nearest places of each customer within 15 km."""
    return b.nearest_join(_customers(spark, sf_dir), _places(spark, sf_dir), 3, 15_000.0).select("search_id", "place_id", F.round("distance_m", 1).alias("distance_m"), F.col("nth").cast("long").alias("nth"))


@query(f"{views('est')}, {_CUSTOMERS}, d as (select search_id, km, {hav('qlat', 'qlon', 'lat', 'lon')} as m from cu, est where app_category = 'groceries'), n as (select cu.search_id, cu.km, min(m) filter (where m <= 4000) as nearest from cu left join d on d.search_id = cu.search_id group by 1, 2) select search_id, round(nearest, 1) as nearest_m, least(15e0, greatest(0.5e0, ceil((nearest / 1000 + 0.2e0) / 0.5e0) * 0.5e0, km + 0.5e0)) as suggested_km, case when nearest is null then 'catalog_gap' else 'expand_radius' end as advice from n")
def guidance_batch(spark, sf_dir):
    """G4 for each customer who looks for groceries within 4 km."""
    groceries = establishments(spark, sf_dir).where("app_category = 'groceries'").select(F.col("id").alias("place_id"), "lat", "lon")
    return b.guidance(_customers(spark, sf_dir), groceries, 4_000.0).withColumn("nearest_m", F.round("nearest_m", 1))
