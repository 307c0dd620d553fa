"""Queries of candidate generation, classification, demand, quality and curation."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinia.functions import text
from vicinia.operators import candidates as c
from vicinia.operators import insights as i
from vicinia.operators.matching import phrase_hits
from vicinia.plans.merging import MERGED_WITH, merged
from vicinia.plans.registry import Registry
from vicinia.plans.search import SERVING_WITH, _serving
from vicinia.plans.text_geo import NORM
from vicinia.sources.tables import candidates, establishments, load, products, views

query = Registry()

OSM = {"supermarket": ["groceries"], "beauty": ["beauty"], "chemist": ["pharmacy"], "hardware": ["tools", "art"]}
WORDS = {"electronics": "phone|repair", "art": "studio", "fresh-food": "natural|market"}
_OSMSQL = "case osm_category when 'supermarket' then ['groceries'] when 'beauty' then ['beauty'] when 'chemist' then ['pharmacy'] when 'hardware' then ['tools', 'art'] else [] end"
_KW = "list_filter([case when regexp_matches(lower(name), 'phone|repair') then 'electronics' end, case when contains(lower(name), 'studio') then 'art' end, case when regexp_matches(lower(name), 'natural|market') then 'fresh-food' end], lambda x: x is not null)"


@query(f"{views('est')}, a as (select id, {_OSMSQL} as m, {_KW} as k from est), b as (select *, list_concat(m, list_filter(k, lambda x: not list_contains(m, x))) as u from a), d as (select *, case when list_contains(u, 'pharmacy') then list_append(u, 'personal-care') else u end as v from b), e as (select *, case when list_has_any(v, ['beauty', 'personal-care']) then list_filter(v, lambda x: x <> 'art') else v end as w from d) select id, case when len(w) = 0 then 'household' else array_to_string(w[1:5], '|') end as categories, round(least(0.97e0, case when len(m) > 0 then 0.8e0 else 0.56e0 end + least(0.15e0, 0.04e0 * len(k))), 4) as confidence from e")
def classify_categories(spark, sf_dir):
    cats, conf = c.classify_categories(F.col("osm_category"), F.lower("name"), OSM, WORDS)
    return establishments(spark, sf_dir).select("id", F.array_join(cats, "|").alias("categories"), conf.alias("confidence"))


_ROLES = [("grocery", ["supermarket", "health_food"], "market|food"), ("repair", ["mobile_phone"], "repair"), ("service", ["beauty"], "studio")]


@query(f"{views('est')}, a as (select id, case when osm_category in ('supermarket', 'health_food') then 1 else 0 end as gc, case when regexp_matches(lower(name), 'market|food') then 1 else 0 end as gn, case when osm_category = 'mobile_phone' then 1 else 0 end as rc, case when contains(lower(name), 'repair') then 1 else 0 end as rn, case when osm_category = 'beauty' then 1 else 0 end as sc, case when contains(lower(name), 'studio') then 1 else 0 end as sn from est) select id, case when rc + rn > 0 then 'repair' when sc + sn > 0 then 'service' when gc + gn > 0 then 'grocery' else 'retail' end as primary_role, case when rc + rn > 0 then case when rc + rn = 2 then 0.84e0 when rc = 1 then 0.78e0 else 0.68e0 end when sc + sn > 0 then case when sc + sn = 2 then 0.84e0 when sc = 1 then 0.78e0 else 0.68e0 end when gc + gn > 0 then case when gc + gn = 2 then 0.84e0 when gc = 1 then 0.78e0 else 0.68e0 end else 0.58e0 end as confidence from a")
def classify_roles(spark, sf_dir):
    _, primary, conf = c.classify_roles(F.col("osm_category"), F.lower("name"), _ROLES, ["repair", "service", "grocery"])
    return establishments(spark, sf_dir).select("id", primary.alias("primary_role"), conf.alias("confidence"))


RULES = [("groceries", "promo", "0.7200"), ("groceries", "economy", "0.6000"), ("pharmacy", "small", "0.7100"), ("household", "small", "0.7400"), ("electronics", "standard", "0.8000"), ("personal_care", "medium", "0.5000")]
_RULES = "r(app_category, product_group, base_confidence) as (select a, b, cast(c as decimal(5,4)) from (values " + ", ".join(f"('{a}', '{b}', {x})" for a, b, x in RULES) + ") v(a, b, c))"


def _rules(spark):
    return spark.createDataFrame(RULES, "app_category string, product_group string, b string").withColumn("base_confidence", F.col("b").cast("decimal(5,4)")).drop("b")


@query(f"{views('est', 'prod')}, {_RULES}, ec as (select id as establishment_id, app_category from est union select id, app_category2 from est), j as (select establishment_id, p.id as product_id, r.app_category, cast(least(0.99, base_confidence + case when r.app_category in ('supermarket', 'pharmacy') then 0.04 else 0 end) as decimal(5,4)) as confidence, row_number() over (partition by establishment_id, p.id order by least(0.99, base_confidence + case when r.app_category in ('supermarket', 'pharmacy') then 0.04 else 0 end) desc, r.app_category desc) as rn from ec join r using (app_category) join prod p on p.product_group = r.product_group) select establishment_id, product_id, app_category, confidence, case when confidence >= 0.74 then 'likely' else 'unvalidated' end as validation_status from j where rn = 1")
def rule_candidates(spark, sf_dir):
    e = establishments(spark, sf_dir).select("id", F.array("app_category", "app_category2").alias("app_categories"))
    return c.rule_candidates(e, _rules(spark), products(spark, sf_dir)).select("establishment_id", "product_id", "app_category", "confidence", "validation_status")


HINTS = [("name", "nail", "manicure", 0.8), ("name", "phone", "phone-repair", 0.85), ("category", "mobile_phone", "phone-repair", 0.75), ("category", "beauty", "haircut", 0.6), ("category", "chemist", "advice", 0.5)]
_HINTS = "h(kind, hint, slug, confidence) as (values " + ", ".join(f"('{a}', '{b}', '{x}', {y}e0)" for a, b, x, y in HINTS) + ")"


@query(f"{views('est')}, {_HINTS}, j as (select id as establishment_id, slug, max(confidence) as confidence from est join h on (kind = 'name' and contains(lower(name), hint)) or (kind = 'category' and osm_category = hint) where app_category <> 'groceries' group by 1, 2) select * from j")
def service_candidates(spark, sf_dir):
    return c.service_candidates(establishments(spark, sf_dir), spark.createDataFrame(HINTS, "kind string, hint string, slug string, confidence double")).select("establishment_id", "slug", "confidence")


WEIGHTS = [("groceries", "promo", 0.9), ("electronics", "standard", 0.5), ("groceries", "small", 0.4), ("household", "large", 0.8)]
_WEIGHTS = "wt(category, product_group, weight) as (values " + ", ".join(f"('{a}', '{b}', {x}e0)" for a, b, x in WEIGHTS) + ")"
#: The catalogue of pages: what benchmark items open with, words that pages of the same languages use.
_NT = f"string_split({NORM.format('text')}, ' ')"
_PN = f"p as (select item_id as product_id, case item_id % 3 when 0 then 'promo' when 1 then 'small' else 'large' end as product_group, array_to_string({_NT}[1:2], ' ') as name, [{_NT}[3], array_to_string({_NT}[4:5], ' ')] as synonyms from benchmark)"
_BAG = f"b as (select page_id, case page_id % 3 when 0 then 'groceries' when 1 then 'electronics' else 'household' end as category, concat(' ', {NORM.format('html')}, ' ') as bag from pages)"
_SAYS = "contains(bag, concat(' ', {0}, ' '))"


@query(f"with {_WEIGHTS}, {_PN}, {_BAG}, j as (select page_id, product_id, {_SAYS.format('name')} as n, {_SAYS.format('synonyms[1]')} or {_SAYS.format('synonyms[2]')} as y, coalesce(weight, 0) as w from b join p on true left join wt on wt.category = b.category and wt.product_group = p.product_group where name <> 'the and'), s as (select page_id, product_id, round(case when n then 0.38e0 else 0 end + case when y then 0.27e0 else 0 end + 0.22e0 * w, 4) as s from j where n or y) select page_id, product_id, least(s, 0.94e0) as confidence from s where s >= 0.46e0")
def website_candidates(spark, sf_dir):
    """C6 over the pages' own words: names and synonyms are the first words of benchmark items."""
    w = F.split(text.normalize(F.col("text")), " ")
    words = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    p = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("product_id"), F.expr("case item_id % 3 when 0 then 'promo' when 1 then 'small' else 'large' end").alias("product_group"), words(1, 2).alias("name"), F.array(words(3, 1), words(4, 2)).alias("synonyms"))
    b = load(spark, sf_dir, "pages").select("page_id", F.expr("case page_id % 3 when 0 then 'groceries' when 1 then 'electronics' else 'household' end").alias("category"), text.normalize(F.col("html")).alias("bag"))
    return c.website_candidates(b, p, spark.createDataFrame(WEIGHTS, "category string, product_group string, weight double"), ["the and"])


# Each start counts, so finds of "the the" may overlap: all runs of one and two words, the lengths of names and synonyms, are counted.
@query(f"with {_PN}, f as (select distinct phrase from (select unnest(list_concat([name], synonyms)) as phrase from p) where phrase <> ''), w as (select page_id, list_filter(string_split({NORM.format('html')}, ' '), lambda x: x <> '') as ws from pages), g as (select page_id, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase from w, (values (1), (2)) v(k)) select page_id, phrase, count(*) as n from g join f using (phrase) group by page_id, phrase")
def page_phrases(spark, sf_dir):
    """How often each name and synonym stands in each page."""
    w = F.split(text.normalize(F.col("text")), " ")
    f = load(spark, sf_dir, "benchmark").select(F.explode(F.array(*[F.array_join(F.slice(w, a, n), " ") for a, n in ((1, 2), (3, 1), (4, 2))])).alias("phrase"))
    return phrase_hits(load(spark, sf_dir, "pages").select("page_id", text.tokens(text.normalize(F.col("html"))).alias("words")), f)


@query(f"{views('est', 'prod')}, {_WEIGHTS}, cats as (select distinct app_category from est), w as (select category as app_category, product_group, weight from wt union all select app_category, 'medium', 0.43e0 from cats where not exists (select 1 from wt where wt.category = app_category and wt.product_group = 'medium')), j as (select est.id as establishment_id, prod.id as product_id, round(least(0.76e0, greatest(0.48e0, 0.82e0 * (weight + case when list_has_any(string_split(lower(name), ' '), string_split(normalized_name, ' ')) then 0.06e0 else 0 end))), 4) as confidence from est join w using (app_category) join prod on prod.product_group = w.product_group), r as (select *, row_number() over (partition by establishment_id order by confidence desc, product_id) as rn from j) select establishment_id, product_id, confidence from r where rn <= 10")
def heuristic_candidates(spark, sf_dir):
    w = spark.createDataFrame(WEIGHTS, "app_category string, product_group string, weight double")
    return c.heuristic_candidates(establishments(spark, sf_dir), w, products(spark, sf_dir), 10, ["medium"])


_SR = "case source_type when 'merchant_added' then 6 when 'website_extracted' then 3 when 'imported' then 2 when 'rules_generated' then 2 when 'ai_generated' then 1 else 0 end"


@query(f"{views('cand')}, a as (select *, row_number() over (partition by establishment_id, product_id order by {_SR} * 1000 + floor(confidence * 1000 + 0.5) desc, id) as rn from cand), b as (select * exclude (rn), row_number() over (partition by establishment_id order by confidence desc, product_id) as rn from a where rn = 1) select establishment_id, product_id, id from b where rn <= case when establishment_id % 3 = 0 then 2 when establishment_id % 3 = 1 then 5 else 3 end")
def candidate_dedupe_trim(spark, sf_dir):
    limit = c.recommendation_limit(F.when(F.col("establishment_id") % 3 != 0, 200), F.when(F.col("establishment_id") % 3 == 1, 2).otherwise(1))
    return c.dedupe_trim(candidates(spark, sf_dir), limit).select("establishment_id", "product_id", "id")


@query(f"{views('cand')} select establishment_id, product_id, id, least(0.9e0, greatest(0.45e0, cast(confidence as double))) as confidence from cand where exists (select 1 from cand p where p.establishment_id = cand.establishment_id and p.product_id = cand.product_id and p.source_type = 'merchant_added')")
def model_candidates(spark, sf_dir):
    x = candidates(spark, sf_dir)
    return c.model_candidates(x.withColumn("confidence", F.col("confidence").cast("double")), x.where("source_type = 'merchant_added'")).select("establishment_id", "product_id", "id", "confidence")


@query(f"{views('prod')}, a as (select id as product_id, 'und' as lang, normalized_name as alias, 100 as priority from prod union all select id, 'en', alias, 90 from prod union all select id, 'und', lower(trim(brand)), 70 from prod) select product_id, lang, alias, max(priority) as priority from a group by 1, 2, 3")
def alias_bootstrap(spark, sf_dir):
    return c.alias_bootstrap(products(spark, sf_dir))


@query(f"{views('est')} select id, array_to_string(list_sort(list_distinct([lower(app_category), replace(lower(osm_category), '_', ' '), 'shop'])), '|') as roles, array_to_string(list_sort(list_distinct([lower(replace(osm_category, '_', ' ')), 'shop'])), '|') as likely, array_to_string(list_sort(list_distinct([lower(app_category2), {NORM.format('name')}])), '|') as unlikely, round(least(0.92e0, greatest(0.45e0, freshness)), 4) as confidence, least(0.92e0, greatest(0.45e0, freshness)) < 0.82e0 as needs_review from (select * replace (replace(app_category, '_', ' ') as app_category, replace(app_category2, '_', ' ') as app_category2) from est)")
def store_profiles(spark, sf_dir):
    """All parts of a sanitised profile."""
    p = c.profile(F.array("app_category", "osm_category", F.lit("Shop"), F.lit(" ")), F.array(F.col("osm_category"), F.lit("SHOP"), F.col("osm_category"), F.lit(" ")), F.array("app_category2", "name", "app_category2"), F.col("freshness"))
    show = lambda x: F.array_join(F.sort_array(x), "|")
    return establishments(spark, sf_dir).select("id", show(p["roles"]).alias("roles"), show(p["likely"]).alias("likely"), show(p["unlikely"]).alias("unlikely"), F.round(p["confidence"], 4).alias("confidence"), p["needs_review"].alias("needs_review"))


# Searches from events: the term is the event type, an error or a value under 20 found nothing.
_SE = "se as (select event_id, ts, event_type as term, case when event_type = 'error' or value < 20 then 0 else cast(floor(value) as bigint) end as results, concat('d', cast(user_id % 7 as varchar)) as district, case when user_id % 3 = 0 then null else concat('e', cast(user_id % 3 as varchar)) end as endpoint from events)"


def searches(spark, sf_dir):
    return load(spark, sf_dir, "events").selectExpr("event_id", "ts", "event_type as term", "case when event_type = 'error' or value < 20 then 0 else cast(floor(value) as bigint) end as results", "concat('d', cast(user_id % 7 as string)) as district", "case when user_id % 3 = 0 then null else concat('e', cast(user_id % 3 as string)) end as endpoint", "cast(null as string) as reason", "cast(user_id % 60 as double) as radius_km")


@query(f"with {_SE} select term, count(*) as total, count(*) filter (where results > 0) as resolved, count(*) filter (where results = 0) as unresolved, round(avg(results), 2) as avg_results from se group by term")
def insights_terms(spark, sf_dir):
    return i.term_insights(searches(spark, sf_dir))


@query(f"with {_SE} select count(*) as total, count(*) filter (where results = 0) as unresolved, round(count(*) filter (where results = 0) / count(*), 4) as unresolved_rate from se")
def insights_totals(spark, sf_dir):
    return i.totals(searches(spark, sf_dir))


@query(f"with {_SE} select cast(ts as date) as day, count(*) as n from se where results <= 0 group by 1 order by 1 desc limit 14")
def insights_trend(spark, sf_dir):
    return i.daily_no_results(searches(spark, sf_dir))


@query(f"with {_SE} select coalesce(endpoint, 'unknown') as endpoint, count(*) as n from se group by 1")
def insights_endpoints(spark, sf_dir):
    return i.endpoint_counts(searches(spark, sf_dir))


@query(f"with {_SE} select term as query, count(*) as n, count(distinct cast(ts as date)) as days, min(ts) as first_at, max(ts) as last_at, max(district) as district from se where results <= 0 group by 1")
def demand_report(spark, sf_dir):
    return i.demand_report(i.failed_events(searches(spark, sf_dir)).withColumnRenamed("term", "query"))


@query(f"with {_SE} select district, count(*) as n from se where results <= 0 group by 1")
def unresolved_by_district(spark, sf_dir):
    return i.by_district(i.failed_events(searches(spark, sf_dir)))


@query(f"with {_SE} select event_id from se join events using (event_id) where user_id % 60 <= 50 and results <= 5000")
def event_validation(spark, sf_dir):
    return i.valid_events(searches(spark, sf_dir)).select("event_id")


_FIT = "case product_group when 'promo' then app_category in ('groceries', 'household') when 'small' then app_category in ('electronics') else false end"
_SUS = f"sus as (select cand.*, product_group, (not {_FIT}) and validation_status <> 'validated' and source_type <> 'merchant_added' as suspicious from cand join est on est.id = establishment_id join prod on prod.id = product_id)"


def suspects(spark, sf_dir):
    e = establishments(spark, sf_dir).select(F.col("id").alias("establishment_id"), "app_category")
    p = products(spark, sf_dir).select(F.col("id").alias("product_id"), "product_group")
    j = candidates(spark, sf_dir).join(e, "establishment_id").join(p, "product_id")
    return j.withColumn("suspicious", c.suspicious(F.array("app_category"), F.col("product_group"), {"promo": ["groceries", "household"], "small": ["electronics"]}, F.col("validation_status"), F.col("source_type")))


@query(f"{views('est', 'prod', 'cand')}, {_SUS} select product_group, count(*) as total, count(*) filter (where suspicious) as suspicious, count(*) filter (where validation_status = 'validated') as validated, count(*) filter (where suspicious and confidence >= 0.82) as high_confidence, round(count(*) filter (where suspicious) / count(*), 4) as suspicious_rate from sus group by 1 having count(*) >= 20")
def category_quality(spark, sf_dir):
    return i.category_quality(suspects(spark, sf_dir))


@query(f"{views('est', 'prod', 'cand')}, {_SUS} select id, confidence from sus where suspicious order by confidence desc, id limit 25")
def suspicious_examples(spark, sf_dir):
    """L4."""
    return suspects(spark, sf_dir).where("suspicious").orderBy(F.desc("confidence"), "id").limit(25).select("id", "confidence")


@query(f"{views('cand')} select source_type, count(*) as n, round(count(*) filter (where validation_status in ('likely', 'validated')) / count(*), 4) as precision, round(avg(cast(confidence as double)), 4) as avg_confidence from cand group by 1")
def source_precision(spark, sf_dir):
    return i.source_precision(candidates(spark, sf_dir))


@query(f"{views('est')}, k as (select district, app_category, row_number() over (partition by district order by count(*) desc, app_category) as rn from est group by 1, 2), t as (select district, string_agg(app_category, '|' order by rn) as top_categories from k where rn <= 5 group by 1) select district, count(*) as total, count(*) filter (where active_status = 'active') as active, count(*) filter (where closed_candidate) as closed, count(website) as with_website, count(*) filter (where opening_hours <> '') as with_hours, count(duplicate_of) as duplicates, any_value(top_categories) as top_categories from est join t using (district) group by 1")
def district_overview(spark, sf_dir):
    return i.district_overview(establishments(spark, sf_dir))


_RF = f"""q as (select id, active_status, opening_hours, date '2024-06-01' - cast(seen_days + import_days as integer) as updated_at, case when id % 9 = 0 then '' else app_category end as cat, coalesce(n, 0) as n, coalesce(v, 0) as v from est left join (select establishment_id, count(*) as n, count(*) filter (where validation_status = 'validated') as v from mrg where validation_status <> 'rejected' group by 1) on establishment_id = id),
s as (select id, updated_at, concat_ws('|', case when cat = '' then 'missing_categories' end, case when n = 0 then 'missing_products' end, case when n > 0 and v = 0 then 'low_validation' end, case when active_status = 'active' and trim(opening_hours) = '' then 'missing_opening_hours' end, case when updated_at < date '2024-06-01' - 120 then 'stale_data' end) as flags,
case when cat = '' then 2 else 0 end + case when n = 0 then 2 else 0 end + case when n > 0 and v = 0 then 1 else 0 end + case when active_status = 'active' and trim(opening_hours) = '' then 1 else 0 end + case when updated_at < date '2024-06-01' - 120 then 1 else 0 end as score from q)"""


def _flagged(spark, sf_dir):
    k = merged(spark, sf_dir).where("validation_status <> 'rejected'").groupBy(F.col("establishment_id").alias("id")).agg(F.count("*").alias("n_products"), F.count_if(F.col("validation_status") == "validated").alias("n_validated"))
    e = establishments(spark, sf_dir).join(k, "id", "left").withColumn("app_category", F.expr("case when id % 9 = 0 then '' else app_category end")).withColumn("updated_at", F.expr("date_sub(date'2024-06-01', cast(seen_days + import_days as int))"))
    return i.review_flags(e, F.lit("2024-06-01").cast("date"))


@query(f"{MERGED_WITH}, {_RF} select id, flags, score from s where score > 0 order by score desc, updated_at, id limit 160")
def review_queue(spark, sf_dir):
    return i.review_queue(_flagged(spark, sf_dir)).select("id", "flags", "score")


@query(f"{views('prod')}, r as (select *, row_number() over (partition by product_group order by normalized_name, id) as rn from prod) select product_group, count(*) as n, string_agg(normalized_name, '|' order by rn) filter (where rn <= 6) as sample from r group by 1")
def catalog_overview(spark, sf_dir):
    return i.catalog_overview(products(spark, sf_dir))


@query("select round(sum(case when ts >= timestamp '2024-01-30' - interval 7 day then value end), 2) as cost_7d, round(sum(case when ts >= timestamp '2024-01-30' - interval 30 day then value end), 2) as cost_30d, round(count(*) filter (where event_type <> 'error') / count(*), 4) as coverage from events")
def ai_run_rollup(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("ts", F.col("value").alias("cost"), (F.col("event_type") != "error").alias("covered"))
    return i.run_rollup(e, F.lit("2024-01-30").cast("timestamp_ntz"))


@query("select cast(ts as date) as day, cast(sum(cast(value as decimal(18,2))) as decimal(18,2)) as cost from events where event_type in ('purchase', 'click', 'view') group by 1")
def daily_cost(spark, sf_dir):
    """G-A14."""
    return load(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "click", "view")).groupBy(F.to_date("ts").alias("day")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("decimal(18,2)").alias("cost"))


_CE = "ce as (select case when o_orderkey % 2 = 0 and o_orderstatus = 'F' then 'product_validated' when o_orderstatus = 'O' then 'product_added' else 'product_rejected' end as event_type, c_mktsegment as app_category, o_orderpriority as product_group, o_orderdate as created_at from orders join customer on c_custkey = o_custkey where o_orderdate >= timestamp '1997-01-01' - interval 400 day)"
_SUG = f"{_CE}, sug as (select lower(trim(app_category)) as app_category, product_group, count(*) as support, count(*) filter (where event_type in ('product_validated', 'product_added')) as positive from ce group by 1, 2 having count(*) >= 3)"


def _events(spark, sf_dir):
    o = load(spark, sf_dir, "orders").join(load(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    return o.selectExpr("case when o_orderkey % 2 = 0 and o_orderstatus = 'F' then 'product_validated' when o_orderstatus = 'O' then 'product_added' else 'product_rejected' end as event_type", "c_mktsegment as app_category", "o_orderpriority as product_group", "o_orderdate as created_at")


def _suggest(spark, sf_dir):
    return i.curation_suggestions(_events(spark, sf_dir), F.lit("1997-01-01").cast("timestamp_ntz"), 400, precision=0.5)


@query(f"with {_SUG} select app_category, product_group, support, positive, round(positive / support, 4) as precision, positive / support >= 0.5 as eligible from sug")
def curation_suggestions(spark, sf_dir):
    return _suggest(spark, sf_dir)


@query(f"with {_SUG}, {_RULES}, b as (select app_category, product_group, round(least(0.98e0, greatest(0.55e0, round(positive / support, 4) - 0.03e0 + case when support >= 50 then 0.04e0 when support >= 30 then 0.02e0 else 0 end)), 4) as n from sug where positive / support >= 0.5 order by round(positive / support, 4) desc, support desc, app_category, product_group limit 5) select coalesce(b.app_category, r.app_category) as app_category, coalesce(b.product_group, r.product_group) as product_group, greatest(n, cast(base_confidence as double)) as base_confidence, case when base_confidence is null then 'insert' when n is null then 'keep' else 'update' end as op from r full join b on r.app_category = b.app_category and r.product_group = b.product_group")
def curation_apply(spark, sf_dir):
    return i.apply_suggestions(_suggest(spark, sf_dir), _rules(spark).withColumn("base_confidence", F.col("base_confidence").cast("double")), 5)


@query(f"{views('prod', 'cand')}, b as (select establishment_id, list(distinct normalized_name) as names from cand join prod on prod.id = product_id where cand.id % 3 <> 0 group by 1), a as (select establishment_id, list(distinct normalized_name) as names from cand join prod on prod.id = product_id where cand.id % 4 <> 0 group by 1) select establishment_id, array_to_string(list_sort(list_filter(a.names, lambda x: not list_contains(b.names, x)))[1:12], '|') as added, array_to_string(list_sort(list_filter(b.names, lambda x: not list_contains(a.names, x)))[1:12], '|') as removed, len(a.names) as n_after from b join a using (establishment_id)")
def snapshot_compare(spark, sf_dir):
    j = candidates(spark, sf_dir).join(products(spark, sf_dir).select(F.col("id").alias("product_id"), "normalized_name"), "product_id")
    names = lambda cond: j.where(cond).groupBy("establishment_id").agg(F.collect_set("normalized_name").alias("names"))
    return i.snapshot_compare(names("id % 3 <> 0"), names("id % 4 <> 0"))


@query(f"{MERGED_WITH}, k as (select establishment_id, count(*) as n from mrg group by 1) select round(avg(n), 4) as mean, max(n) as max, quantile_cont(n, 0.5) as p50, quantile_cont(n, 0.9) as p90 from k")
def density_percentiles(spark, sf_dir):
    return i.density(merged(spark, sf_dir).groupBy("establishment_id").agg(F.count("*").alias("n")))


@query(f"{views('est', 'prod', 'cand')}, {_SUS}, p as (select (validation_status = 'validated' or (confidence >= 0.66 and not suspicious)) as ok from sus) select count(*) as n, count(*) filter (where ok) as plausible, count(*) filter (where not ok) as doubtful, round(count(*) filter (where ok) / count(*), 4) as plausible_ratio from p")
def enrichment_audit(spark, sf_dir):
    return i.enrichment_audit(suspects(spark, sf_dir))


@query(f"{SERVING_WITH} select establishment_id, count(*) filter (where validation_status = 'validated') as validated, count(*) filter (where validation_status = 'likely') as likely, round(avg(cast(confidence as double)), 3) as mean_confidence from srv group by 1")
def result_summary(spark, sf_dir):
    return i.result_summary(_serving(spark, sf_dir))


@query("with recursive e as (select event_id, user_id, epoch_us(ts) as us, row_number() over (partition by user_id order by ts, event_id) as k from events), w as (select event_id, user_id, us, k, us as open, 1 as n from e where k = 1 union all select e.event_id, e.user_id, e.us, e.k, case when e.us >= w.open + 86400000000 then e.us else w.open end, case when e.us >= w.open + 86400000000 then 1 else w.n + 1 end from w join e on e.user_id = w.user_id and e.k = w.k + 1) select event_id, user_id, n as n_in_window, n <= 2 as allowed from w")
def rate_limit_fixed_window(spark, sf_dir):
    """R1 with day-long windows, since a user of the table has few events."""
    return i.fixed_window_limit(load(spark, sf_dir, "events"), "user_id", "ts", 86_400, 2)


@query("select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def event_dedupe(spark, sf_dir):
    """The first event of an interaction stays."""
    return load(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


@query(f"{views('cand')} select establishment_id, product_id, min(id) as id from cand where not exists (select 1 from cand o where o.id % 2 = 0 and o.establishment_id = cand.establishment_id and o.product_id = cand.product_id) group by 1, 2")
def insert_ignore(spark, sf_dir):
    x = candidates(spark, sf_dir)
    return c.insert_new(x.where("id % 2 = 0"), x.groupBy("establishment_id", "product_id").agg(F.min("id").alias("id")), ["establishment_id", "product_id"])


_LB = " union all ".join(f"select {n} as days, ts, results from se where ts >= timestamp '2024-01-30' - interval {n} day and ts < timestamp '2024-01-30'" for n in (30, 14, 7))


@query(f"with {_SE} select days, count(*) as n, count(*) filter (where results = 0) as unresolved, count(distinct cast(ts as date)) as active_days from ({_LB}) group by 1")
def look_backs(spark, sf_dir):
    """R3."""
    return i.look_backs(searches(spark, sf_dir), F.lit("2024-01-30").cast("timestamp_ntz"))


@query(f"{views('est', 'prod', 'cand')}, {_SUS} select count(*) as n_rows, count(distinct establishment_id) as n_keys from sus where suspicious")
def affected_rows(spark, sf_dir):
    """G-A20."""
    return i.affected(suspects(spark, sf_dir), F.col("suspicious"))


@query(f"with {_SE} select count(distinct term) as unresolved_terms, max(ts) as last_seen from se where results <= 0 and event_id % 3 <> 0")
def open_demand(spark, sf_dir):
    f = i.failed_events(searches(spark, sf_dir)).select(F.col("term").alias("query"), "ts", (F.col("event_id") % 3 == 0).alias("resolved"))
    return i.open_demand(f)


@query(f"{MERGED_WITH}, {_RF} select unnest(string_split(flags, '|')) as flag, count(*) as n from s where score > 0 group by 1")
def review_flag_totals(spark, sf_dir):
    """G-A11."""
    return i.flag_totals(_flagged(spark, sf_dir))


@query(f"{MERGED_WITH}, k as (select product_id, count(distinct establishment_id) as n from mrg where validation_status <> 'rejected' group by 1) select prod.id as product_id, coalesce(n, 0) as n_stores from prod left join k on product_id = prod.id")
def stores_per_product(spark, sf_dir):
    """G-A12."""
    return i.stores_per_product(merged(spark, sf_dir), products(spark, sf_dir))


@query(f"{MERGED_WITH}, t as (select osm_category, count(*) as n from est group by 1 order by 2 desc, 1 limit 10) select (select count(*) from est) as places, (select count(website) from est) as with_website, (select count(*) from est where opening_hours <> '') as with_hours, (select count(distinct establishment_id) from mrg) as with_products, (select round(avg(cast(confidence as double)), 4) from mrg) as mean_confidence, (select string_agg(osm_category, '|' order by n desc, osm_category) from t) as top_categories")
def coverage(spark, sf_dir):
    """G-A22."""
    return i.coverage(establishments(spark, sf_dir), merged(spark, sf_dir))


_NB = "nb as (select establishment_id, count(*) filter (where source_type = 'rules_generated' and confidence between 0.55 and 0.58) as mid, count(distinct product_id) as merged_total, count(distinct case when product_id % 9 = 0 then product_id end) as pc, count(distinct case when product_id % 11 = 0 then product_id end) as sc from cand group by 1)"


@query(f"{views('est', 'cand')}, {_NB}, dm as (select district, cast(count(*) filter (where id % 40 = 0) as bigint) as u from est group by 1 having count(*) filter (where id % 40 = 0) >= 3) select est.id, coalesce(mid, 0) > 0 or coalesce(merged_total, 0) > 600 + 8 or dm.u is not null as for_candidates, coalesce(pc, 0) >= 8 or coalesce(sc, 0) >= 6 or website is null or dm.u is not null as for_profile from est left join nb on establishment_id = est.id left join dm on dm.district = est.district")
def ambiguous_places(spark, sf_dir):
    """F22; merged rows beyond 600 count here, since a place of the tables has hundreds."""
    x = candidates(spark, sf_dir)
    n = x.groupBy(F.col("establishment_id").alias("id")).agg(
        F.count_if((F.col("source_type") == "rules_generated") & F.col("confidence").between(0.55, 0.58)).alias("rules_mid_conf"), (F.countDistinct("product_id") - 600).alias("merged_total"),
        F.countDistinct(F.when(F.col("product_id") % 9 == 0, F.col("product_id"))).alias("product_candidates"), F.countDistinct(F.when(F.col("product_id") % 11 == 0, F.col("product_id"))).alias("service_candidates"))
    e = establishments(spark, sf_dir).select("id", "district", F.col("website").isNotNull().alias("has_website")).join(n, "id", "left")
    # Demand by two spellings of the district, which count as one.
    d = establishments(spark, sf_dir).groupBy("district", (F.col("id") % 80 == 0).alias("k")).agg(F.count_if(F.col("id") % 40 == 0).alias("unresolved")).select(F.when(F.col("k"), F.concat(F.lit(" "), F.lower("district"), F.lit("!"))).otherwise(F.col("district")).alias("district"), "unresolved")
    return c.ambiguous(e, d).select("id", "for_candidates", "for_profile")


_SL = "sl as (select * from (values ('phone-repair', 'en', ' Phone Repair ', 100), ('phone-repair', 'en', 'phone repair', 70), ('phone-repair', 'de', 'Handyreparatur', 90), ('haircut', 'en', 'Haircut', 100), ('haircut', 'en', '  ', 100), ('nothing', 'en', 'none', 10)) t(slug, lang, alias, priority))"


@query(f"with {_SL}, sv as (select p_partkey as id, case p_partkey % 3 when 0 then 'phone-repair' when 1 then 'haircut' else concat('s', p_partkey) end as slug from part) select id as service_id, lang, lower(trim(alias)) as alias, max(priority) as priority from sv join sl using (slug) where trim(alias) <> '' group by 1, 2, 3")
def service_aliases(spark, sf_dir):
    """S21."""
    listed = [("phone-repair", "en", " Phone Repair ", 100), ("phone-repair", "en", "phone repair", 70), ("phone-repair", "de", "Handyreparatur", 90), ("haircut", "en", "Haircut", 100), ("haircut", "en", "  ", 100), ("nothing", "en", "none", 10)]
    s = load(spark, sf_dir, "part").selectExpr("p_partkey as id", "case p_partkey % 3 when 0 then 'phone-repair' when 1 then 'haircut' else concat('s', p_partkey) end as slug")
    return c.service_aliases(s, spark.createDataFrame(listed, "slug string, lang string, alias string, priority int"))


@query(f"{views('est')}, x as (select id, case when id % 4 = 0 then ['old'] else [] end as old, case when id % 3 = 0 then 'pipeline' else 'manual' end as origin from est) select id, array_to_string(case when len(old) = 0 or origin = 'pipeline' then [osm_category] else old end, '|') as categories from x join est using (id)")
def overwrite_categories(spark, sf_dir):
    """C2."""
    old = F.when(F.col("id") % 4 == 0, F.array(F.lit("old"))).otherwise(F.array().cast("array<string>"))
    return establishments(spark, sf_dir).select("id", F.array_join(c.overwrite_categories(old, F.when(F.col("id") % 3 == 0, "pipeline").otherwise("manual"), F.array("osm_category")), "|").alias("categories"))
