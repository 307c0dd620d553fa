"""Queries of query understanding and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinia.functions import scores, text
from vicinia.functions.hours import opening_status
from vicinia.operators import search as s
from vicinia.operators.insights import stage_counts
from vicinia.plans.merging import _SR, MERGED_WITH, merged
from vicinia.plans.registry import Registry
from vicinia.plans.text_geo import _TOK, NORM, hav, sql_exists, sql_phrase
from vicinia.sources.scratch import built
from vicinia.sources.tables import candidates, establishments, load, products, views

query = Registry()
LEX = s.Lexicon(generic=["misc"], broad=["food", "snow"], typos={}, service_parts=["repair", "mending"], service_words=["haircut"], service_verbs=["fix", "mend"], service_objects=["phone", "bike"], location_words=["near", "me", "in"])
QUERIES_ = ["blue anvil", "blue", "cold bolts", "light", "large gear", "ring", "snow", "misc", "fix my phone", "phone repair", "haircut", "gizmoo", "hot plate xl", "rod", "dim widget"]
VALUES = "q(query) as (values " + ", ".join(f"('{x}')" for x in QUERIES_) + ")"


def _queries(spark):
    return spark.createDataFrame([(x,) for x in QUERIES_], "query string")


_SPECIFIC = f"(query not in ('misc', 'food', 'snow') and case when len({_TOK.format('query')}) = 1 then length(query) >= 5 else {sql_exists(_TOK.format('query'), 'x', 'length(x) >= 4')} end)"
_SERVICE = f"(contains(query, 'repair') or contains(query, 'mending') or (len({_TOK.format('query')}) = 1 and query = 'haircut') or ({sql_exists(_TOK.format('query'), 'x', chr(120) + ' in (' + chr(39) + 'fix' + chr(39) + ', ' + chr(39) + 'mend' + chr(39) + ')')} and {sql_exists(_TOK.format('query'), 'x', chr(120) + ' in (' + chr(39) + 'phone' + chr(39) + ', ' + chr(39) + 'bike' + chr(39) + ')')}))"


@query(f"with {VALUES} select query, {_SPECIFIC} as is_specific, {_SERVICE} as is_service from q")
def intent_specific_and_service(spark, sf_dir):
    return _queries(spark).select("query", s.is_specific(F.col("query"), LEX).alias("is_specific"), s.is_service(F.col("query"), LEX).alias("is_service"))


@query("with r as (select item_id, text as o, case when item_id % 4 = 0 then '' else substr(text, 1, length(text) - cast(item_id % 7 as bigint)) end as r, (item_id % 10) / 10e0 as c, case when item_id % 3 = 0 then 'unknown' else 'product' end as i, item_id % 2 as k, item_id % 5 <> 0 as m from benchmark) select item_id, case when m and r <> '' and (c >= 0.6 or (c >= 0.45 and abs(length(r) - length(o)) <= 4 and (i <> 'unknown' or k > 0))) then r else o end as effective from r")
def effective_query(spark, sf_dir):
    r = load(spark, sf_dir, "benchmark").selectExpr("item_id", "text as o", "case when item_id % 4 = 0 then '' else substr(text, 1, cast(length(text) - item_id % 7 as int)) end as r", "(item_id % 10) / 10e0 as c", "case when item_id % 3 = 0 then 'unknown' else 'product' end as i", "item_id % 2 as k", "item_id % 5 <> 0 as m")
    return r.select("item_id", s.effective_query(*map(F.col, "orcikm")).alias("effective"))


CATEGORY_TERMS = [("tools", "fix phone"), ("tools", "phone repair"), ("colors", "blue"), ("colors", "red"), ("air", "dark smog"), ("air", "smog")]
_CT = "t(category, term) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in CATEGORY_TERMS) + ")"


@query(f"with {VALUES}, {_CT} select distinct query, category from q, t where term = query or len(list_filter({_TOK.format('term')}, lambda w: not list_contains({_TOK.format('query')}, w))) = 0")
def category_intents(spark, sf_dir):
    return s.category_intents(_queries(spark), spark.createDataFrame(CATEGORY_TERMS, "category string, term string"))


def _vocabulary(spark, sf_dir):
    return products(spark, sf_dir).select(F.col("product_group").alias("group"), F.col("normalized_name").alias("term")).distinct()


_VOC = "v as (select distinct lower(p_type) as grp, lower(p_name) as term from part), w as (select grp, unnest(string_split(term, ' ')) as word from v)"
_QW = "qw as (select query, unnest(string_split(query, ' ')) as w from q)"


@query(f"with {VALUES}, {_VOC}, {_QW} select distinct query, grp as \"group\" from (select query, grp from q join v on term = query union all select query, grp from qw join w on word = w.word and qw.w = w.word union all select query, grp from qw join w on length(qw.w) >= 3 and length(word) >= length(substr(qw.w, 1, 6)) and substr(word, 1, length(substr(qw.w, 1, 6))) = substr(qw.w, 1, 6) and length(word) >= 3)")
def vocab_candidate_groups(spark, sf_dir):
    return s.candidate_groups(_queries(spark), s.vocabulary_index(_vocabulary(spark, sf_dir)))


_BROAD = "(term in ('food', 'snow'))"
_MULTI = f"(case when len({_TOK.format('term')}) > 1 then 1 else 0 end)"
_QMULTI = f"(case when len({_TOK.format('query')}) > 1 then 1 else 0 end)"
_BASE = f"(case when query = term then case when {_BROAD} then 4 else 8 end when contains(query, term) or contains(term, query) then case when {_BROAD} then 2 else 5 end when {sql_phrase('query', 'term')} then case when {_BROAD} then 1 else 3 end else 0 end)"
_TS = f"(case when {_BASE} > 0 then {_BASE} + 2 * {_MULTI} + {_MULTI} * {_QMULTI} - case when {_BROAD} then 1 else 0 end else 0 end)"
_GROUPS = vocab_candidate_groups and query.oracles["vocab_candidate_groups"].split("select distinct query, grp", 1)[1]


@query(f"with {VALUES}, {_VOC}, {_QW}, sc as (select distinct query, grp{_GROUPS.replace('as ' + chr(34) + 'group' + chr(34), '')}), a as (select query, grp, {_TS} as s from sc join v using (grp) join q using (query)), b as (select query, grp, max(s) + least(count(*) - 1, 2) as score from a where s > 0 group by 1, 2), c as (select query, grp, {_TS} as s from q, v where query not in (select query from b)), d as (select * from b union all select query, grp, max(s) + least(count(*) - 1, 2) from c where s > 0 group by 1, 2), e as (select *, max(score) over (partition by query) as top, row_number() over (partition by query order by score desc, grp) as rn from d) select query, grp as \"group\", cast(score as integer) as score from e where score >= greatest(2, top - 3) and rn <= case when len({_TOK.format('query')}) = 1 and length(query) < 5 then 1 else 4 end")
def infer_product_groups(spark, sf_dir):
    return s.infer_groups(_queries(spark), _vocabulary(spark, sf_dir), ["food", "snow"])


_TIER = f"case when query = name then 1 when contains(query, name) or contains(name, query) then 2 when {sql_phrase('query', 'name')} then 3 end"


@query(f"with {VALUES}, n as (select p_partkey as product_id, lower(p_name) as name from part), t as (select query, product_id, {_TIER} as tier from q, n), f as (select *, min(tier) over (partition by query) as first from t where tier is not null) select query, product_id, tier from f where tier = first")
def match_products_tiered(spark, sf_dir):
    return s.match_products(_queries(spark), products(spark, sf_dir).select(F.col("id").alias("product_id"), F.col("normalized_name").alias("name")))


_SHARED = sql_exists(_TOK.format("query"), "x", f"length(x) >= 3 and list_contains({_TOK.format('name')}, x)")
_SS = f"(case when query = name then 100 else 0 end + case when contains(query, name) or contains(name, query) then 40 else 0 end + case when {sql_phrase('query', 'name')} then 22 else 0 end + case when {_SHARED} then 10 else 0 end + case when contains(query, 'repair') and contains(name, 'repair') then 3 else 0 end)"


@query(f"with {VALUES}, n as (select p_partkey as service_id, lower(p_name) as name from part), t as (select query, service_id, {_SS} as score from q, n), f as (select *, max(score) over (partition by query) as top, row_number() over (partition by query order by score desc, service_id) as rn from t) select query, service_id, score from f where score >= greatest(14, top - 40) and rn <= 24")
def match_services_scored(spark, sf_dir):
    return s.match_services(_queries(spark), products(spark, sf_dir).select(F.col("id").alias("service_id"), F.col("normalized_name").alias("name")))


_DUP = "select group_ as \"group\", term, n from (select lower(p_type) as group_, lower(p_name) as term, count(*) as n from part group by 1, 2) where n > 8"


@query(_DUP)
def vocab_lint(spark, sf_dir):
    """G-A24: terms that repeat within a group."""
    return products(spark, sf_dir).groupBy(F.col("product_group").alias("group"), F.col("normalized_name").alias("term")).agg(F.count("*").alias("n")).where("n > 8")


SERVING_WITH = f"{MERGED_WITH}, srv as (select mrg.*, est.name, district, lat, lon, osm_category, app_category, freshness as est_freshness, opening_hours, website, normalized_name, product_group, priority from mrg join est on est.id = establishment_id join prod on prod.id = product_id where validation_status <> 'rejected' and active_status in ('active', 'temporarily_closed') and not closed_candidate and duplicate_of is null)"


def _made(spark, sf_dir):
    return s.serving(merged(spark, sf_dir), establishments(spark, sf_dir), products(spark, sf_dir))


def _serving(spark, sf_dir):
    """The serving dataset as searches read it: a table sorted by place that is written once, so a box or a store reaches the scan."""
    return built(spark, "serving", sf_dir, lambda: _made(spark, sf_dir), s.write_serving)


@query(f"{SERVING_WITH} select establishment_id, product_id, district, normalized_name, product_group, confidence, validation_status from srv")
def serving_dataset(spark, sf_dir):
    return _made(spark, sf_dir).select("establishment_id", "product_id", "district", "normalized_name", "product_group", "confidence", "validation_status")


@query(f"{SERVING_WITH} select (select count(*) from cand) as candidates, (select count(*) from mrg) as merged, (select count(*) from srv) as serving, (select count(distinct establishment_id) from srv) as stores, (select count(*) from est where website is not null) as with_website")
def serving_counts(spark, sf_dir):
    """G-A19."""
    return stage_counts(candidates(spark, sf_dir), merged(spark, sf_dir), _made(spark, sf_dir), establishments(spark, sf_dir))


Q, LAT, LON, R = "blue anvil", 52.5, 13.4, 9000.0
_BOX = "lat between 52.5e0 - 9000e0/111320e0 and 52.5e0 + 9000e0/111320e0 and abs(lon - 13.4e0) <= 9000e0 / (111320e0 * cos(radians(52.5e0)))"
_MIN = "case primary_source when 'merchant_added' then 0 when 'website_extracted' then 0.33 when 'ai_generated' then 0.44 when 'rules_generated' then 0.53 else 0.28 end"
_NC = "(contains(normalized_name, 'blue anvil') or contains('blue anvil', normalized_name))"
_RANK = f"case when normalized_name = 'blue anvil' then 100000 when {_NC} then 50000 when {sql_phrase(chr(39) + 'blue anvil' + chr(39), 'normalized_name')} then 8000 else 0 end + 2000 * cast(confidence as double) + case validation_status when 'validated' then 1500 when 'likely' then 700 when 'rejected' then -10000 else 0 end + 230 * {_SR.format('primary_source')} + 280 * est_freshness - case when osm_category in ('mall', 'department_store') then 1800 else 0 end - m - 2"
_FP = "concat(trim(regexp_replace(lower(name), '\\s+', ' ', 'g')), '|', cast(floor(lat * 10000 + 0.5) as bigint), '|', cast(floor(lon * 10000 + 0.5) as bigint))"
_SEARCH = f"{SERVING_WITH}, pre as (select * from srv where {_BOX} order by confidence desc, last_checked_at desc, establishment_id, product_id limit 450), hit as (select *, case when product_id in (3, 7, 12) then 2 when product_group in ('promo', 'economy', 'standard', 'small', 'large', 'medium') then 1 when contains(normalized_name, 'blue anvil') then 0 end as strategy, {hav('52.5e0', '13.4e0', 'lat', 'lon')} as m from pre), ok as (select * from hit where strategy is not null and (strategy > 0 or (select count(*) from hit where strategy > 0) < 110) and confidence >= {_MIN} and m <= 9000), rk as (select *, {_RANK} as rank from ok), dd as (select *, row_number() over (partition by {_FP} order by rank desc, establishment_id, product_id) as rn from rk)"


@query(f"{_SEARCH} select establishment_id, product_id, round(m, 1) as distance_m, round(rank, 2) as rank, strategy from dd where rn = 1 order by dd.rank desc, establishment_id, product_id limit 80")
def search_topk(spark, sf_dir):
    """Q10 end to end over the serving dataset."""
    groups = ["promo", "economy", "standard", "small", "large", "medium"]
    r = s.search(_serving(spark, sf_dir), Q, LAT, LON, R, product_ids=[3, 7, 12], groups=groups, lex=LEX)
    return r.select("establishment_id", "product_id", F.round("distance_m", 1).alias("distance_m"), F.round("rank", 2).alias("rank"), "strategy")


@query(f"{SERVING_WITH}, m as (select *, {hav('52.5e0', '13.4e0', 'lat', 'lon')} as m from srv), rk as (select *, {_RANK} as rank from m where m <= 9000) select establishment_id, product_id, round(rank, 2) as rank from rk")
def product_rank(spark, sf_dir):
    return s.rank_products(_serving(spark, sf_dir), Q, LAT, LON, R).select("establishment_id", "product_id", F.round("rank", 2).alias("rank"))


@query(f"{SERVING_WITH}, m as (select *, {hav('52.5e0', '13.4e0', 'lat', 'lon')} as m from srv), rk as (select *, {_RANK} as rank from m where m <= 9000), dd as (select *, row_number() over (partition by {_FP} order by rank desc, establishment_id, product_id) as rn from rk) select establishment_id, product_id from dd where rn = 1")
def dedupe_results(spark, sf_dir):
    from vicinia.operators.merging import dedupe_ranked

    return dedupe_ranked(s.rank_products(_serving(spark, sf_dir), Q, LAT, LON, R)).select("establishment_id", "product_id")


@query(f"{MERGED_WITH} select establishment_id, product_id, confidence from mrg where confidence >= {_MIN}")
def min_confidence_filter(spark, sf_dir):
    return merged(spark, sf_dir).where(F.col("confidence") >= scores.min_confidence(F.col("primary_source"))).select("establishment_id", "product_id", "confidence")


_GUARD = f"case when contains(normalized_name, 'blue') then true when osm_category = 'beauty' and not contains(lower(name), 'rossmann') and not trusted then false when strategy = 'canonical' then case when validation_status = 'rejected' then false when fit and confidence >= 0.55 then true else trusted and confidence >= 0.85 end when product_group = 'promo' and not trusted then false when fit and confidence >= 0.78 and validation_status <> 'rejected' then true else trusted and confidence >= 0.9 and (fit or confidence >= 0.97) end"


@query(f"{MERGED_WITH}, g as (select mrg.*, normalized_name, product_group, osm_category, est.name, primary_source = 'merchant_added' or validation_status = 'validated' as trusted, establishment_id % 3 <> 0 as fit, case when product_id % 2 = 0 then 'canonical' else 'group' end as strategy from mrg join est on est.id = establishment_id join prod on prod.id = product_id) select establishment_id, product_id, {_GUARD} as keep from g")
def group_fallback_guard(spark, sf_dir):
    c = F.col
    e = establishments(spark, sf_dir).select(F.col("id").alias("establishment_id"), "name", "osm_category")
    p = products(spark, sf_dir).select(F.col("id").alias("product_id"), "normalized_name", "product_group")
    g = merged(spark, sf_dir).join(e, "establishment_id").join(p, "product_id")
    trusted = (c("primary_source") == "merchant_added") | (c("validation_status") == "validated")
    keep = s.fallback_guard(F.lit(True), c("normalized_name").contains("blue"), s.service_only_place(c("osm_category"), F.lit(None).cast("string"), ["beauty"], [], []), text.normalize(c("name")).contains("rossmann"), trusted, F.when(c("product_id") % 2 == 0, "canonical").otherwise("group"), c("validation_status") == "rejected", c("establishment_id") % 3 != 0, c("confidence"), c("product_group") == "promo", F.lit(False))
    return g.select("establishment_id", "product_id", keep.alias("keep"))


_SRANK = f"case when normalized_name = 'blue anvil' then 92000 when {_NC} then 46000 when {sql_phrase(chr(39) + 'blue anvil' + chr(39), 'normalized_name')} then 8000 else 0 end + 2000 * cast(confidence as double) + case validation_status when 'validated' then 1500 when 'likely' then 700 else 0 end + 220 * {_SR.format('primary_source')} - m - 2"


@query(f"{SERVING_WITH}, m as (select *, {hav('52.5e0', '13.4e0', 'lat', 'lon')} as m from srv where confidence >= 0.7 and (primary_source <> 'rules_generated' or confidence >= 0.78) and establishment_id % 5 <> 0) select establishment_id, product_id, round({_SRANK}, 2) as rank from m where m <= 9000 order by {_SRANK} desc, establishment_id, product_id limit 80")
def service_fallback(spark, sf_dir):
    v = _serving(spark, sf_dir)
    return s.service_fallback(v, v.where("establishment_id % 5 = 0"), Q, LAT, LON, R).select("establishment_id", "product_id", F.round("rank", 2).alias("rank"))


@query(f"{views('est')}, m as (select *, {hav('52.5e0', '13.4e0', 'lat', 'lon')} as m from est where app_category in ('groceries', 'household')) select id, round(22000 - m, 2) as rank, 0.72e0 as confidence from m where m <= 9000 order by m, id limit 24")
def category_store_fallback(spark, sf_dir):
    return s.category_fallback(establishments(spark, sf_dir), ["groceries", "household"], LAT, LON, R).select("id", F.round("rank", 2).alias("rank"), "confidence")


@query(f"{views('est')}, m as (select {hav('52.5e0', '13.4e0', 'lat', 'lon')} as m from est), n as (select min(m) as nearest from m where m <= 15000) select round(nearest, 1) as nearest_m, least(15e0, greatest(0.5e0, ceil((nearest / 1000 + 0.2e0) / 0.5e0) * 0.5e0, 1.5e0)) as suggested_km, case when nearest is null then 'catalog_gap' else 'expand_radius' end as advice from n")
def no_result_guidance(spark, sf_dir):
    return s.no_result_guidance(establishments(spark, sf_dir), LAT, LON, 1.0).withColumn("nearest_m", F.round("nearest_m", 1))


_STRAT = "case when product_id in (3, 7, 12) then 2 when product_group = 'promo' then 1 when contains(normalized_name, 'blue') then 0 end"


@query(f"{SERVING_WITH}, t as (select *, {_STRAT} as strategy from srv) select establishment_id, product_id, strategy from t where strategy is not null and (strategy > 0 or (select count(*) from t where strategy > 0) < 110)")
def strategy_cascade(spark, sf_dir):
    return s.cascade(_serving(spark, sf_dir), [], [3, 7, 12], ["promo"], "blue").select("establishment_id", "product_id", "strategy")


@query(f"{SERVING_WITH}, o as (select * from srv where establishment_id = 4 order by confidence desc, product_id limit 500) select establishment_id, name, district, string_agg(concat(product_id, ':', normalized_name), '|' order by product_id) as offers from o group by 1, 2, 3")
def store_detail(spark, sf_dir):
    d = s.store_detail(_serving(spark, sf_dir), 4)
    return d.select("establishment_id", "name", "district", F.array_join(F.transform("offers", lambda o: F.concat(o["product_id"].cast("string"), F.lit(":"), o["normalized_name"])), "|").alias("offers"))


@query(f"{views('prod')} select id, normalized_name from prod where normalized_name ilike '%blue%' or alias ilike '%blue%' order by normalized_name, id limit 50")
def canonical_search(spark, sf_dir):
    return s.catalog_search(products(spark, sf_dir), "b%lue", ["normalized_name", "alias"]).select("id", "normalized_name")


@query(f"{views('est')} select id, name, (select count(*) from est) as total from est order by name, id limit 20 offset 40")
def establishment_page(spark, sf_dir):
    return s.page(establishments(spark, sf_dir), ["name", "id"], 40, 20).select("id", "name", "total")


@query(f"{views('est', 'cand')}, k as (select establishment_id, count(distinct product_id) as n from cand group by 1) select id, lat, lon, coalesce(n, 0) as n_products from est left join k on id = establishment_id where active_status = 'active' and district ilike '%1%' and contains(app_category, 'o') order by id desc limit 200")
def map_points(spark, sf_dir):
    k = candidates(spark, sf_dir).groupBy(F.col("establishment_id").alias("id")).agg(F.countDistinct("product_id").alias("n_products"))
    return s.map_points(establishments(spark, sf_dir), k, "1", "o", 100).select("id", "lat", "lon", "n_products")


_T2 = "t as (select p_partkey as id, lower(p_name) as term, p_size as priority from part)"


@query(f"with {VALUES}, {_T2}, j as (select query, term, priority, row_number() over (partition by query order by priority desc, term) as rn from q join t on query = term or (length(query) >= 4 and length(term) >= 4 and (contains(query, term) or contains(term, query)))) select query, term, priority from j where rn <= 3")
def demand_term_mapping(spark, sf_dir):
    return s.theta_terms(_queries(spark), products(spark, sf_dir).select(F.col("normalized_name").alias("term"), "priority"))


@query(f"with {VALUES}, {_T2} select distinct query, term from q join t on {sql_phrase('query', 'term')}")
def fuzzy_term_join(spark, sf_dir):
    """N16 over all terms."""
    return s.fuzzy_terms(_queries(spark), products(spark, sf_dir).select(F.col("normalized_name").alias("term")).distinct())


@query(f"{SERVING_WITH}, m as (select *, {hav('52.5e0', '13.4e0', 'lat', 'lon')} as m from srv), x as (select establishment_id, product_id, district, case when product_id % 5 = 0 then 2 else 0 end + case when contains(normalized_name, 'blue') then 2 else 0 end + least(1.2e0, cast(confidence as double)) + case when primary_source = 'merchant_added' then 1 else 0 end + greatest(0, 1 - m / 3000) as score from m), r as (select *, row_number() over (partition by district order by score desc, establishment_id, product_id) as rn from x) select district, count(*) as n, round(avg(score), 4) as mean_score, count(*) filter (where score >= 3) as hits from r where rn <= 12 group by district")
def benchmark_hit_rate(spark, sf_dir):
    """Q14, G-A21: top 12 by score per persona (district), and how many of them hit."""
    from pyspark.sql import Window

    from vicinia.functions.geo import haversine

    c = F.col
    score = s.benchmark_score(c("product_id") % 5 == 0, c("normalized_name").contains("blue"), c("confidence").cast("double"), c("primary_source") == "merchant_added", haversine(F.lit(LAT), F.lit(LON), c("lat"), c("lon")))
    r = _serving(spark, sf_dir).withColumn("score", score).withColumn("rn", F.row_number().over(Window.partitionBy("district").orderBy(F.col("score").desc(), "establishment_id", "product_id")))
    return r.where("rn <= 12").groupBy("district").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.count_if(F.col("score") >= 3).alias("hits"))


#: Moments in UTC with what a clock in Berlin shows: day of the week (0 Monday) and minute of the day; the last is just before summer time.
MOMENTS = [("2024-01-15 10:30:00", 0, 690), ("2024-01-19 23:30:00", 5, 30), ("2024-01-20 00:30:00", 5, 90), ("2024-01-17 11:30:00", 2, 750), ("2024-03-31 00:30:00", 6, 90), ("2024-06-21 18:30:00", 4, 1230)]
_MOMENTS = "mo(moment, dow, m) as (values " + ", ".join(f"(timestamp '{a}', {d}, {m})" for a, d, m in MOMENTS) + ")"
_DOW = "cast((instr('motuwethfrsasu', {0}) - 1) / 2 as integer)"
_MIN_OF = "cast(string_split({0}, ':')[1] as integer) * 60 + cast(string_split({0}, ':')[2] as integer)"
#: The rule for the forms of the table: rules at semicolons, days before the first time, spans after it, each past midnight if it ends before it starts.
_HOURS = f"""{views('est')}, {_MOMENTS}, ru as (select id, trim(unnest(string_split(opening_hours, ';'))) as r from est),
rs as (select id, lower(regexp_extract(r, '^([A-Za-z, -]*)', 1)) as days, regexp_replace(r, '^[A-Za-z, -]*', '') as spans from ru where regexp_matches(r, '[0-9]:[0-9]')),
dd as (select id, days, spans, trim(unnest(string_split(days, ','))) as d from rs),
de as (select id, days, spans, {_DOW.format("substr(d, 1, 2)")} as a, {_DOW.format("case when contains(d, '-') then substr(trim(string_split(d, '-')[2]), 1, 2) else substr(d, 1, 2) end")} as b from dd),
sp as (select id, a, b, trim(unnest(string_split(spans, ','))) as s from de),
se as (select id, a, (b - a + 7) % 7 as more, {_MIN_OF.format("string_split(s, '-')[1]")} as f, {_MIN_OF.format("string_split(s, '-')[2]")} as t from sp),
hit as (select distinct id, moment from se, mo where case when t <= f then ((dow - a + 7) % 7 <= more and m >= f) or ((dow - 1 - a + 14) % 7 <= more and m < t) else (dow - a + 7) % 7 <= more and m >= f and m < t end),
st as (select est.id, mo.moment, case when trim(opening_hours) = '' then 'unknown' when contains(opening_hours, '24/7') then 'open' when hit.id is not null then 'open' when regexp_matches(opening_hours, '[0-9]:[0-9]') or regexp_matches(lower(opening_hours), '\\b(off|closed)\\b') then 'closed' else 'unknown' end as status from est cross join mo left join hit on hit.id = est.id and hit.moment = mo.moment)"""


@query(f"{_HOURS} select id, moment, status from st")
def opening_status_by_time(spark, sf_dir):
    moment = F.explode(F.array(*[F.lit(t).cast("timestamp_ntz") for t, _, _ in MOMENTS]))
    return establishments(spark, sf_dir).withColumn("moment", moment).select("id", "moment", opening_status(F.col("opening_hours"), F.col("moment").cast("timestamp")).alias("status"))


@query(f"{_HOURS} select id, status from st where moment = timestamp '{MOMENTS[0][0]}'")
def opening_status_now(spark, sf_dir):
    """D10 on a Monday at 10:30 UTC in winter."""
    return establishments(spark, sf_dir).select("id", opening_status(F.col("opening_hours"), F.lit(MOMENTS[0][0]).cast("timestamp")).alias("status"))


@query(f"{SERVING_WITH}, m as (select *, {hav('52.5e0', '13.4e0', 'lat', 'lon')} as m from srv) select establishment_id, product_id, round(m, 1) as distance_m from m where m <= 9000 order by m.m, establishment_id, product_id limit 180")
def nearest_first(spark, sf_dir):
    """L9."""
    return s.nearest(_serving(spark, sf_dir), LAT, LON, R).select("establishment_id", "product_id", F.round("distance_m", 1).alias("distance_m"))


@query(f"{views('est')}, f as (select * from est where freshness >= 0.2 and seen_days <= 80 and app_category in ('groceries', 'household') and (name ilike '%market%' or contains(osm_category, 'o')) and enrich_days is not null and active_status <> 'inactive') select id, name, website, (select count(*) from f) as total from f order by website desc nulls last, name nulls first, id limit 40 offset 5")
def table_scan(spark, sf_dir):
    """S10."""
    tests = [("freshness", "gte", 0.2), ("seen_days", "lte", 80), ("app_category", "in", ["groceries", "household"]), ("or", [("name", "ilike", "%market%"), ("osm_category", "contains", "o")]), ("enrich_days", "not_null"), ("active_status", "neq", "inactive")]
    return s.scan(establishments(spark, sf_dir), ["id", "name", "website"], tests, [("website", True, False), ("name", False, True), ("id", False, True)], 5, 40, count=True)


@query(f"{views('cand')} select id, establishment_id from cand where id > 2000000000 order by id limit 500")
def keyset_batch(spark, sf_dir):
    """S12."""
    return s.after(candidates(spark, sf_dir), "id", 2_000_000_000, 500).select("id", "establishment_id")


_STATUS = "case id % 3 when 0 then 'open' when 1 then 'closed' else 'unknown' end"


def _shown(spark, sf_dir):
    e = establishments(spark, sf_dir).selectExpr("id as establishment_id", f"{_STATUS} as status", "(id * 37) % 1000 as distance_m", "id % 11 as rank", "case when id % 4 = 0 then 'independent' else 'chain' end as ownership")
    return e, e.where("establishment_id % 2 = 0").select("establishment_id")


@query(f"{views('est')} select id as establishment_id from est where {_STATUS} = 'open' and id % 2 = 0 and id % 4 = 0")
def result_filters(spark, sf_dir):
    """F21."""
    e, saved = _shown(spark, sf_dir)
    return s.result_filters(e, True, saved, True).select("establishment_id")


@query(f"{views('est')} select id as establishment_id, {_STATUS} as status from est order by case {_STATUS} when 'open' then 0 when 'unknown' then 1 else 2 end, (id * 37) % 1000, id % 11 desc, id limit 30")
def display_order(spark, sf_dir):
    """L6."""
    return s.display_order(_shown(spark, sf_dir)[0], 30).select("establishment_id", "status")


@query(f"{SERVING_WITH} select establishment_id, product_id from srv where false")
def generic_query(spark, sf_dir):
    """a generic query finds nothing."""
    return s.search(_serving(spark, sf_dir), "misc", LAT, LON, R, lex=LEX).select("establishment_id", "product_id")


@query(f"{MERGED_WITH} select establishment_id, product_id, contains(normalized_name, 'blue') and (primary_source = 'merchant_added' or mrg.validation_status = 'validated') and confidence >= 0.86 as keep from mrg join prod on prod.id = product_id")
def service_intent_products(spark, sf_dir):
    """F11."""
    p = products(spark, sf_dir).select(F.col("id").alias("product_id"), "normalized_name")
    trusted = (F.col("primary_source") == "merchant_added") | (F.col("validation_status") == "validated")
    return merged(spark, sf_dir).join(p, "product_id").select("establishment_id", "product_id", s.keep_under_service_intent(F.col("normalized_name").contains("blue"), trusted, F.col("confidence")).alias("keep"))


@query("select item_id, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(strip_accents(lower(text)), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda x: x <> '' and x not in ('near', 'me', 'in'))[1:4], ' ') as query from benchmark")
def sanitized_query(spark, sf_dir):
    """Q9."""
    return load(spark, sf_dir, "benchmark").select("item_id", s.sanitize(F.col("text"), LEX).alias("query"))


RELATED = [("anvil", ["hammer", "forge"]), ("blue", ["azure", "blue anvil", "hammer"]), ("light", ["lamp"]), ("b", ["bolt"])]
QUICK = ["blue bolt", "hammer", "red ring", "cold gear"]
_NAMED = "case when p_partkey % 9 = 0 then ' ' when p_partkey % 5 = 0 then concat('  ', upper(p_name), '!') else p_name end"
_HINTED = "list_concat(" + ", ".join(f"case when contains(q, '{t}') then {xs} else [] end" for t, xs in RELATED) + ")"


@query(f"with n as (select p_partkey, substr({NORM.format(_NAMED)}, 1, 64) as q from part), l as (select p_partkey, q, list_concat({_HINTED}, list_filter({QUICK}, lambda x: x <> q)) as a from n) select p_partkey, case when q = '' then array_to_string({QUICK[:3]}, '|') else array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i)[1:4], '|') end as terms from l")
def related_terms(spark, sf_dir):
    """T14 for all names of the catalogue, some blank, some shouted."""
    return load(spark, sf_dir, "part").select("p_partkey", F.array_join(text.related_terms(F.expr(_NAMED), RELATED, QUICK), "|").alias("terms"))


@query("select user_id, case when p > 0 and s > 0 then 'products_plus_services' when p > 0 then 'products_only' else 'services_fallback_only' end as mode from (select user_id, count(*) filter (where event_type = 'purchase') as p, count(*) filter (where event_type = 'click') as s from events group by 1)")
def result_modes(spark, sf_dir):
    """P3."""
    n = lambda t: F.count_if(F.col("event_type") == t)
    return load(spark, sf_dir, "events").groupBy("user_id").agg(n("purchase").alias("p"), n("click").alias("s")).select("user_id", scores.result_mode(F.col("p"), F.col("s")).alias("mode"))
