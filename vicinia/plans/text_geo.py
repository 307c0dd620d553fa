"""Queries of the text, geo and score functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinia.functions import geo, scores, text
from vicinia.plans.registry import Registry
from vicinia.sources.tables import establishments, load, products, views

query = Registry()
ORIGIN = (52.5, 13.4, 9000.0)

_HAV = "2e0 * 6371000e0 * atan2(sqrt(h), sqrt(1e0 - h))"


def _h(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = _h(lat1, lon1, lat2, lon2)
    return f"(2e0 * 6371000e0 * atan2(sqrt({h}), sqrt(1e0 - ({h}))))"


NORM = "trim(regexp_replace(regexp_replace(strip_accents(lower({0})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"{views('est')}, d as (select *, {hav('52.5e0', '13.4e0', 'lat', 'lon')} as m from est) select id, round(m, 2) as distance_m from d where m <= 9000")
def geo_radius_search(spark, sf_dir):
    return geo.within_radius(establishments(spark, sf_dir), *ORIGIN).select("id", F.round("distance_m", 2).alias("distance_m"))


@query(f"{views('est')} select id, district from est where lat between 52.5e0 - 9000e0/111320e0 and 52.5e0 + 9000e0/111320e0 and abs(lon - 13.4e0) <= 9000e0 / (111320e0 * cos(radians(52.5e0)))")
def geo_bbox_prefilter(spark, sf_dir):
    e = establishments(spark, sf_dir).where(geo.valid_point(F.col("lat"), F.col("lon")))
    return geo.in_box(e, geo.box(*ORIGIN)).select("id", "district")


@query(f"{views('est')}, d as (select id, {hav('52.5e0', '13.4e0', 'lat', 'lon')} as m from est) select id, cast(case when m <= 0 then 0 else greatest(1, floor(m * 1.3e0 / 80 + 0.5)) end as integer) as walk_min, cast(case when m <= 0 then 0 else greatest(1, floor(m * 1.2e0 / (14000e0 / 60) + 0.5)) end as integer) as bike_min from d")
def geo_travel_minutes(spark, sf_dir):
    m = geo.haversine(F.lit(52.5), F.lit(13.4), F.col("lat"), F.col("lon"))
    return establishments(spark, sf_dir).select("id", geo.travel_minutes(m, "walk").alias("walk_min"), geo.travel_minutes(m, "bike").alias("bike_min"))


@query(f"{views('est')}, d as (select id, (id % 9) * 0.5e0 + 0.5e0 as km, {hav('52.5e0', '13.4e0', 'lat', 'lon')} as m from est) select id, least(15e0, greatest(0.5e0, ceil((m / 1000 + 0.2e0) / 0.5e0) * 0.5e0, km + 0.5e0)) as suggested_km, least(15e0, ceil(greatest(km + 1, km * 1.5e0) / 0.5e0) * 0.5e0) as next_km from d")
def geo_radius_suggestion(spark, sf_dir):
    m = geo.haversine(F.lit(52.5), F.lit(13.4), F.col("lat"), F.col("lon"))
    km = (F.col("id") % 9) * F.lit(0.5) + 0.5
    return establishments(spark, sf_dir).select("id", geo.suggested_radius_km(m, km).alias("suggested_km"), geo.expanded_radius_km(km).alias("next_km"))


_CUST = "52.3383e0 + ((c_custkey * 7919) % 10007) * 0.3372e0 / 10007 as lat, 13.0884e0 + ((c_custkey * 104729) % 10009) * 0.6728e0 / 10009 as lon"


@query(f"with p as (select c_custkey as id, {_CUST} from customer), q as (select a.id as id1, b.id as id2, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} as m from p a join p b on a.id < b.id and abs(a.lat - b.lat) < 0.01) select id1, id2, round(m, 2) as distance_m from q where m <= 400")
def geo_near_duplicate_pairs(spark, sf_dir):
    p = load(spark, sf_dir, "customer").selectExpr("c_custkey as id", *_CUST.split(", ", 1)[0:0], _CUST.split(" as lat, ")[0] + " as lat", _CUST.split(" as lat, ")[1].removesuffix(" as lon") + " as lon")
    return geo.near_pairs(p, 400.0).select("id1", "id2", F.round("distance_m", 2).alias("distance_m"))


@query(f"{views('est')} select min(lat) as south, max(lat) as north, min(lon) as west, max(lon) as east from est where {hav('52.5e0', '13.4e0', 'lat', 'lon')} <= 9000")
def geo_envelope(spark, sf_dir):
    return geo.envelope(geo.within_radius(establishments(spark, sf_dir), *ORIGIN))


@query(f"{views('est')} select id, floor(lat * 10000 + 0.5) as lat_key, floor(lon * 10000 + 0.5) as lon_key, round((52.5e0 + lat) / 2, 6) as mid_lat, round((13.4e0 + lon) / 2 + 0.06e0 * (lat - 52.5e0), 6) as mid_lon from est")
def geo_keys_and_route(spark, sf_dir):
    route = geo.fallback_route(F.lit(52.5), F.lit(13.4), F.col("lat"), F.col("lon"))
    return establishments(spark, sf_dir).select("id", geo.rounded_key(F.col("lat")).cast("double").alias("lat_key"), geo.rounded_key(F.col("lon")).cast("double").alias("lon_key"), F.round(route[1]["lat"], 6).alias("mid_lat"), F.round(route[1]["lon"], 6).alias("mid_lon"))


@query(f"{views('est')}, a as (select id, 52.5e0 as la, 13.4e0 as lo, (52.5e0 + lat) / 2 as lb, (13.4e0 + lon) / 2 + 0.06e0 * (lat - 52.5e0) as lp, lat, lon from est) select id, round({hav('la', 'lo', 'lb', 'lp')} + {hav('lb', 'lp', 'lat', 'lon')}, 2) as route_m from a")
def geo_path_length(spark, sf_dir):
    route = geo.fallback_route(F.lit(52.5), F.lit(13.4), F.col("lat"), F.col("lon"))
    return establishments(spark, sf_dir).select("id", F.round(geo.path_length(route), 2).alias("route_m"))


_CORNER = "lat + {0} * cos({1}) / 111320e0 as a{2}, lon + {0} * sin({1}) / (111320e0 * greatest(0.1e0, abs(cos(radians(lat))))) as o{2}"
_WOB = "500 * (1 + 0.05e0 * sin(3 * {0}))"
_ARC = "(({0}) * (2 * pi() / 72))"


@query(
    f"{views('est')}, st as (select id, lat, lon, unnest(range(72)) as i from est), co as (select id, {_CORNER.format(_WOB.format(_ARC.format('i')), _ARC.format('i'), 1)}, {_CORNER.format(_WOB.format(_ARC.format('i + 1')), _ARC.format('i + 1'), 2)} from st), rg as (select id, sum({hav('a1', 'o1', 'a2', 'o2')}) as ring from co group by 1), "
    f"pt as (select id, 52.5e0 as a0, 13.4e0 as o0, (52.5e0 + lat) / 2 as a1, (13.4e0 + lon) / 2 + 0.06e0 * (lat - 52.5e0) as o1, lat as a2, lon as o2 from est), ln as (select *, {hav('a0', 'o0', 'a1', 'o1')} as l1, {hav('a1', 'o1', 'a2', 'o2')} as l2 from pt), "
    "fr as (select *, case when l1 > 0 then least(1e0, 1000e0 / l1) else 1e0 end as f1, case when l2 > 0 then least(1e0, greatest(0e0, 1000e0 - l1) / l2) else 1e0 end as f2 from ln), "
    f"cu as (select id, {hav('a0', 'o0', 'a0 + (a1 - a0) * f1', 'o0 + (o1 - o0) * f1')} as d1, case when l1 >= 1000 then 0 else {hav('a1', 'o1', 'a1 + (a2 - a1) * f2', 'o1 + (o2 - o1) * f2')} end as d2 from fr) "
    "select rg.id, 73 as corners, round(ring, 1) as ring_m, round(d1 + d2, 1) as sliced_m from rg join cu on cu.id = rg.id"
)
def geo_polygon_and_slice(spark, sf_dir):
    route = geo.fallback_route(F.lit(52.5), F.lit(13.4), F.col("lat"), F.col("lon"))
    ring = geo.radius_polygon(F.col("lat"), F.col("lon"), F.lit(500.0), wobble=0.05)
    return establishments(spark, sf_dir).select("id", F.size(ring).alias("corners"), F.round(geo.path_length(ring), 1).alias("ring_m"), F.round(geo.path_length(geo.path_upto(route, F.lit(1000.0))), 1).alias("sliced_m"))


@query(f"select item_id, {NORM.format('text')} as normalized, substr({NORM.format('text')}, 1, 64) as short, len(list_filter(string_split({NORM.format('text')}, ' '), lambda x: x <> '')) as n_tokens from benchmark")
def text_normalize(spark, sf_dir):
    n = text.normalize(F.col("text"))
    return load(spark, sf_dir, "benchmark").select("item_id", n.alias("normalized"), text.analytics_normalize(F.col("text")).alias("short"), F.size(text.tokens(n)).cast("long").alias("n_tokens"))


TYPOS = {"smoke": "smog", "ivory": "ivry", "azure": "blue", "the": "thee", "of": "off"}
_TYPO_SQL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in TYPOS.items()) + "}"


@query(f"select item_id, array_to_string(list_transform(list_filter(string_split({NORM.format('text')}, ' '), lambda x: x <> ''), lambda x: coalesce(({_TYPO_SQL})[x], x)), ' ') as corrected from benchmark")
def text_typo_correct(spark, sf_dir):
    return load(spark, sf_dir, "benchmark").select("item_id", text.correct(text.normalize(F.col("text")), TYPOS).alias("corrected"))


_PAIR = "with w as (select distinct lower(p_name) as n from part), p as (select a.n as a, b.n as b from w a join w b on a.n < b.n)"


def _pairs(spark, sf_dir):
    w = load(spark, sf_dir, "part").select(F.lower("p_name").alias("n")).distinct()
    return w.select(F.col("n").alias("a")).join(w.select(F.col("n").alias("b")), F.col("a") < F.col("b"))


_TOK = "list_filter(string_split({0}, ' '), lambda z: z <> '')"
_FUZ = "({0} = {1} or (greatest(length({0}), length({1})) >= 4 and levenshtein({0}, {1}) <= case when greatest(length({0}), length({1})) >= 8 then 2 else 1 end))"


def sql_exists(items: str, var: str, cond: str) -> str:
    return f"(len(list_filter({items}, lambda {var}: {cond})) > 0)"


def sql_phrase(a: str, b: str) -> str:
    each = sql_exists(_TOK.format(b), "y", _FUZ.format("x", "y"))
    q = _TOK.format(a)
    return f"(contains({a}, {b}) or contains({b}, {a}) or (len({q}) > 0 and len(list_filter({q}, lambda x: {each})) = len({q})))"


@query(f"{_PAIR} select a, b, {_FUZ.format('a', 'b')} as near from p")
def text_fuzzy_token(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", text.fuzzy_token(F.col("a"), F.col("b")).alias("near"))


@query(f"{_PAIR} select a, b, {sql_phrase('a', 'b')} as near from p")
def text_fuzzy_phrase(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", text.fuzzy_phrase(F.col("a"), F.col("b")).alias("near"))


@query(f"{_PAIR} select a, b, {sql_exists('list_filter(' + _TOK.format('a') + ', lambda x: length(x) >= 4)', 'x', sql_exists(_TOK.format('b'), 'y', 'contains(x, y) or contains(y, x) or ' + _FUZ.format('x', 'y')))} as overlaps from p")
def text_token_overlap(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", text.meaningful_overlap(F.col("a"), F.col("b")).alias("overlaps"))


@query("select p_partkey, nullif(regexp_replace(regexp_replace(strip_accents(lower(concat(p_name, ' / ', p_type))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), '') as slug from part")
def text_slugify(spark, sf_dir):
    return load(spark, sf_dir, "part").select("p_partkey", text.slugify(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"))


@query("select doc_id, md5(text) as md5, sha1(text) as sha1, sha256(text) as sha256 from documents")
def text_hashes(spark, sf_dir):
    h = text.hashes(F.col("text"))
    return load(spark, sf_dir, "documents").select("doc_id", *[h[k].alias(k) for k in ("md5", "sha1", "sha256")])


CHAINS = ["rossmann", "market 1"]


@query(f"{views('est')} select id, case when {NORM.format('name')} = '' then 'unknown' when contains({NORM.format('name')}, 'rossmann') or contains({NORM.format('name')}, 'market 1') then 'chain' when len(string_split({NORM.format('name')}, ' ')) >= 2 then 'independent' else 'unknown' end as ownership from est")
def ownership_type(spark, sf_dir):
    return establishments(spark, sf_dir).select("id", text.ownership(F.col("name"), CHAINS).alias("ownership"))


KEYWORDS = {"groceries": r"market|food", "electronics": r"phone|repair", "beauty": r"\bnail\b", "household": r"kiosk"}


@query(f"{views('est')} select id, array_to_string(list_filter([case when regexp_matches(lower(name), 'market|food') then 'groceries' end, case when regexp_matches(lower(name), 'phone|repair') then 'electronics' end, case when regexp_matches(lower(name), '\\bnail\\b') then 'beauty' end, case when contains(lower(name), 'kiosk') then 'household' end], lambda x: x is not null), '|') as flags, case when regexp_matches(lower(name), '\\b(?:phone|repair)\\b') then 'service' when regexp_matches(lower(name), '\\b(?:market)\\b') then 'shop' end as intent, case when contains(name, 'Food') or contains(name, 'Market') then 'food' when contains(name, 'Nail') then 'beauty' end as hint from est")
def keyword_categories(spark, sf_dir):
    n = F.lower("name")
    return establishments(spark, sf_dir).select("id", F.array_join(text.keyword_flags(n, KEYWORDS), "|").alias("flags"), text.quick_intent(n, {"service": ["phone", "repair"], "shop": ["market"]}).alias("intent"), text.first_hint(F.col("name"), [("food", ["Food", "Market"]), ("beauty", ["Nail"])]).alias("hint"))


@query("select doc_id, case when length(text) > 130 then concat(rtrim(substr(text, 1, 129), ' '), '…') else text end as short, concat(upper(substr(source, 1, 1)), substr(source, 2)) as label from documents")
def text_misc(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.ellipsis(F.col("text")).alias("short"), text.humanize(F.col("source")).alias("label"))


_FRESH = "round(least(0.99e0, greatest(0.05e0, 1e0 - least(0.58e0, 0.010e0 * seen_days) - least(0.23e0, 0.004e0 * import_days) - least(0.15e0, 0.0025e0 * coalesce(enrich_days, 365)) - case when closed_candidate then 0.18e0 else 0e0 end - case active_status when 'temporarily_closed' then 0.12e0 when 'inactive' then 0.28e0 else 0e0 end)), 4)"


@query(f"{views('est')} select id, {_FRESH} as freshness from est")
def freshness_decay(spark, sf_dir):
    c = F.col
    return establishments(spark, sf_dir).select("id", scores.freshness(c("seen_days"), c("import_days"), c("enrich_days"), c("closed_candidate"), c("active_status")).alias("freshness"))


@query("select event_id, floor(greatest(1, floor(epoch(timestamp '2024-02-01' - ts) / 3600 + 0.5)))::bigint as freshness_h, round((user_id * 3e0 + event_id % 1000 * 15e0) / 1000000, 6) as cost_usd, case when event_id % 600 between 200 and 299 then case when event_id % 2 = 0 then 0.92e0 else 0.84e0 end when event_id % 600 between 300 and 399 then 0.72e0 when event_id % 600 between 400 and 499 then 0.42e0 else 0.33e0 end as fetch_score from events")
def event_scores(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    age = F.expr("timestampdiff(MICROSECOND, ts, timestamp_ntz'2024-02-01') / 1e6")
    return e.select("event_id", scores.freshness_hours(age).cast("long").alias("freshness_h"), scores.model_cost(F.col("user_id"), F.col("event_id") % 1000, 3.0, 15.0).alias("cost_usd"), scores.fetch_freshness(F.col("event_id") % 600, F.col("event_id") % 2 == 0).alias("fetch_score"))


@query(f"{views('prod')} select id, product_group, case product_group when 'x' then 1 else 0 end as never, concat_ws('_', 'candidate', cast(id % 100 as varchar), cast(id as varchar), 'unknown') as offer_key from prod")
def projection_keys(spark, sf_dir):
    return products(spark, sf_dir).select("id", "product_group", F.lit(0).alias("never"), F.concat_ws("_", F.lit("candidate"), (F.col("id") % 100).cast("string"), F.col("id").cast("string"), F.coalesce(F.lit(None).cast("string"), F.lit("unknown"))).alias("offer_key"))
