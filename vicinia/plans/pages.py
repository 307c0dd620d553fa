"""Queries of page and JSON extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinia.functions import hours, html
from vicinia.plans.registry import Registry
from vicinia.plans.text_geo import NORM
from vicinia.sources.tables import establishments, load, views

query = Registry()


def _clean(c: str) -> str:
    c = f"regexp_replace({c}, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g')"
    c = f"regexp_replace({c}, '(?s)<[^>]*>', ' ', 'g')"
    for k, v in html.ENTITIES.items():
        c = f"replace({c}, '{k}', '{v.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@query(f"select page_id, nullif({_clean(_TITLE)}, '') as title from pages")
def html_title(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(f"select page_id, array_to_string(list_transform(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), lambda h: {_clean('h')}), '|') as headings from pages")
def html_headings(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(html.headings(F.col("html")), "|").alias("headings"))


@query(f"select page_id, md5({_clean('html')}) as text_md5, length({_clean('html')}) as n_chars from pages")
def html_text(spark, sf_dir):
    t = html.text_of(F.col("html"))
    return load(spark, sf_dir, "pages").select("page_id", F.md5(t).alias("text_md5"), F.length(t).cast("long").alias("n_chars"))


HINTS = ["the", "ring", "que", "menu", "home"]


@query(f"select page_id, array_to_string(list_filter(['the', 'ring', 'que', 'menu', 'home'], lambda h: contains(lower({_clean('html')}), h)), '|') as categories from pages")
def html_categories(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(html.visible_categories(F.col("html"), HINTS), "|").alias("categories"))


_U = "u as (select page_id, case page_id % 4 when 0 then url when 1 then regexp_replace(url, '^https?://', '') when 2 then concat(' ', url, ' ') else 'no url' end as u from pages)"


@query(f"with {_U} select page_id, case when regexp_matches(trim(u), '(?i)^https?://[^\\s/]+\\.[^\\s/]+') then trim(u) when regexp_matches(trim(u), '(?i)^[a-z0-9-]+(\\.[a-z0-9-]+)+(/\\S*)?$') then concat('https://', trim(u)) end as url from u")
def url_normalize(spark, sf_dir):
    u = load(spark, sf_dir, "pages").select("page_id", F.expr("case page_id % 4 when 0 then url when 1 then regexp_replace(url, '^https?://', '') when 2 then concat(' ', url, ' ') else 'no url' end").alias("u"))
    return u.select("page_id", html.normalize_url(F.col("u")).alias("url"))


@query(f"{views('est')}, h as (select id, nullif(trim(case when id % 3 = 0 then opening_hours else '' end), '') as o, nullif(trim(case when id % 2 = 0 then upper(opening_hours) else '' end), '') as s, nullif(trim(opening_hours), '') as w from est) select id, coalesce(o, s, w) as hours, case when o is not null then 'osm' when s is not null then 'schema' when w is not null then 'website' end as source, case when o is not null then 0.88e0 when s is not null then 0.79e0 when w is not null then 0.72e0 end as confidence, false as conflict from h")
def hours_precedence(spark, sf_dir):
    o, s, w = (F.expr(x) for x in ("case when id % 3 = 0 then opening_hours else '' end", "case when id % 2 = 0 then upper(opening_hours) else '' end", "opening_hours"))
    h, source, conf = hours.hours_source(o, s, w)
    return establishments(spark, sf_dir).select("id", h.alias("hours"), source.alias("source"), conf.alias("confidence"), hours.hours_conflict(s, w).alias("conflict"))


@query("with u as (select page_id, case page_id % 5 when 0 then null else 100 + page_id * 7 % 450 end as st, page_id % 4 as h, page_id % 3 as c, page_id % 2 as x from pages) select page_id, coalesce(st between 200 and 299 and (h >= 2 or c >= 2 or x >= 1), false) as eligible from u")
def website_eligibility(spark, sf_dir):
    p = load(spark, sf_dir, "pages").selectExpr("page_id", "case page_id % 5 when 0 then null else 100 + page_id * 7 % 450 end as st", "page_id % 4 as h", "page_id % 3 as c", "page_id % 2 as x")
    return p.select("page_id", F.coalesce(html.website_eligible(*map(F.col, ("st", "h", "c", "x"))), F.lit(False)).alias("eligible"))


#: A page with all that is looked for; the tests run on it, the queries on the table.
SAMPLE = """<title>A &amp; B</title><meta name="description" content="Fine &quot;tools&quot;"><h1>Tools</h1><h2>TOOLS</h2><nav class="main breadcrumb"><a>Home</a><a>Tools</a></nav>
<script type="application/ld+json">{"@graph": [{"@type": "Product", "name": "Saw", "brand": {"name": "Acme"}}, {"@type": "Store", "openingHours": "Mo-Fr 09:00-18:00"}, {"@type": "BreadcrumbList", "itemListElement": [{"name": "Start"}, {"item": {"name": "Saws"}}]}]}</script><script type="application/ld+json">{broken</script><p>Open Mo-Sa 10:00-20:00 by Bosch Power</p>"""


# The table's pages have no JSON-LD, breadcrumbs or opening hours, so each gets some that speak of its own title and place; what is found has to be that, behind its own tags and entities.
def _marked(spark, sf_dir):
    p = load(spark, sf_dir, "pages").withColumn("t", html.title(F.col("html")))
    kind = lambda k: F.lit(k).alias("@type")
    good = F.to_json(F.struct(kind("Product"), F.col("t").alias("name"), F.struct(F.concat(F.lit("Maker "), F.col("page_id") % 7).alias("name")).alias("brand")))
    store = F.to_json(F.struct(kind("Store"), F.when(F.col("page_id") % 3 == 0, "Mo-Fr 09:00-18:00").alias("openingHours")))
    crumbs = F.to_json(F.struct(kind("BreadcrumbList"), F.array(F.struct(F.lit("Start").alias("name"), F.lit(None).cast("struct<name:string>").alias("item")), F.struct(F.lit(None).cast("string").alias("name"), F.struct(F.col("t").alias("name")).alias("item"))).alias("itemListElement")))
    block = lambda x: F.concat(F.lit("<script id='x' type='application/ld+json'>"), x, F.lit("</script>"))
    more = F.concat(block(F.concat(F.lit('{"@graph": ['), good, F.lit(", "), store, F.lit("]}"))), block(F.lit("{broken")), block(crumbs), F.lit('<div class="top breadcrumb-bar"><a>Home</a><a>Page '), F.col("page_id"), F.lit("</a></div>"))
    meta = F.concat(F.lit('<meta content="About &quot;'), F.col("page_id"), F.lit('&quot;" property="og:description">'))
    open_ = F.when(F.col("page_id") % 2 == 0, "<p>Open <b>Mo - Sa</b> 10:00 - 20:00</p>").otherwise("")
    return p.select("page_id", "t", F.concat(meta, "html", more, open_).alias("html"))


@query(f"with m as (select page_id, nullif({_clean(_TITLE)}, '') as t from pages) select page_id, 'Product' as kind, t as name, concat('Maker ', page_id % 7) as brand, null as opening from m union all select page_id, 'Store', null, null, case when page_id % 3 = 0 then 'Mo-Fr 09:00-18:00' end from m union all select page_id, 'BreadcrumbList', null, null, null from m")
def html_jsonld(spark, sf_dir):
    """X4."""
    x = _marked(spark, sf_dir).select("page_id", F.explode(html.json_ld(F.col("html"))).alias("e"))
    at = lambda path: F.get_json_object("e", path)
    return x.select("page_id", at("$['@type']").alias("kind"), at("$.name").alias("name"), at("$.brand.name").alias("brand"), at("$.openingHours").alias("opening"))


@query(f"with m as (select page_id, nullif({_clean(_TITLE)}, '') as t from pages) select page_id, concat_ws('|', 'Start', nullif(substr(t, 1, 320), ''), 'Home', concat('Page ', page_id)) as crumbs, concat('About \"', page_id, '\"') as description, case when page_id % 3 = 0 then 'Mo-Fr 09:00-18:00' end as schema_hours, case when page_id % 2 = 0 then 'Mo - Sa 10:00 - 20:00' end as text_hours from m")
def html_breadcrumbs(spark, sf_dir):
    """X5, X8, X2."""
    return _marked(spark, sf_dir).select("page_id", F.array_join(html.breadcrumbs(F.col("html")), "|").alias("crumbs"), html.meta_description(F.col("html")).alias("description"), html.hours_in_schema(F.col("html")).alias("schema_hours"), html.hours_in_text(F.col("html")).alias("text_hours"))


@query()
def html_brands(spark, sf_dir):
    return load(spark, sf_dir, "pages").select("page_id", F.array_join(html.brands(F.col("html")), "|").alias("brands"))


@query("select event_id, case when event_id % 3 < 2 then props end as found from events")
def json_lenient_parse(spark, sf_dir):
    """X13 over the props of all events: as they are, between words, and cut short."""
    e = load(spark, sf_dir, "events").select("event_id", F.expr("case event_id % 3 when 0 then props when 1 then concat('Sure: ', props, ' done') else substring(props, 1, length(props) - 1) end").alias("s"))
    return e.select("event_id", html.lenient_json(F.col("s")).alias("found"))


_MORE = "json_object('t', event_type, 'ids', [event_id, user_id], 'of', json_object('ok', event_type <> 'error', 'user', user_id), 'k', case when event_id % 2 = 0 then 'none' end)"


@query(f"select event_id, concat('{{', string_agg(concat(to_json(key), ':', val), ',' order by key), '}}') as merged from (select event_id, unnest(json_keys(j)) as key, json_extract(j, concat('$.', unnest(json_keys(j))))::varchar as val from (select event_id, concat(left(props, length(props) - 1), ', \"t\":\"\", \"old\":[1,{{\"a\":null}}]}}') as p, {_MORE} as m, p::json as pj from events) x, lateral (select json_object('k', json_extract(m, '$.k'), 'old', json_extract(pj, '$.old'), 't', json_extract(m, '$.t'), 'ids', json_extract(m, '$.ids'), 'of', json_extract(m, '$.of')) as j)) group by 1")
def json_merge(spark, sf_dir):
    """X12 over the props of all events and an object with a text, a list, an object and a null or text in place of a number; keys in order."""
    e = load(spark, sf_dir, "events")
    a = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(', "t":"", "old":[1,{"a":null}]}'))
    b = F.to_json(F.struct(F.col("event_type").alias("t"), F.array("event_id", "user_id").alias("ids"), F.struct(F.col("user_id").alias("user"), (F.col("event_type") != "error").alias("ok")).alias("of"), F.when(F.col("event_id") % 2 == 0, "none").alias("k")), {"ignoreNullFields": "false"})
    # The merged object is parsed once a row, and its entries are written from their values: a look-up by key would parse it again for each.
    entries = F.map_entries(F.from_json(html.merge_json(a, b), "map<string,variant>"))
    shown = F.transform(entries, lambda x: F.struct(x["key"].alias("key"), F.to_json(x["value"]).alias("value")))
    return e.select("event_id", F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(shown), lambda x: F.concat(F.lit('"'), x["key"], F.lit('":'), x["value"])), ","), F.lit("}")).alias("merged"))


@query(f"select page_id, trim(concat_ws(' ', {NORM.format(_clean(_TITLE))}, 'fine tools', {NORM.format("array_to_string(regexp_extract_all(html, '(?is)<h[1-3][^>]*>(.*?)</h[1-3]>', 1), ' ')")}, case when page_id % 2 = 0 then 'saw acme' end)) as bag, case when page_id % 2 = 0 then 'saw|acme' else '' end as names from pages")
def page_text_bag(spark, sf_dir):
    """X14 with entities made from page_id, since the pages have none."""
    entity = F.array(F.lit('{"@type": "Product", "name": "Saw", "brand": {"name": "Acme"}}'), F.lit('{"@type": "Store", "name": "Not this"}'))
    heads = F.array(F.array_join(F.regexp_extract_all("html", F.lit("(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)), " "))
    bag, names = html.text_bag(html.title(F.col("html")), F.lit("Fine tools"), [heads], F.when(F.col("page_id") % 2 == 0, entity))
    return load(spark, sf_dir, "pages").select("page_id", F.trim(F.regexp_replace(bag, " +", " ")).alias("bag"), F.array_join(names, "|").alias("names"))
