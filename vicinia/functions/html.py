"""Page and JSON extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six entities that are decoded.
ENTITIES = {"&nbsp;": " ", "&quot;": '"', "&#39;": "'", "&lt;": "<", "&gt;": ">", "&amp;": "&"}


def text_of(html: Column) -> Column:
    """Scripts and styles out, tags to blanks, entities decoded, blanks collapsed."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for k, v in ENTITIES.items():
        c = F.replace(c, F.lit(k), F.lit(v))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def title(html: Column) -> Column:
    """X2."""
    return F.nullif(text_of(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def meta_description(html: Column) -> Column:
    """Of the first meta tag that has it, name or property and content in either order."""
    named, content = r"""(?:name|property)\s*=\s*["'](?:og:)?description["']""", r"""content\s*=\s*["']([^"']*)["']"""
    first, last = (F.regexp_extract(html, f"(?is)<meta[^>]+{x}[^>]*{y}", 1) for x, y in ((named, content), (content, named)))
    return F.nullif(text_of(F.when(first != "", first).otherwise(last)), F.lit(""))


def unique_texts(items: Column, most: int, longest: int = 320) -> Column:
    """First of each normalized text, in order, cut in length and number."""
    cut = F.filter(F.transform(items, lambda x: F.substring(F.trim(x), 1, longest)), lambda x: x != "")
    key = lambda x: F.lower(F.regexp_replace(x, r"\s+", " "))
    kept = F.aggregate(cut, F.struct(F.array().cast("array<string>").alias("k"), F.array().cast("array<string>").alias("v")), lambda s, x: F.when(F.array_contains(s["k"], key(x)), s).otherwise(F.struct(F.concat(s["k"], F.array(key(x))).alias("k"), F.concat(s["v"], F.array(x)).alias("v"))))
    return F.slice(kept["v"], 1, most)


def headings(html: Column, most: int = 28) -> Column:
    """Texts of h1 to h3."""
    return unique_texts(F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<h[1-3][^>]*>(.*?)</h[1-3]>"), F.lit(1)), text_of), most)


def json_ld(html: Column, most: int = 80) -> Column:
    """JSON strings of entities in script blocks: arrays and @graph are opened, malformed blocks are skipped."""
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<script[^>]+type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    valid = F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull())

    def opened(b: Column) -> Column:
        graph = F.get_json_object(b, "$['@graph']")
        whole = F.coalesce(graph, F.trim(b))
        return F.when(whole.startswith("["), F.coalesce(F.from_json(whole, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(whole))

    return F.slice(F.flatten(F.transform(valid, opened)), 1, most)


def breadcrumbs(html: Column, most: int = 28) -> Column:
    """Names in JSON-LD breadcrumb lists, then texts in blocks whose class says breadcrumb."""
    lists = F.filter(json_ld(html), lambda e: F.get_json_object(e, "$['@type']") == "BreadcrumbList")
    names = F.flatten(F.transform(lists, lambda e: F.transform(F.coalesce(F.from_json(F.get_json_object(e, "$.itemListElement"), "array<string>"), F.array().cast("array<string>")), lambda i: F.coalesce(F.get_json_object(i, "$.name"), F.get_json_object(i, "$.item.name"), F.lit("")))))
    blocks = F.regexp_extract_all(html, F.lit(r"""(?is)<(?:nav|ol|ul|div)[^>]+class\s*=\s*["'][^"']*breadcrumb[^"']*["'][^>]*>(.*?)</(?:nav|ol|ul|div)>"""), F.lit(1))
    shown = F.flatten(F.transform(blocks, lambda b: F.split(text_of(F.regexp_replace(b, r"(?is)</(?:li|a|span)>", " › ")), r"\s*[›>/]\s*")))
    return unique_texts(F.concat(names, shown), most)


def brands(html: Column, most: int = 24) -> Column:
    """Brands of entities, then one or two capitalised words of the text, 3 letters or more."""
    own = F.transform(json_ld(html), lambda e: F.coalesce(F.get_json_object(e, "$.brand.name"), F.get_json_object(e, "$.brand"), F.lit("")))
    seen = F.regexp_extract_all(text_of(html), F.lit(r"\b\p{Lu}[\p{L}0-9&'-]{2,}(?:\s\p{Lu}[\p{L}0-9&'-]{2,})?\b"), F.lit(0))
    return unique_texts(F.concat(own, seen), most)


def visible_categories(html: Column, hints: list[str]) -> Column:
    """Hints that the lower-case text holds."""
    t = F.lower(text_of(html))
    return F.filter(F.array(*map(F.lit, hints)), lambda h: t.contains(h))


def hours_in_schema(html: Column) -> Column:
    """X8."""
    h = F.transform(json_ld(html), lambda e: F.get_json_object(e, "$.openingHours"))
    return F.try_element_at(F.filter(h, lambda x: x.isNotNull()), F.lit(1))


def hours_in_text(html: Column) -> Column:
    """X8."""
    return F.nullif(F.regexp_extract(text_of(html), r"(?i)\b((?:mo|tu|we|th|fr|sa|su)[a-z]*(?:\s*-\s*(?:mo|tu|we|th|fr|sa|su)[a-z]*)?\s*:?\s*[0-9]{1,2}:[0-9]{2}\s*-\s*[0-9]{1,2}:[0-9]{2})", 1), F.lit(""))


def text_bag(title: Column, description: Column, lists: list[Column], entities: Column) -> tuple[Column, Column]:
    """(text, names): normalized title, description, headings, breadcrumbs, categories and brands of a page in one text, and what its
    product and offer entities (JSON strings) call themselves, their item, category and brand, which the text holds too."""
    from vicinia.functions.text import stable_normalize

    empty = F.array().cast("array<string>")
    goods = F.filter(F.coalesce(entities, empty), lambda e: F.coalesce(F.get_json_object(e, "$['@type']"), F.lit("")).rlike("(?i)product|offer"))
    names = F.flatten(F.transform(goods, lambda e: F.array_compact(F.array(*[F.get_json_object(e, p) for p in ("$.name", "$.itemOffered.name", "$.category", "$.brand.name")]))))
    parts = F.concat(F.array(F.coalesce(title, F.lit("")), F.coalesce(description, F.lit(""))), *[F.coalesce(x, empty) for x in lists], names)
    return F.trim(F.array_join(F.transform(parts, stable_normalize), " ")), F.filter(F.transform(names, stable_normalize), lambda x: x != "")


def website_eligible(http_status: Column, n_headings: Column, n_categories: Column, n_schema: Column) -> Column:
    """F23."""
    return http_status.between(200, 299) & ((n_headings >= 2) | (n_categories >= 2) | (n_schema >= 1))


def normalize_url(url: Column) -> Column:
    """A scheme stays, a bare host gets https, anything else is null."""
    u = F.trim(url)
    return F.when(u.rlike(r"(?i)^https?://[^\s/]+\.[^\s/]+"), u).when(u.rlike(r"(?i)^[a-z0-9-]+(\.[a-z0-9-]+)+(/\S*)?$"), F.concat(F.lit("https://"), u))


def lenient_json(c: Column) -> Column:
    """The whole string if it is JSON, else from its first { to its last }."""
    inner = F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))
    return F.when(F.try_parse_json(c).isNotNull(), c).when(F.try_parse_json(inner).isNotNull(), inner)


def merge_json(a: Column, b: Column) -> Column:
    """Object concatenation; keys of b win. Values keep their types, objects and lists included. What is no object, or repeats a key, counts as an empty one."""
    m = lambda c: F.coalesce(F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>"), F.from_json(F.lit("{}"), "map<string,variant>"))
    # Both are parsed once a row: a lambda that named m(b) itself would parse it again for each key of a.
    both = F.array(F.struct(m(a).alias("a"), m(b).alias("b")))
    merged = F.transform(both, lambda x: F.map_concat(F.map_filter(x["a"], lambda k, _: ~F.map_contains_key(x["b"], k)), x["b"]))
    return F.to_json(merged[0])
