"""Classification of establishments and generation of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinia.functions import scores, text
from vicinia.operators.matching import mutual_containments, phrase_hits

#: Owners that are broadcast at most.
BROADCAST = 1_000_000
#: Ids of a block of offers at most.
BLOCK = 128


def classify_categories(osm: Column, words: Column, osm_map: dict[str, list[str]], keywords: dict[str, str], default: str = "household", most: int = 5) -> tuple[Column, Column]:
    """(categories, confidence): those mapped from the OSM category, then those of matching keywords; pharmacy brings personal-care, art goes
    beside beauty or personal-care; the default stands alone. 0.8 if mapped, else 0.56, and 0.04 a keyword up to 0.15, 0.97 at most."""
    empty = F.array().cast("array<string>")
    mapped = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in osm_map.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), osm), empty)
    hits = text.keyword_flags(words, keywords)
    cats = F.array_union(mapped, hits)
    cats = F.when(F.array_contains(cats, "pharmacy"), F.array_union(cats, F.array(F.lit("personal-care")))).otherwise(cats)
    cats = F.when(F.arrays_overlap(cats, F.array(F.lit("beauty"), F.lit("personal-care"))), F.array_remove(cats, "art")).otherwise(cats)
    cats = F.slice(F.when(F.size(cats) == 0, F.array(F.lit(default))).otherwise(cats), 1, most)
    conf = F.least(F.lit(0.97), F.when(F.size(mapped) > 0, 0.8).otherwise(0.56) + F.least(F.lit(0.15), 0.04 * F.size(hits)))
    return cats, F.round(conf, 4)


def overwrite_categories(old: Column, origin: Column, new: Column) -> Column:
    """Only empty or pipeline-made categories are replaced."""
    return F.when((F.coalesce(F.size(old), F.lit(0)) <= 0) | (origin == "pipeline"), new).otherwise(old)


def classify_roles(osm: Column, words: Column, rules: list[tuple[str, list[str], str]], precedence: list[str]) -> tuple[Column, Column, Column]:
    """(roles, primary, confidence) from rules (role, OSM categories, name pattern); 0.84 where both agree on the primary role, 0.78 by category,
    0.68 by name, 0.58 for the default role retail."""
    by_cat = F.array_compact(F.array(*[F.when(osm.isin(c), F.lit(r)) for r, c, _ in rules]))
    by_name = F.array_compact(F.array(*[F.when(words.rlike(p), F.lit(r)) for r, _, p in rules]))
    roles = F.array_union(by_cat, by_name)
    primary = F.coalesce(F.try_element_at(F.filter(F.array(*map(F.lit, precedence)), lambda r: F.array_contains(roles, r)), F.lit(1)), F.lit("retail"))
    conf = F.when(F.array_contains(by_cat, primary) & F.array_contains(by_name, primary), 0.84).when(F.array_contains(by_cat, primary), 0.78).when(F.array_contains(by_name, primary), 0.68).otherwise(0.58)
    return roles, primary, conf


def dealt_join(offers: DataFrame, owners: DataFrame, key: list[str], by: str = "product_id") -> DataFrame:
    """Each offer (key, by and any other columns) with all owners of its key (few keys, many rows on both sides): offers are dealt evenly, whatever their key, and each part meets
    all owners, by broadcast where they are a million at most. The pairs are never shuffled or sorted."""
    n = max(int(offers.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * offers.sparkSession.sparkContext.defaultParallelism)
    if owners.limit(BROADCAST + 1).count() <= BROADCAST:
        return offers.repartition(n, by).join(F.broadcast(owners), key)
    part = F.pmod(F.xxhash64(by), F.lit(n)).cast("int")
    left = offers.withColumn("part", part).repartition(4 * n, *key, "part")
    right = owners.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(4 * n, *key, "part")
    return left.join(right, [*key, "part"]).drop("part")


def tasks(df: DataFrame) -> int:
    """Parts that rows with much work each are dealt to."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * df.sparkSession.sparkContext.defaultParallelism)


def blocks(offers: DataFrame, same: list[str], by: str) -> DataFrame:
    """Offers as (part, *same, ids): ids of `by` that agree in all columns `same`, BLOCK at most a row, nulls too. Each of tasks() parts is a task's and has its even share of each kind."""
    n = tasks(offers)
    dealt = offers.select(*same, by, F.pmod(F.xxhash64(by), F.lit(n)).cast("int").alias("part")).repartitionById(n, F.col("part"))
    ids = dealt.groupBy("part", *same).agg(F.collect_list(F.struct(by)).alias("ids"))  # structs, as lists leave out nulls
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("ids") - 1) / BLOCK).cast("int")), lambda i: F.slice("ids", i * BLOCK + 1, F.lit(BLOCK)))
    return ids.select("part", *same, F.explode(cut).alias("ids")).withColumn("ids", F.transform("ids", lambda x: x[by]))


def block_join(offers: DataFrame, owners: DataFrame, key: list[str]) -> DataFrame:
    """Each block with all rows of `owners` of its key: where it lies, by broadcast, if these are a million at most; else each part gets its copy of them."""
    if owners.limit(BROADCAST + 1).count() <= BROADCAST:
        return offers.join(F.broadcast(owners), key)
    n = tasks(offers)
    right = owners.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(4 * n, *key, "part")
    return offers.repartition(4 * n, *key, "part").join(right, [*key, "part"])


def unpacked(met: DataFrame, by: str) -> DataFrame:
    """A row for each id of blocks that have met their owners. Rows come in runs of one owner over the same few ids, which column formats pack well, and nothing but ids is worked out for each.

    coalesce() keeps the tasks as they are and lets blocks be handed on one by one: in one pipeline with the join, a task would hold all pairs of a block and all its owners."""
    return met.coalesce(tasks(met)).withColumn(by, F.explode("ids")).drop("ids", "part")


def ruled(establishments: DataFrame, rules: DataFrame, products: DataFrame, facets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The best rule of each set of categories and product, and the establishments of each set: (categories, product_id, app_category, product_group, confidence) and (establishment_id, categories).

    What an establishment gets depends on its set of categories alone, so rules are chosen for sets."""
    e = establishments.groupBy(F.col("id").alias("establishment_id")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("app_categories")))).alias("categories"))
    by_group = products.select(F.col("id").alias("product_id"), "product_group")
    both = by_group.union(facets.select("product_id", F.col("facet").alias("product_group"))).distinct() if facets is not None else by_group
    boost = F.when(F.col("app_category").isin("supermarket", "pharmacy"), F.lit("0.04")).otherwise(F.lit("0")).cast("decimal(5,4)")
    confidence = F.least(F.lit("0.99").cast("decimal(5,4)"), F.col("base_confidence") + boost).cast("decimal(5,4)")
    mine = e.select("categories").distinct().select("categories", F.explode("categories").alias("app_category")).join(rules.withColumn("confidence", confidence), "app_category")
    best = F.max_by(F.struct("app_category", "product_group", "confidence"), F.struct("confidence", F.col("app_category"), "product_group"))
    return both.join(mine, "product_group").groupBy("categories", "product_id").agg(best.alias("b")).select("categories", "product_id", "b.*"), e


def rule_rows(c: DataFrame, *first: str) -> DataFrame:
    """What else candidates of rules say."""
    out = c.select(*first, "app_category", "product_group", "confidence", F.lit("rules_generated").alias("source_type"))
    why = F.concat(F.lit("category "), F.col("app_category"), F.lit(" sells "), F.col("product_group"))
    return out.withColumn("validation_status", scores.status_from_confidence(F.col("source_type"), F.col("confidence"))).withColumn("why", why).withColumn("inferred_from", F.to_json(F.struct("app_category", "product_group")))


def rule_candidates(establishments: DataFrame, rules: DataFrame, products: DataFrame, facets: DataFrame | None = None) -> DataFrame:
    """Categories exploded, rules by category, products by group or facet; the best rule of each pair.

    establishments: (id, app_categories); rules: (app_category, product_group, base_confidence); products: (id, product_group). What a pair gets depends on the sets of
    categories and groups alone, so rules are chosen, and what they say is worked out, for pairs of sets; establishments meet blocks of products last, and no pair is grouped."""
    by_group = products.select(F.col("id").alias("product_id"), "product_group")
    both = by_group.unionByName(facets.select("product_id", F.col("facet").alias("product_group"))) if facets is not None else by_group
    kinds = both.groupBy("product_id").agg(F.array_sort(F.collect_set("product_group")).alias("groups"))
    offers, e = ruled(establishments, rules, kinds.select("groups").distinct().select(F.col("groups").alias("id"), F.explode("groups").alias("product_group")))
    c = block_join(blocks(kinds, ["groups"], "product_id"), offers.withColumnRenamed("product_id", "groups"), ["groups"])
    said = rule_rows(c, "part", "categories", "ids")
    return unpacked(block_join(said, e, ["categories"]), "product_id").select("establishment_id", "product_id", *said.columns[3:])


def service_candidates(establishments: DataFrame, hints: DataFrame, most: int = 6) -> DataFrame:
    """Services by hints (kind in name/category, hint, slug, confidence); groceries give none; the best few of each place."""
    name = text.normalize(F.col("name"))
    h = hints.withColumnRenamed("confidence", "hint_confidence")
    e = establishments.where("app_category <> 'groceries'")
    # Hints by category meet by key; those by name are parts of it, a list that each task gets.
    by_category = e.join(h.where("kind = 'category'"), F.col("osm_category") == F.col("hint"))
    j = by_category.unionByName(e.join(h.where("kind = 'name'"), name.contains(F.col("hint"))))
    best = j.groupBy(F.col("id").alias("establishment_id"), "slug").agg(F.max("hint_confidence").alias("confidence"))
    return best.withColumn("rn", F.row_number().over(Window.partitionBy("establishment_id").orderBy(F.col("confidence").desc(), "slug"))).where(F.col("rn") <= most).drop("rn")


def website_candidates(pages: DataFrame, products: DataFrame, weights: DataFrame, generic: list[str], schema_names: DataFrame | None = None) -> DataFrame:
    """Products that a page speaks of: 0.38 by name, 0.27 by a synonym, 0.34 if what its schema names holds the name or is held by it, 0.22 times the page
    category's weight for the group; from 0.46 on, 0.94 at most.

    pages: (page_id, bag, category), bag normalized; products: (product_id, product_group, name, synonyms), an array; schema_names: (page_id, schema_name). Names and synonyms are found as
    runs of whole words by a positional index. Products of one group, name and synonyms have the same fate on a page, so such kinds meet the pages, not products."""
    kind = ["product_group", "name", "synonyms"]
    named = products.where(~F.col("name").isin(generic) & (F.length("name") > 0)).withColumn("synonyms", F.coalesce("synonyms", F.array().cast("array<string>")))
    kinds = named.select(*kind).distinct()
    # Names and synonyms are looked up together: finds are worked out once.
    words = kinds.select(*kind, F.col("name").alias("phrase"), F.lit(True).alias("by_name")).unionByName(kinds.select(*kind, F.explode("synonyms").alias("phrase"), F.lit(False).alias("by_name")))
    hits = phrase_hits(pages.select("page_id", text.tokens(F.col("bag")).alias("words")), words.select("phrase"))
    flag = lambda df, **on: df.select("page_id", *kind, *[on.get(k, F.lit(False)).alias(k) for k in ("by_name", "by_synonym", "by_schema")])
    found = flag(hits.join(words, "phrase"), by_name=F.col("by_name"), by_synonym=~F.col("by_name"))
    if schema_names is not None:
        alike = mutual_containments(kinds.select(F.col("name").alias("query")), schema_names.where("schema_name <> ''").select(F.col("schema_name").alias("term")))
        said = schema_names.join(alike, F.col("schema_name") == F.col("term")).select("page_id", F.col("query").alias("name"))
        found = found.unionByName(flag(said.join(kinds, "name"), by_schema=F.lit(True)))
    found = found.groupBy("page_id", *kind).agg(*[F.max(k).alias(k) for k in ("by_name", "by_synonym", "by_schema")])
    j = found.join(pages.select("page_id", "category"), "page_id").join(weights, ["category", "product_group"], "left")
    some = lambda k, x: F.when(F.col(k), x).otherwise(0.0)
    raw = some("by_name", 0.38) + some("by_synonym", 0.27) + some("by_schema", 0.34) + 0.22 * F.coalesce("weight", F.lit(0.0))
    likely = j.withColumn("confidence", F.round(raw, 4)).where(F.col("confidence") >= 0.46).select("page_id", *kind, F.least(F.col("confidence"), F.lit(0.94)).alias("confidence"))
    return likely.join(named, kind).select("page_id", "product_id", "confidence")


def heuristic_candidates(establishments: DataFrame, weights: DataFrame, products: DataFrame, most: int, essentials: list[str]) -> DataFrame:
    """The category's weight for the group, 0.43 for essentials without one, 0.06 more if the names share a word, 0.05 for a pharmacy; 0.82 of it within 0.48 and 0.76."""
    # A score depends on the category but for the shared word. So an establishment's best are among the best of its category and the products
    # that share a word with it, and of these among the best of each (category, word): no establishment meets all products.
    p = products.select(F.col("id").alias("product_id"), "product_group", F.array_distinct(text.tokens(F.col("normalized_name"))).alias("words"))
    rows = weights.select("app_category", "product_group", "weight")
    e = establishments.select(F.col("id").alias("establishment_id"), "app_category", text.tokens(text.normalize(F.col("name"))).alias("nt"))
    extra = e.select("app_category").distinct().withColumn("product_group", F.explode(F.array(*map(F.lit, essentials)).cast("array<string>")))
    extra = extra.join(rows, ["app_category", "product_group"], "left_anti").withColumn("weight", F.lit(0.43))
    s = F.col("weight") + F.when(F.col("app_category") == "pharmacy", 0.05).otherwise(0.0)
    offers = rows.unionByName(extra).join(p, "product_group").withColumn("s", s)
    conf = lambda x: F.round(scores.clamp(0.82 * x, 0.48, 0.76), 4)

    def best(df: DataFrame, keys: list[str], score: Column) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(conf(score).desc(), "product_id")
        return df.withColumn("confidence", conf(score)).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most).drop("rn")

    plain = best(offers, ["app_category"], F.col("s")).select("app_category", "product_id", "confidence")
    worded = offers.select("app_category", "product_id", "s", F.explode("words").alias("w"))
    worded = best(worded, ["app_category", "w"], F.col("s") + 0.06).select("app_category", "w", "product_id", "confidence")
    asked = e.select("establishment_id", "app_category", F.explode(F.array_distinct("nt")).alias("w"))
    found = e.join(plain, "app_category").select("establishment_id", "product_id", "confidence").unionByName(asked.join(worded, ["app_category", "w"]).select("establishment_id", "product_id", "confidence"))
    found = found.groupBy("establishment_id", "product_id").agg(F.max("confidence").alias("confidence"))
    return found.withColumn("rn", F.row_number().over(Window.partitionBy("establishment_id").orderBy(F.col("confidence").desc(), "product_id"))).where(F.col("rn") <= most).select("establishment_id", "product_id", "confidence")


def model_candidates(output: DataFrame, pool: DataFrame) -> DataFrame:
    """Rows of a model's output that are in the pool, confidence within 0.45 and 0.9."""
    return output.join(pool.select("establishment_id", "product_id").distinct(), ["establishment_id", "product_id"], "left_semi").withColumn("confidence", scores.clamp(F.col("confidence"), 0.45, 0.9))


def recommendation_limit(http_status: Column, strength: Column) -> Column:
    """5 for a strong page, 2 without a page, 3 for a weak one."""
    return F.when(http_status.isNull(), 2).when(strength >= 2, 5).otherwise(3)


def dedupe_trim(cands: DataFrame, limit: Column) -> DataFrame:
    """Of each product the row of the best source and confidence, then the best of each store up to its limit."""
    key = scores.source_rank(F.col("source_type")) * 1000 + F.floor(F.col("confidence") * 1000 + 0.5)
    one = cands.withColumn("rn", F.row_number().over(Window.partitionBy("establishment_id", "product_id").orderBy(key.desc(), "id"))).where("rn = 1")
    return one.withColumn("rn", F.row_number().over(Window.partitionBy("establishment_id").orderBy(F.col("confidence").desc(), "product_id"))).where(F.col("rn") <= limit).drop("rn")


def profile(roles: Column, likely: Column, unlikely: Column, confidence: Column) -> dict[str, Column]:
    """A sanitised profile: 4 roles, 8 terms each, confidence within 0.45 and 0.92, to be reviewed below 0.82."""
    cut = lambda c, n: F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), text.normalize), lambda x: x != "")), 1, n)
    conf = scores.clamp(F.coalesce(confidence, F.lit(0.45)), 0.45, 0.92)
    return {"roles": cut(roles, 4), "likely": cut(likely, 8), "unlikely": cut(unlikely, 8), "confidence": conf, "needs_review": conf < 0.82}


def capabilities(roles: Column, products: Column, services: Column) -> dict[str, Column]:
    """Flags of what a place supports."""
    empty = F.array().cast("array<string>")
    s = F.coalesce(services, empty)
    return {
        "supports_products": (F.size(F.coalesce(products, empty)) > 0) | F.arrays_overlap(F.coalesce(roles, empty), F.array(F.lit("retail"), F.lit("grocery"))),
        "supports_services": (F.size(s) > 0) | F.arrays_overlap(F.coalesce(roles, empty), F.array(F.lit("service"), F.lit("repair"))),
        "supports_repair": F.exists(s, lambda x: x.ilike("%repair%")),
    }


def ambiguous(est: DataFrame, demand: DataFrame, least: int = 3) -> DataFrame:
    """establishments with for_candidates (rules of middling confidence, more than 8 merged rows, or demand in the district) and
    for_profile (8 product or 6 service candidates, no website, or that demand).

    est: (id, district, rules_mid_conf, merged_total, product_candidates, service_candidates, has_website); demand: (district, unresolved) by spelling."""
    key = lambda c: text.stable_normalize(F.coalesce(F.col(c), F.lit("")))
    d = demand.groupBy(key("district").alias("dk")).agg(F.sum("unresolved").alias("unresolved")).where((F.col("dk") != "") & (F.col("unresolved") >= least))
    j = est.withColumn("dk", key("district")).join(d, "dk", "left")
    wanted, n = F.col("unresolved").isNotNull(), lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.select(*est.columns, ((n("rules_mid_conf") > 0) | (n("merged_total") > 8) | wanted).alias("for_candidates"), ((n("product_candidates") >= 8) | (n("service_candidates") >= 6) | ~F.coalesce("has_website", F.lit(False)) | wanted).alias("for_profile"))


def service_aliases(services: DataFrame, listed: DataFrame) -> DataFrame:
    """Listed aliases (slug, lang, alias, priority) with the id of their service (id, slug); blank ones and unknown slugs drop out, equal ones keep the highest priority."""
    a = listed.select("slug", "lang", F.lower(F.trim("alias")).alias("alias"), "priority").where("alias <> ''")
    return services.select(F.col("id").alias("service_id"), "slug").join(a, "slug").groupBy("service_id", "lang", "alias").agg(F.max("priority").alias("priority"))


def suspicious(categories: Column, group: Column, fits: dict[str, list[str]], status: Column, source: Column) -> Column:
    """C11: no category of the place fits the group, and nobody vouches for the row."""
    ok = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in fits.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), group), F.array().cast("array<string>"))
    return ~F.arrays_overlap(categories, ok) & (status != "validated") & ~source.isin("merchant_added", "user_validated")


def alias_bootstrap(products: DataFrame) -> DataFrame:
    """Aliases of a catalogue with priorities; of equal ones the highest priority stays."""
    row = lambda c, lang, p: products.select(F.col("id").alias("product_id"), F.lit(lang).alias("lang"), F.lower(F.trim(F.col(c))).alias("alias"), F.lit(p).alias("priority"))
    every = row("normalized_name", "und", 100).unionByName(row("alias", "en", 90)).unionByName(row("brand", "und", 70))
    return every.where("alias <> ''").groupBy("product_id", "lang", "alias").agg(F.max("priority").alias("priority"))


def insert_new(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new whose key old does not have, each once; a key with a null is never one of old.

    One aggregation by key over both tables finds them, so a task holds its keys once and sorts neither side for a join."""
    rest = [c for c in new.columns if c not in keys]
    value = F.struct(*rest) if len(rest) > 1 else F.col(rest[0]) if rest else F.lit(True)
    mine = new.select(*keys, value.alias("value"), F.lit(False).alias("in_old"))
    kind = {c: new.schema[c].dataType for c in keys} | {"value": mine.schema["value"].dataType}
    theirs = old.dropna(subset=keys).select(*[F.col(k).cast(kind[k]).alias(k) for k in keys], F.lit(None).cast(kind["value"]).alias("value"), F.lit(True).alias("in_old"))
    g = mine.unionByName(theirs).groupBy(*keys).agg(F.first("value", ignorenulls=True).alias("value"), F.max("in_old").alias("in_old")).where("not in_old")
    at = {c: F.col("value")[c] if len(rest) > 1 else F.col("value") for c in rest} | {k: F.col(k) for k in keys}
    return g.select(*[at[c].alias(c) for c in new.columns])
