"""Query understanding, retrieval cascade, guards, ranking and fallbacks."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinia.functions import geo, scores, text
from vicinia.operators.matching import mutual_containments, near_phrases
from vicinia.operators.merging import dedupe_ranked

# Limits of retrieval and of result lists, default radius and its range.
PRE_RANK, TOP, TOP_SERVICES, TOP_CATEGORY, FEW = 450, 80, 80, 24, 110
RADIUS, RADIUS_RANGE = 2000, (300, 15_000)
PROFILE_RANK = {"validated": 4, "likely": 3, "unvalidated": 2, "rejected": 0}


@dataclass
class Lexicon:
    """What queries are read with. Everything is data of the caller."""

    generic: list[str] = field(default_factory=list)
    broad: list[str] = field(default_factory=list)
    typos: dict[str, str] = field(default_factory=dict)
    service_parts: list[str] = field(default_factory=list)
    service_words: list[str] = field(default_factory=list)
    service_verbs: list[str] = field(default_factory=list)
    service_objects: list[str] = field(default_factory=list)
    location_words: list[str] = field(default_factory=list)


def clamp_params(lat: float | None, lon: float | None, radius_m: float | None) -> tuple[float | None, float | None, float]:
    """Q13."""
    r = min(max(radius_m if radius_m is not None else RADIUS, RADIUS_RANGE[0]), RADIUS_RANGE[1])
    ok = lat is not None and lon is not None and abs(lat) <= 90 and abs(lon) <= 180
    return (lat, lon, r) if ok else (None, None, r)


def is_specific(q: Column, lex: Lexicon) -> Column:
    """neither generic nor broad; one word of 5 letters, or some word of 4."""
    t = text.tokens(q)
    return ~q.isin(lex.generic + lex.broad) & F.when(F.size(t) == 1, F.length(t[0]) >= 5).otherwise(F.exists(t, lambda x: F.length(x) >= 4))


def is_service(q: Column, lex: Lexicon) -> Column:
    """a listed part, one listed word alone, or a listed verb with a listed object."""
    t = text.tokens(q)
    lit = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    return text.any_of(q, lex.service_parts) | ((F.size(t) == 1) & F.arrays_overlap(t, lit(lex.service_words))) | (F.arrays_overlap(t, lit(lex.service_verbs)) & F.arrays_overlap(t, lit(lex.service_objects)))


def sanitize(q: Column, lex: Lexicon, most: int = 4) -> Column:
    """Q9: normalized, without location words, at most `most` words."""
    t = F.filter(text.tokens(text.normalize(q)), lambda x: ~x.isin(lex.location_words) if lex.location_words else F.lit(True))
    return F.array_join(F.slice(t, 1, most), " ")


def effective_query(original: Column, resolved: Column, confidence: Column, intent: Column, n_canonical: Column, used_model: Column) -> Column:
    """Q9: the resolved query at 0.6, or at 0.45 if its length is near and the intent known or terms support it; else the original."""
    near = (F.abs(F.length(resolved) - F.length(original)) <= 4) & ((intent != "unknown") | (n_canonical > 0))
    use = used_model & (F.coalesce(resolved, F.lit("")) != "") & ((confidence >= 0.6) | ((confidence >= 0.45) & near))
    return F.when(F.coalesce(use, F.lit(False)), resolved).otherwise(original)


def category_intents(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """Q1: (query, category): a term equals the query or all its words are among the query's."""
    t = terms.select("category", "term", text.tokens(F.col("term")).alias("tt"))
    q = queries.select("query", text.tokens(F.col("query")).alias("qt"))
    # Equi-join on the term's first word, which is among the query's words if all of its words are.
    j = q.withColumn("w", F.explode(F.array_distinct("qt"))).join(t.withColumn("w", F.col("tt")[0]), "w")
    return j.where((F.col("term") == F.col("query")) | (F.size(F.array_except("tt", "qt")) == 0)).select("query", "category").distinct()


def vocabulary_index(vocabulary: DataFrame) -> DataFrame:
    """Q2: (kind, key, group) of terms, words and prefixes of 3 to 6 letters."""
    w = vocabulary.select("group", "term", F.explode(text.tokens(F.col("term"))).alias("word"))
    prefixes = w.where(F.length("word") >= 3).select("group", F.explode(F.transform(F.sequence(F.lit(3), F.least(F.lit(6), F.length("word"))), lambda n: F.substring(F.col("word"), F.lit(1), n))).alias("key"))
    return vocabulary.select(F.lit("term").alias("kind"), F.col("term").alias("key"), "group").unionByName(w.select(F.lit("word").alias("kind"), F.col("word").alias("key"), "group")).unionByName(prefixes.select(F.lit("prefix").alias("kind"), "key", "group")).distinct()


def candidate_groups(queries: DataFrame, index: DataFrame) -> DataFrame:
    """Q2: (query, group) by equal term, shared word or the query words' prefixes."""
    t = queries.select("query", F.explode(text.tokens(F.col("query"))).alias("w"))
    keys = queries.select("query", F.lit("term").alias("kind"), F.col("query").alias("key")).unionByName(t.select("query", F.lit("word").alias("kind"), F.col("w").alias("key"))).unionByName(t.where(F.length("w") >= 3).select("query", F.lit("prefix").alias("kind"), F.substring("w", 1, 6).alias("key")))
    return keys.join(index, ["kind", "key"]).select("query", "group").distinct()


def infer_groups(queries: DataFrame, vocabulary: DataFrame, broad: list[str], most: int = 4) -> DataFrame:
    """Q3: (query, group, score): best term score and a bonus for further matches in the candidate groups, or in all if none scores;
    kept from max(2, top - 3) on, one for a single short word."""
    # A score is above 0 just where texts are near, so the near ones are found once, and the candidate groups only choose among them.
    q = queries.select("query").distinct()
    scope = candidate_groups(q, vocabulary_index(vocabulary)).withColumn("scoped", F.lit(True))
    hits = near_phrases(q, vocabulary.select("term")).join(vocabulary, "term").withColumn("s", text.term_score(F.col("query"), F.col("term"), F.col("term").isin(broad)))
    scored = hits.groupBy("query", "group").agg((F.max("s") + F.least(F.count("*") - 1, F.lit(2))).alias("score")).join(scope, ["query", "group"], "left")
    found = scored.withColumn("any", F.max("scoped").over(Window.partitionBy("query"))).where("scoped or any is null")
    w = Window.partitionBy("query")
    short = (F.size(text.tokens(F.col("query"))) == 1) & (F.length("query") < 5)
    r = found.withColumn("top", F.max("score").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.col("score").desc(), "group")))
    return r.where((F.col("score") >= F.greatest(F.lit(2), F.col("top") - 3)) & (F.col("rn") <= F.when(short, 1).otherwise(most))).select("query", "group", F.col("score").cast("int").alias("score"))


def match_products(queries: DataFrame, names: DataFrame) -> DataFrame:
    """Q4: (query, product_id, tier): products of the first tier that has any: 1 equal, 2 mutual containment, 3 near words. names: (product_id, name)."""
    q, n = F.col("query"), F.col("name")
    named = names.where(F.length("name") > 0)
    pairs = near_phrases(queries, named.select(n.alias("term"))).withColumnRenamed("term", "name")
    per = pairs.withColumn("tier", F.when(q == n, 1).when(text.contain_each_other(q, n), 2).otherwise(3))
    first = per.withColumn("first", F.min("tier").over(Window.partitionBy("query"))).where("tier = first")
    return first.join(named, "name").groupBy("query", "product_id").agg(F.min("tier").alias("tier"))


def match_services(queries: DataFrame, names: DataFrame, most: int = 24) -> DataFrame:
    """Q5: (query, service_id, score): 100 equal, 40 containment, 22 near, 10 a word of 3 shared, 3 both about repair; kept from max(14, top - 40) on.

    Without one of the first three a score is 13 at most, so only what meets by them is scored."""
    q, n = F.col("query"), F.col("name")
    shared = F.exists(text.tokens(q), lambda x: (F.length(x) >= 3) & F.array_contains(text.tokens(n), x))
    s = F.when(q == n, 100).otherwise(0) + F.when(text.contain_each_other(q, n), 40).otherwise(0) + F.when(text.fuzzy_phrase(q, n), 22).otherwise(0) + F.when(shared, 10).otherwise(0) + F.when(q.contains("repair") & n.contains("repair"), 3).otherwise(0)
    named = names.where(F.length("name") > 0)
    scored = near_phrases(queries, named.select(n.alias("term"))).withColumnRenamed("term", "name").withColumn("s", s)
    per = scored.join(named, "name").groupBy("query", "service_id").agg(F.max("s").alias("score"))
    w = Window.partitionBy("query")
    r = per.withColumn("top", F.max("score").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.col("score").desc(), "service_id")))
    return r.where((F.col("score") >= F.greatest(F.lit(14), F.col("top") - 40)) & (F.col("rn") <= most)).select("query", "service_id", "score")


def theta_terms(queries: DataFrame, terms: DataFrame, most: int = 3) -> DataFrame:
    """(query, term, priority): equal, or both of 4 letters and one holds the other; the best few by priority."""
    q, t = F.col("query"), F.col("term")
    hit = (q == t) | ((F.length(q) >= 4) & (F.length(t) >= 4))
    j = mutual_containments(queries, terms).where(hit).join(terms.select("term", "priority"), "term")
    return j.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(F.col("priority").desc(), "term"))).where(F.col("rn") <= most).select("query", "term", "priority")


def fuzzy_terms(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(query, term) of near words."""
    return near_phrases(queries, terms)


def fallback_guard(specific: Column, strong: Column, service_only: Column, chain: Column, trusted: Column, strategy: Column, rejected: Column, fit: Column, confidence: Column, strict_group: Column, token: Column) -> Column:
    """whether a row found by group stays, the first rule that applies deciding."""
    c = F.coalesce(confidence.cast("double"), F.lit(0.0))
    canonical = F.when(rejected, False).when(fit & (c >= 0.55), True).otherwise(trusted & (c >= 0.85))
    return F.when(~specific, True).when(strong, True).when(service_only & ~chain & ~trusted, False).when(strategy == "canonical", canonical).when(strict_group & ~token & ~trusted, False).when(fit & (c >= 0.78) & ~rejected, True).otherwise(trusted & ((c >= 0.9) & (fit | (c >= 0.97))))


def service_only_place(osm_category: Column, name: Column, categories: list[str], hints: list[str], chains: list[str]) -> Column:
    """a place of a service category whose name is no chain and says so, or is missing."""
    n = text.normalize(F.coalesce(name, F.lit("")))
    return osm_category.isin(categories) & ~text.any_of(n, chains) & ((n == "") | text.any_of(n, hints))


def keep_under_service_intent(strong: Column, trusted: Column, confidence: Column) -> Column:
    """F11."""
    return strong & trusted & (confidence >= 0.86)


def _meets(terms: Column, query: Column, near: Column | None = None) -> Column:
    if near is not None:
        return F.coalesce(F.arrays_overlap(terms, near), F.lit(False))
    return F.exists(F.coalesce(terms, F.array().cast("array<string>")), lambda s: (s != "") & text.fuzzy_phrase(query, s))


def _has_role(roles: Column, known: list[str]) -> Column:
    return F.exists(F.coalesce(roles, F.array().cast("array<string>")), lambda r: r.isin(known))


def profile_supports(services: Column, roles: Column, query: Column, service_roles: list[str], near: Column | None = None) -> Column:
    """F16: a role of service, or a likely service that meets the query; false without a profile."""
    return _has_role(roles, service_roles) | _meets(services, query, near)


def profile_contradicts(found: Column, products: Column, roles: Column, query: Column, product_roles: list[str], near: Column | None = None) -> Column:
    """F16: a profile was found that has no role of selling products and no likely product that meets the query."""
    return F.coalesce(found, F.lit(False)) & ~_has_role(roles, product_roles) & ~_meets(products, query, near)


def best_profiles(profiles: DataFrame) -> DataFrame:
    """Of each store's profiles the best by validation, then by confidence in hundredths; the newest of equals, and of those the last store type."""
    status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PROFILE_RANK.items() for x in kv]), F.coalesce("validation_status", F.lit(""))), F.lit(1))
    score = status * 1000 + F.floor(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) * 100 + 0.5)
    row = F.struct("store_type", "roles", "likely_products", "likely_services", F.col("confidence").cast("double").alias("role_confidence"))
    return profiles.groupBy("establishment_id").agg(F.max_by(row, F.struct(score.alias("s"), F.col("updated_at").alias("u"), F.col("store_type").alias("t"))).alias("profile"))


def with_profiles(rows: DataFrame, profiles: DataFrame) -> DataFrame:
    """Each row with its store's best profile, null without one."""
    return rows.join(best_profiles(profiles), "establishment_id", "left")


@dataclass
class Plausibility:
    """What F13 judges with: categories, words and roles, and the place categories that fit a product group. Everything is data of the caller."""

    service_categories: list[str] = field(default_factory=list)
    service_hints: list[str] = field(default_factory=list)
    chains: list[str] = field(default_factory=list)
    fits: dict[str, list[str]] = field(default_factory=dict)
    strict_groups: list[str] = field(default_factory=list)
    service_roles: list[str] = field(default_factory=list)
    product_roles: list[str] = field(default_factory=list)


def _name_facts(q: Column, name: Column) -> dict[str, Column]:
    """What F13 asks of a query and a product's name; never null."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    near = yes((name != "") & text.fuzzy_phrase(q, name))
    token = yes(F.exists(text.tokens(q), lambda x: (F.length(x) >= 4) & F.exists(text.tokens(name), lambda y: text.contain_each_other(x, y) | text.fuzzy_token(x, y))))
    return {"near": near, "token": token}


def _store_facts(q: Column, rules: Plausibility, near: Column | None = None) -> dict[str, Column]:
    """What F13 asks of a query and a store (name, osm_category and profile); near: the terms near the query, where these are known."""
    c = F.col
    yes = lambda x: F.coalesce(x, F.lit(False))
    return {
        "chain": yes(text.any_of(text.normalize(c("name")), rules.chains)),
        "beauty": yes(service_only_place(c("osm_category"), c("name"), rules.service_categories, rules.service_hints, rules.chains)),
        "served": profile_supports(c("profile.likely_services"), c("profile.roles"), q, rules.service_roles, near),
        "against": profile_contradicts(c("profile").isNotNull(), c("profile.likely_products"), c("profile.roles"), q, rules.product_roles, near),
    }


def name_facts(asked: DataFrame) -> DataFrame:
    """(query, normalized_name, near, token) of the pairs of which one holds, each pair judged once."""
    facts = _name_facts(F.col("query"), F.col("normalized_name"))
    return asked.select("query", "normalized_name").distinct().withColumns(facts).where("near or token")


def store_facts(stores: DataFrame, queries: list[str], rules: Plausibility) -> DataFrame:
    """(establishment_id, asked) of stores with profiles: of each query what F13 asks of the store."""
    one = lambda q: F.struct(F.lit(q).alias("query"), *[x.alias(k) for k, x in _store_facts(F.lit(q), rules).items()])
    return stores.select("establishment_id", F.array(*map(one, queries)).alias("asked"))


def place_facts(places: DataFrame, rules: Plausibility) -> DataFrame:
    """(name, osm_category, chain, beauty) of the distinct ones: what F13 asks of a store but for its profile."""
    facts = _store_facts(F.lit(""), rules)
    return places.select("name", "osm_category").distinct().withColumns({k: facts[k] for k in ("chain", "beauty")})


def plausible(rows: DataFrame, query: str | Column, lex: Lexicon, rules: Plausibility, known: bool | Collection[str] = False) -> DataFrame:
    """F13 over rows with strategy and profile: service intent needs support, text or validation; service-only places and
    group finds are guarded (F12); near names then stay; a profile may contradict all but canonical finds; the rest needs its source's confidence.

    known: rows have what is asked of their names and stores (near, token, chain, beauty, served, against) in place of profiles, or those of them that are named; others that may be named are near_terms, the terms
    near the query (no empty one), by which profiles are then judged, and specific and service, what the query is."""
    c, q = F.col, F.lit(query)
    yes = lambda x: F.coalesce(x, F.lit(False))
    name, conf = c("normalized_name"), F.coalesce(c("confidence").cast("double"), F.lit(0.0))
    validated = yes(c("validation_status") == "validated")
    owner = validated | yes(c("primary_source").isin("merchant_added", "user_validated"))
    trusted = owner | yes(c("primary_source") == "website_extracted")
    asked = ("near", "token", "chain", "beauty", "served", "against")
    known = (asked if known else ()) if isinstance(known, bool) else known
    facts = _name_facts(q, name) | _store_facts(q, rules, c("near_terms") if "near_terms" in known else None) if set(asked) - set(known) else {}
    facts |= {k: c(k) for k in known if k in asked}
    near, token, chain, beauty, served, against = (facts[k] for k in ("near", "token", "chain", "beauty", "served", "against"))
    specific, service = (c(k) if k in known else f(q, lex) for k, f in (("specific", is_specific), ("service", is_service)))
    at = lambda xs: yes(c("osm_category").isin(xs)) | yes(c("app_category").isin(xs))
    fit = F.lit(False)
    for group, places in rules.fits.items():
        fit = fit | (yes(c("product_group") == group) & at(places))
    strategy = F.when(c("strategy") == 2, "canonical").otherwise("other")
    rejected = yes(c("validation_status") == "rejected")
    # The guard's rule on service places asks for the owner's word; a website is enough for its later rules.
    unserved = specific & ~(near | token) & at(rules.service_categories) & ~chain & ~owner
    guard = ~unserved & fallback_guard(specific, near | token, F.lit(False), chain, trusted, strategy, rejected, fit, conf, yes(c("product_group").isin(rules.strict_groups)), token)
    # A profile's texts are read last, for rows that all else lets pass.
    rest = (conf >= scores.min_confidence(c("primary_source"))) & ~(specific & (c("strategy") != 2) & against)
    # One condition, as optimizers would move parts of it into the joins before, where each pair that meets is judged.
    return rows.where(F.when(specific & beauty & ~owner, False).otherwise(guard & (~service | near | validated | served) & (near | rest)))


def shown_stores(establishments: DataFrame) -> DataFrame:
    """Places whose pairs may be shown, as the serving dataset has them."""
    e = establishments.where("active_status in ('active', 'temporarily_closed') and not closed_candidate and duplicate_of is null")
    return e.select(F.col("id").alias("establishment_id"), F.col("name"), "district", "lat", "lon", "osm_category", "app_category", F.col("freshness").alias("est_freshness"), "opening_hours", "website")


def shown_pairs(merged: DataFrame) -> DataFrame:
    """Merged pairs that may be shown, without the lists, which no search reads."""
    return merged.where("validation_status <> 'rejected'").drop("merged_sources", "merged_methods", "candidate_ids")


def shown_products(products: DataFrame) -> DataFrame:
    return products.select(F.col("id").alias("product_id"), "normalized_name", "product_group", "priority")


def serving(merged: DataFrame, establishments: DataFrame, products: DataFrame) -> DataFrame:
    """The serving dataset, one row a pair that may be shown; products are the small side, if their plan says so.

    It has what searches read, as the view that it follows: the lists of a pair's sources, methods and candidates stay in the merged table, so no list is gathered for it."""
    return shown_pairs(merged).join(shown_stores(establishments), "establishment_id").join(shown_products(products), "product_id")


def write_serving(df: DataFrame, path: str) -> None:
    """Overwrite, sorted by place within files so that row groups can be skipped by a box."""
    df.sortWithinPartitions("lat", "lon").write.mode("overwrite").parquet(path)


def retrieve(rows: DataFrame, lat: float, lon: float, radius_m: float) -> DataFrame:
    """L1: the best by confidence inside the box, before the exact radius."""
    return geo.in_box(rows, geo.box(lat, lon, radius_m)).orderBy(F.col("confidence").desc_nulls_last(), F.col("last_checked_at").desc(), "establishment_id", "product_id").limit(PRE_RANK)


def cascade(rows: DataFrame, intents: list[str], product_ids: list[int], groups: list[str], name: str) -> DataFrame:
    """Q6: rows with the strategy that found them (strategy 3 category, 2 canonical, 1 group, 0 name).

    A category intent rules alone, even without rows. Else canonical products and groups; the name is tried when neither
    applies or they give fewer than 110 rows."""
    if intents:
        return rows.where(F.col("app_category").isin(intents)).withColumn("strategy", F.lit(3))
    canonical = F.col("product_id").isin(product_ids) if product_ids else F.lit(False)
    grouped = F.col("product_group").isin(groups) if groups else F.lit(False)
    named = F.col("normalized_name").contains(name) if name else F.lit(False)
    # by name, an equal name or one that holds the query.
    tagged = rows.withColumn("strategy", F.when(canonical, 2).when(grouped, 1).when(named, 0)).where("strategy is not null")
    strong = tagged.where("strategy > 0")
    n = strong.limit(FEW).count() if product_ids or groups else 0
    return tagged if n < FEW else strong


def rank_products(rows: DataFrame, query: str | Column, lat: float | Column, lon: float | Column, radius_m: float | Column, hours: Column | None = None, service_intent: bool = False, generic_places: list[str] | None = None, near: Column | None = None, meters: Column | None = None) -> DataFrame:
    """D3, F2: distance, rank and the exact radius. near, meters: whether query and name are near, and the distance, where these are known."""
    q = F.lit(query)
    n = F.col("normalized_name")
    m = meters if meters is not None else geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    rows = rows.withColumn("distance_m", m).where(F.col("distance_m") <= radius_m)
    exact, contains = n == q, text.contain_each_other(n, q)
    rank = scores.product_rank(exact, contains, near if near is not None else text.fuzzy_phrase(q, n), F.col("confidence").cast("double"), F.col("validation_status"), F.col("primary_source"), F.lit(None).cast("double"), F.col("est_freshness"), F.col("osm_category").isin(generic_places or ["mall", "department_store"]), F.lit(service_intent), F.col("distance_m"), hours if hours is not None else F.lit(1))
    return rows.withColumn("rank", rank)


def search(rows: DataFrame, query: str, lat: float, lon: float, radius_m: float = RADIUS, product_ids: list[int] | None = None, groups: list[str] | None = None, intents: list[str] | None = None, lex: Lexicon | None = None, top: int = TOP, profiles: DataFrame | None = None, rules: Plausibility | None = None) -> DataFrame:
    """Q10, the product part: box, strategies, plausibility, rank, radius, one row a place, the best few.

    With profiles and rules rows pass the whole chain F13 with their stores' profiles (N19), else the last link of it alone, confidence by source."""
    if lex and query in lex.generic:  # F24
        return rank_products(rows.limit(0), query, lat, lon, radius_m)
    lat_, lon_, r = clamp_params(lat, lon, radius_m)
    found = cascade(retrieve(rows, lat_, lon_, r), intents or [], product_ids or [], groups or [], query)
    if profiles is not None and rules is not None:
        ok = plausible(with_profiles(found, profiles), query, lex or Lexicon(), rules)
    else:
        ok = found.where(F.col("confidence") >= scores.min_confidence(F.col("primary_source")))
    return dedupe_ranked(rank_products(ok, query, lat_, lon_, r)).orderBy(F.col("rank").desc(), "establishment_id", "product_id").limit(top)


def service_fallback(services: DataFrame, exclude: DataFrame, query: str, lat: float, lon: float, radius_m: float, top: int = TOP_SERVICES) -> DataFrame:
    """Services near by, without places that already have product hits."""
    ok = services.where("validation_status <> 'rejected' and confidence >= 0.7 and (primary_source <> 'rules_generated' or confidence >= 0.78)").join(exclude.select("establishment_id").distinct(), "establishment_id", "left_anti")
    near = geo.within_radius(ok, lat, lon, radius_m)
    q, n = F.lit(query), F.col("normalized_name")
    rank = scores.service_rank(n == q, text.contain_each_other(n, q), text.fuzzy_phrase(q, n), F.col("confidence").cast("double"), F.col("validation_status"), F.col("primary_source"), F.col("distance_m"), F.lit(1))
    return near.withColumn("rank", rank).orderBy(F.col("rank").desc(), "establishment_id", "product_id").limit(top)


def category_fallback(establishments: DataFrame, categories: list[str], lat: float, lon: float, radius_m: float, top: int = TOP_CATEGORY) -> DataFrame:
    """Places of a category when neither products nor services were found."""
    e = geo.within_radius(establishments.where(F.col("app_category").isin(categories)), lat, lon, radius_m)
    return e.withColumn("rank", scores.category_rank(F.col("distance_m"))).withColumn("confidence", F.lit(0.72)).orderBy(F.col("rank").desc(), "id").limit(top)


def no_result_guidance(rows: DataFrame, lat: float, lon: float, current_km: float) -> DataFrame:
    """From the nearest hit within 15 km a radius to try, else a gap in the catalogue."""
    near = geo.within_radius(rows, lat, lon, 15_000.0).agg(F.min("distance_m").alias("nearest_m"))
    return near.select("nearest_m", geo.suggested_radius_km(F.col("nearest_m"), F.lit(current_km)).alias("suggested_km"), F.when(F.col("nearest_m").isNull(), "catalog_gap").otherwise("expand_radius").alias("advice"))


def result_filters(rows: DataFrame, open_now: bool = False, saved: DataFrame | None = None, independent: bool = False) -> DataFrame:
    """F21."""
    rows = rows.where("status = 'open'") if open_now else rows
    rows = rows.join(saved.select("establishment_id").distinct(), "establishment_id", "left_semi") if saved is not None else rows
    return rows.where("ownership = 'independent'") if independent else rows


def display_order(rows: DataFrame, n: int | None = None) -> DataFrame:
    """Open, unknown, closed; near first; rank."""
    o = rows.orderBy(F.when(F.col("status") == "open", 0).when(F.col("status") == "unknown", 1).otherwise(2), "distance_m", F.col("rank").desc(), "establishment_id")
    return o.limit(n) if n else o


def benchmark_score(canonical: Column, hit: Column, confidence: Column, trusted: Column, meters: Column) -> Column:
    """Q14."""
    return F.when(canonical, 2.0).otherwise(0.0) + F.when(hit, 2.0).otherwise(0.0) + F.least(F.lit(1.2), confidence) + F.when(trusted, 1.0).otherwise(0.0) + F.greatest(F.lit(0.0), 1 - meters / 3000)


def store_detail(rows: DataFrame, establishment_id: int, most: int = 500) -> DataFrame:
    """Q11: all offers of a store in one row."""
    mine = rows.where(F.col("establishment_id") == establishment_id).orderBy(F.col("confidence").desc(), "product_id").limit(most)
    return mine.groupBy("establishment_id", "name", "district").agg(F.array_sort(F.collect_list(F.struct("product_id", "normalized_name", "confidence"))).alias("offers"))


def catalog_search(products: DataFrame, q: str, columns: list[str], most: int = 50) -> DataFrame:
    """OR of ILIKE over columns; wildcards are taken out of the query, which is cut at 80 characters."""
    clean = q.replace("%", "").replace("_", "")[:80]
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.col(c).ilike(f"%{clean}%")
    return products.where(cond).orderBy(columns[0], "id").limit(most)


def nearest(rows: DataFrame, lat: float, lon: float, radius_m: float, top: int = 180) -> DataFrame:
    """The nearest rows within a radius."""
    return geo.within_radius(rows, lat, lon, radius_m).orderBy("distance_m", "establishment_id", "product_id").limit(top)


TESTS = {"eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "in": lambda c, v: c.isin(v), "ilike": lambda c, v: c.ilike(v), "contains": lambda c, v: c.contains(v), "not_null": lambda c, v: c.isNotNull()}


def scan(df: DataFrame, columns: list[str], where: list[tuple] | None = None, order: list[tuple[str, bool, bool]] | None = None, offset: int = 0, limit: int | None = None, count: bool = False) -> DataFrame:
    """A projection of the rows that pass all tests, (column, test, value) or ("or", tests); order by (column, descending, nulls first), a range, and the exact number of all matches."""
    one = lambda t: TESTS[t[1]](F.col(t[0]), t[2] if len(t) > 2 else None)
    for t in where or []:
        some = [one(x) for x in t[1]] if t[0] == "or" else [one(t)]
        cond = some[0]
        for x in some[1:]:
            cond = cond | x
        df = df.where(cond)
    n = df.count() if count else None
    keys = {(False, False): "asc_nulls_last", (False, True): "asc_nulls_first", (True, False): "desc_nulls_last", (True, True): "desc_nulls_first"}
    out = df.orderBy(*[getattr(F.col(c), keys[d, f])() for c, d, f in order]) if order else df
    out = out.select(*columns).offset(offset) if offset else out.select(*columns)
    out = out.limit(limit) if limit is not None else out
    return out.withColumn("total", F.lit(n).cast("long")) if count else out


def after(df: DataFrame, key: str, last, limit: int) -> DataFrame:
    """The next rows by key after one that is known; `last` None begins."""
    return (df if last is None else df.where(F.col(key) > last)).orderBy(key).limit(limit)


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """A page and the exact number of all rows."""
    n = df.count()
    return df.orderBy(*order).offset(offset).limit(limit).withColumn("total", F.lit(n).cast("long"))


def map_points(establishments: DataFrame, counts: DataFrame, district: str | None, category: str | None, limit: int) -> DataFrame:
    """Q17: active places with coordinates, filtered, newest first, with product counts."""
    e = establishments.where(geo.valid_point(F.col("lat"), F.col("lon"))).where("active_status = 'active'")
    e = e.where(F.col("district").ilike(f"%{district}%")) if district else e
    e = e.where(F.col("app_category").contains(category)) if category else e
    top = e.orderBy(F.col("id").desc()).limit(min(8000, max(200, limit)))
    return top.join(counts, "id", "left").withColumn("n_products", F.coalesce("n_products", F.lit(0)))
