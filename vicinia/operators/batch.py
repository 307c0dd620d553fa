"""Many searches at once: tables of searches meet places by grid cells, and offers by place.

A search's radius decides the size of its cells (a power of two of the smallest), so nine cells around it hold all that its box can
reach; a place stands in one cell of each size in use. Searches from one point with one radius share their retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from vicinia.functions import geo, scores, text
from vicinia.operators import search as s
from vicinia.operators.merging import fingerprint
from vicinia.sources import scratch

#: Meters of the smallest cells; sizes double from there.
CELL = 250.0
#: Meters of the first ring of a nearest-neighbour search; rings double.
RING = 500.0
#: Pairs of a query and a name that are judged apart from rows at most.
PAIRS = 1_000_000
#: A band of the best rows is this share of the next one.
SHARE = 0.25


def _level(radius_m: Column) -> Column:
    return F.greatest(F.lit(0), F.ceil(F.log2(radius_m / CELL))).cast("int")


def _height(level: Column) -> Column:
    """Degrees of latitude of a cell of a level."""
    return CELL * F.pow(F.lit(2.0), level) / geo.METERS_A_DEGREE


def _column(lon: Column, band: Column, height: Column) -> Column:
    """The cell's place within its band; cells widen with the latitude, counted two bands further, so that a neighbour is never narrower than the reach of one here."""
    far = F.least(F.lit(89.0), F.greatest(F.abs((band - 2) * height), F.abs((band + 3) * height)))
    return F.floor(lon / (height / F.greatest(F.lit(0.01), F.cos(F.radians(far)))))


def box_join(searches: DataFrame, places: DataFrame) -> DataFrame:
    """F1 over a table of searches: each search (lat, lon, radius_m and any other columns) with the places in its box; places' lat and lon
    become place_lat and place_lon. Points that are not valid meet nothing. The box is that of geo.box: 100 meters at least, cut at the poles and the date line."""
    r = F.greatest(F.lit(100.0), F.col("radius_m").cast("double"))
    q = searches.where(geo.valid_point(F.col("lat"), F.col("lon")) & F.col("radius_m").isNotNull()).withColumn("level", _level(r))
    p = places.where(geo.valid_point(F.col("lat"), F.col("lon"))).withColumnRenamed("lat", "place_lat").withColumnRenamed("lon", "place_lon")
    levels = q.select("level").distinct()  # a dozen at most: radii are within 100 m and half the globe
    p = p.join(F.broadcast(levels)).withColumn("height", _height(F.col("level"))).withColumn("band", F.floor(F.col("place_lat") / F.col("height")))
    p = p.withColumn("cell", _column(F.col("place_lon"), F.col("band"), F.col("height"))).drop("height")
    step = F.array(*[F.lit(x) for x in (-1, 0, 1)])
    q = q.withColumn("height", _height(F.col("level"))).withColumn("dy", F.explode(step)).withColumn("band", F.floor(F.col("lat") / F.col("height")) + F.col("dy"))
    q = q.withColumn("dx", F.explode(step)).withColumn("cell", _column(F.col("lon"), F.col("band"), F.col("height")) + F.col("dx")).drop("dx", "dy", "height")
    dlat, dlon = r / geo.METERS_A_DEGREE, r / (geo.METERS_A_DEGREE * F.greatest(F.lit(0.1), F.abs(F.cos(F.radians("lat")))))
    inside = F.col("place_lat").between(F.col("lat") - dlat, F.col("lat") + dlat) & F.col("place_lon").between(F.col("lon") - dlon, F.col("lon") + dlon)
    return q.join(p, ["level", "band", "cell"]).where(inside).drop("level", "band", "cell")


def radius_join(searches: DataFrame, places: DataFrame) -> DataFrame:
    """box_join with distance_m, within the radius."""
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("place_lat"), F.col("place_lon"))
    return box_join(searches, places).withColumn("distance_m", d).where(F.col("distance_m") <= F.col("radius_m"))


def nearest_join(searches: DataFrame, places: DataFrame, k: int, max_m: float, ring: float = RING) -> DataFrame:
    """(search_id, place_id, distance_m, nth): the k nearest places of each search (search_id, lat, lon) within max_m, ties to the smaller place_id.

    Rings expand: all searches look within `ring` meters, those that find fewer than k within twice that, and so on to max_m. A search in a dense place never
    sees more than its first rings hold. Each round is a written table of the searches that are left; there are log2(max_m / ring) rounds."""
    spark = searches.sparkSession
    best = Window.partitionBy("search_id").orderBy("distance_m", "place_id")
    # Of places at one point only the first k by id can be among the nearest k of any search.
    places = places.select("place_id", "lat", "lon").withColumn("rn", F.row_number().over(Window.partitionBy("lat", "lon").orderBy("place_id"))).where(F.col("rn") <= k).drop("rn")
    left, done, r = searches.select("search_id", "lat", "lon"), None, min(ring, max_m)
    while True:
        near = radius_join(left.withColumn("radius_m", F.lit(r)), places).select("search_id", "place_id", "distance_m").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k)
        if r >= max_m:
            return near if done is None else done.unionByName(near)
        near = scratch.written(near, "near")
        full = near.where(F.col("nth") == k).select("search_id")
        done = near.join(full, "search_id", "left_semi") if done is None else done.unionByName(near.join(full, "search_id", "left_semi"))
        left = scratch.written(left.join(full, "search_id", "left_anti"), "left")
        if left.isEmpty():
            return done
        r = min(2 * r, max_m)


def guidance(searches: DataFrame, places: DataFrame, max_m: float = 15_000.0) -> DataFrame:
    """G4 for each search (search_id, lat, lon, current_km): its nearest place within 15 km gives the radius to try, else a gap in the catalogue."""
    near = nearest_join(searches, places, 1, max_m).select("search_id", F.col("distance_m").alias("nearest_m"))
    j = searches.select("search_id", "current_km").join(near, "search_id", "left")
    return j.select("search_id", "nearest_m", geo.suggested_radius_km(F.col("nearest_m"), F.col("current_km")).alias("suggested_km"), F.when(F.col("nearest_m").isNull(), "catalog_gap").otherwise("expand_radius").alias("advice"))


def _worth(rows: DataFrame) -> Column:
    """A number that never falls as confidence does, nor, where confidence has four places, as the day of the last check does."""
    kind = rows.schema["confidence"].dataType
    day = F.coalesce(F.unix_date(F.col("last_checked_at").cast("date")), F.lit(-1)).cast("long") if isinstance(kind, DecimalType) and kind.scale <= 4 else F.lit(0)
    return F.coalesce(F.floor(F.col("confidence") * 10_000).cast("long"), F.lit(-1)) * 10_000_000 + day


def _bands(rows: DataFrame, most: int) -> list[int]:
    """Least worths of the best rows of all, four times as many in each band, from some four times `most` on to a quarter of all."""
    n, shares = rows.count(), []
    while n * SHARE ** (len(shares) + 1) > most and len(shares) < 8:
        shares.append(SHARE ** (len(shares) + 1))
    if not shares:
        return []
    cuts = rows.select(F.percentile_approx(_worth(rows), [1 - x for x in shares], 200_000)).first()[0]
    return sorted(set(cuts), reverse=True)


def retrieve(points: DataFrame, rows: DataFrame, most: int = s.PRE_RANK) -> DataFrame:
    """L1 for each point (lat, lon, radius_m): the best rows by confidence inside its box, as retrieved() finds them."""
    return retrieved(points, rows, most).join(rows, ["establishment_id", "product_id"])


def retrieved(points: DataFrame, rows: DataFrame, most: int = s.PRE_RANK, also: list[str] | None = None) -> DataFrame:
    """(search_lat, search_lon, radius_m, establishment_id, product_id and columns `also`) of the best rows by confidence inside each point's box; rows are one a (establishment, product) pair.

    Bands expand: all points look among the best rows of all, those whose box holds fewer than `most` of them among four times as many, and so on to all rows. A band has every
    row that is better than one of it, so a full box has its best. A point thus meets a few times `most` rows, however many its box holds. Each round counts by place, and writes the points
    that it fills; ids alone are ranked, and rows join those that are left."""
    at, pair = ["lat", "lon", "radius_m"], ["establishment_id", "product_id"]
    cuts = _bands(rows, most)
    worth = _worth(rows)
    band = F.lit(len(cuts))
    for i, cut in reversed(list(enumerate(cuts))):
        band = F.when(worth >= cut, i).otherwise(band)
    held = scratch.written(rows.groupBy("lat", "lon", band.alias("band")).agg(F.count("*").alias("n")), "held") if cuts else None
    left, met = scratch.written(points.select(*at), "points") if cuts else points.select(*at), None
    ids = rows.select(*pair, "lat", "lon", "confidence", "last_checked_at", *(also or []), band.alias("band"))
    here = lambda p, i: box_join(p, ids.where(F.col("band") <= i).drop("band"))
    for i in range(len(cuts)):
        seen = box_join(left, held.where(F.col("band") <= i).groupBy("lat", "lon").agg(F.sum("n").alias("n"))).groupBy(*at).agg(F.sum("n").alias("n"))
        full = scratch.written(seen.where(F.col("n") >= most).select(*at), "full")
        met = here(full, i) if met is None else met.unionByName(here(full, i))
        left = scratch.written(left.join(full, at, "left_anti"), "left")
    met = here(left, len(cuts)) if met is None else met.unionByName(here(left, len(cuts)))
    order = Window.partitionBy(*at).orderBy(F.col("confidence").desc_nulls_last(), F.col("last_checked_at").desc(), *pair)
    best = met.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
    return best.select(F.col("lat").alias("search_lat"), F.col("lon").alias("search_lon"), "radius_m", *pair, *(also or []))


def _some(x: Column) -> Column:
    return F.coalesce(F.size(x), F.lit(0)) > 0


def _among(x: Column, xs: Column) -> Column:
    return F.coalesce(F.array_contains(xs, x), F.lit(False))


def strong_finds(q: DataFrame, ids: DataFrame, point: list[str]) -> DataFrame:
    """Searches with `strong`, how many of their point's rows (point, product_id, product_group) are of a product or group that they ask for; with intents none counts. Rows are counted where they meet, not sorted."""
    c = F.col
    asks = q.where(~_some(c("intents")) & (_some(c("product_ids")) | _some(c("groups"))))
    met = asks.select("search_id", *point, "product_ids", "groups").hint("merge").join(ids.select(*point, "product_id", "product_group"), point)
    n = met.where(_among(c("product_id"), c("product_ids")) | _among(c("product_group"), c("groups"))).groupBy(*point, "search_id").agg(F.count("*").alias("strong"))
    return q.join(n, [*point, "search_id"], "left").fillna(0, ["strong"])


def cascade(rows: DataFrame) -> DataFrame:
    """Q6 for each search_id, with the number of its strong finds: intents alone where a search has some; else canonical products and groups, and names where these are not asked for or find fewer than 110."""
    c = F.col
    named = F.when(c("query") != "", c("normalized_name").contains(c("query"))).otherwise(False)
    strategy = F.when(_some(c("intents")), F.when(_among(c("app_category"), c("intents")), 3)).when(_among(c("product_id"), c("product_ids")), 2).when(_among(c("product_group"), c("groups")), 1).when(named & (c("strong") < s.FEW), 0)
    return rows.withColumn("strategy", strategy).where("strategy is not null").drop("strong")


def _with_facts(found: DataFrame, q: DataFrame, rows: DataFrame, profiles: DataFrame | None) -> DataFrame:
    """Rows with near and token, what F13 asks of their query and name, and near_terms, the terms of profiles that are near the query. Queries, names and terms repeat from row to row, so each pair
    is judged once and rows look it up, unless there are more than a million pairs: then each row is judged."""
    listed = [profiles.select(F.explode(k).alias("text")) for k in ("likely_products", "likely_services")] if profiles is not None else []
    texts = rows.select(F.col("normalized_name").alias("text")).distinct().withColumn("named", F.lit(True))
    for t in listed:
        texts = texts.unionByName(t.distinct().withColumn("named", F.lit(False)))
    queries, texts = q.select("query").distinct(), scratch.written(texts.groupBy("text").agg(F.max("named").alias("named")), "texts")
    if queries.count() * texts.count() > PAIRS:
        return found.withColumns(s._name_facts(F.col("query"), F.col("normalized_name")))
    facts = scratch.written(s.name_facts(queries.join(F.broadcast(texts.select(F.col("text").alias("normalized_name"))))), "facts")
    terms = facts.where("near").groupBy("query").agg(F.collect_list("normalized_name").alias("near_terms"))
    names = facts.join(F.broadcast(texts.where("named").select(F.col("text").alias("normalized_name"))), "normalized_name", "left_semi")
    met = found.join(F.broadcast(names), ["query", "normalized_name"], "left").fillna(False, ["near", "token"])
    return met.join(F.broadcast(terms), "query", "left") if profiles is not None else met


def search_batch(searches: DataFrame, rows: DataFrame, lex: s.Lexicon, top: int = s.TOP, profiles: DataFrame | None = None, rules: s.Plausibility | None = None) -> DataFrame:
    """Q10 for a table of searches (search_id, query, lat, lon, radius_m, product_ids, groups, intents): box, strategies, plausibility (F13 with the stores'
    best profiles, N19 and W11, where profiles and rules are given), rank, radius, one row a place, the best few of each search.

    Generic queries (F24) and points that are not valid find nothing; a missing radius is the default, and radii are kept within their range (Q13)."""
    c = F.col
    low, high = s.RADIUS_RANGE
    radius = F.least(F.greatest(F.coalesce(c("radius_m").cast("double"), F.lit(float(s.RADIUS))), F.lit(float(low))), F.lit(float(high)))
    q = searches.select("search_id", "query", "lat", "lon", radius.alias("radius_m"), "product_ids", "groups", "intents")
    # Read for its points, its queries and itself.
    q = q.where(~c("query").isin(lex.generic)) if lex.generic else q
    q = scratch.written(q.withColumns({"specific": s.is_specific(c("query"), lex), "service": s.is_service(c("query"), lex)}), "searches")
    ids = scratch.written(retrieved(q.select("lat", "lon", "radius_m").distinct(), rows, also=["product_group"]), "ids")
    found = ids.drop("product_group").join(rows, ["establishment_id", "product_id"])
    judged = profiles is not None and rules is not None
    # What a point's rows say by themselves is worked out here, before the point's searches meet them: distance, the place's fingerprint, profile and facts.
    point = ["search_lat", "search_lon", "radius_m"]
    places = rows.select("name", "osm_category")
    places = scratch.written((s.place_facts(places, rules) if judged else places.distinct()).withColumn("spelling", text.normalize(c("name"))), "places")
    found = found.join(places, found["name"].eqNullSafe(places["name"]) & found["osm_category"].eqNullSafe(places["osm_category"])).drop(places["name"]).drop(places["osm_category"])
    found = found.withColumn("fingerprint", fingerprint(c("spelling"))).withColumn("distance_m", geo.haversine(c("search_lat"), c("search_lon"), c("lat"), c("lon"))).drop("spelling")
    found = s.with_profiles(found, profiles) if judged else found
    # What a search finds is with its point from here on: windows are by search and point, which needs no further shuffle. Broadcast searches would leave rows where they are, and windows would deal far more of them.
    j = strong_finds(q.withColumnRenamed("lat", "search_lat").withColumnRenamed("lon", "search_lon"), ids, point).hint("merge").join(found, point)
    ok = _with_facts(cascade(j), q, rows, profiles if judged else None).where(c("distance_m") <= c("radius_m"))
    if judged:
        ok = s.plausible(ok, c("query"), lex, rules, known=[k for k in ("near", "token", "chain", "beauty", "near_terms", "specific", "service") if k in ok.columns])
    else:
        ok = ok.where(c("confidence") >= scores.min_confidence(c("primary_source")))
    ranked = s.rank_products(ok, c("query"), c("search_lat"), c("search_lon"), c("radius_m"), near=c("near"), meters=c("distance_m")).drop("near", "token", "chain", "beauty", "near_terms", "specific", "service")
    one = Window.partitionBy("search_id", *point, "fingerprint").orderBy(c("rank").desc(), "establishment_id", "product_id")
    ranked = ranked.withColumn("rn", F.row_number().over(one)).where("rn = 1")
    best = Window.partitionBy("search_id", *point).orderBy(c("rank").desc(), "establishment_id", "product_id")
    return ranked.withColumn("nth", F.row_number().over(best)).where(c("nth") <= top).drop("rn", "fingerprint")


def hit_rates(results: DataFrame, wanted: DataFrame, top: int = 12) -> DataFrame:
    """G-A21 over search_batch results: per group of `wanted` (search_id, persona, product_ids, words) searches, those with a wanted hit among the first few, and the mean score of the best (Q14)."""
    c = F.col
    hit = F.exists(F.coalesce("words", F.array().cast("array<string>")), lambda w: text.fuzzy_phrase(w, c("normalized_name")))
    trusted = c("primary_source").isin("merchant_added", "user_validated") | (c("validation_status") == "validated")
    j = wanted.select("search_id", "persona", c("product_ids").alias("asked"), "words").join(results.where(c("nth") <= top), "search_id", "left")
    canonical = F.coalesce(F.array_contains("asked", c("product_id")), F.lit(False))
    score = s.benchmark_score(canonical, F.coalesce(hit, F.lit(False)), c("confidence").cast("double"), F.coalesce(trusted, F.lit(False)), c("distance_m"))
    per = j.groupBy("persona", "search_id").agg(F.max(F.when(c("product_id").isNotNull(), score)).alias("best"), F.coalesce(F.max(canonical | F.coalesce(hit, F.lit(False))), F.lit(False)).alias("hit"))
    return per.groupBy("persona").agg(F.count("*").alias("searches"), F.count_if("hit").alias("hits"), F.round(F.count_if("hit") / F.count("*"), 4).alias("hit_rate"), F.round(F.avg(F.coalesce("best", F.lit(0.0))), 4).alias("mean_best"))
