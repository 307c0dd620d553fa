"""Profiles and the chain of plausibility in search."""

from pyspark.sql import functions as F

from vicinia.operators import search as s

LEX = s.Lexicon(service_words=["haircut"])
RULES = s.Plausibility(service_categories=["beauty"], service_hints=["nail"], chains=["bigmart"], fits={"tools": ["hardware"]}, service_roles=["sells_services"], product_roles=["shop"])
PROFILES = [(1, "a", ["shop"], ["x"], [], 0.9, "likely", 1), (1, "b", ["shop"], ["y"], [], 0.1, "validated", 1), (1, "c", ["shop"], [], [], 0.2, "validated", 0), (2, "d", ["office"], ["paper"], [], 0.9, "likely", 1), (3, "e", ["sells_services"], ["hammer"], ["haircut"], 0.9, None, 1)]
ROWS = [  # establishment, name, place, source, status, confidence, strategy, place name
    (1, "hammer", "kiosk", "imported", "likely", 0.10, 0, "A"),  # a near name stays below its source's confidence
    (2, "hamer", "kiosk", "imported", "likely", 0.90, 0, "A"),  # near by one letter
    (2, "wrench", "hardware", "imported", "likely", 0.90, 1, "A"),  # fits, but the profile contradicts
    (2, "pliers", "hardware", "imported", "likely", 0.60, 2, "A"),  # canonical: the profile does not count
    (3, "wrench", "hardware", "imported", "likely", 0.90, 1, "A"),  # a likely product meets the query
    (4, "wrench", "hardware", "imported", "likely", 0.90, 1, "A"),  # no profile
    (5, "wrench", "hardware", "imported", "likely", 0.70, 1, "A"),  # the guard asks for 0.78
    (6, "wrench", "kiosk", "website_extracted", "likely", 0.98, 1, "A"),  # a website at 0.97 needs no fit
    (7, "wrench", "beauty", "website_extracted", "likely", 0.98, 1, "Spa"),  # but not at a service place
    (8, "hammer", "beauty", "imported", "likely", 0.90, 0, "Nail Bar"),  # service-only by name
    (9, "hammer", "beauty", "merchant_added", "likely", 0.90, 0, "Nail Bar"),  # the owner says so
]


def _rows(spark):
    names = "establishment_id long, normalized_name string, osm_category string, primary_source string, validation_status string, confidence double, strategy int, name string"
    return spark.createDataFrame(ROWS, names).withColumn("app_category", F.lit("other")).withColumn("product_group", F.lit("tools"))


def _profiles(spark):
    return spark.createDataFrame(PROFILES, "establishment_id long, store_type string, roles array<string>, likely_products array<string>, likely_services array<string>, confidence double, validation_status string, updated_at int")


def test_best_profile_by_validation_then_confidence(spark):
    assert {r.establishment_id: r.profile.store_type for r in s.best_profiles(_profiles(spark)).collect()} == {1: "c", 2: "d", 3: "e"}


def test_plausibility_of_products(spark):
    rows = s.with_profiles(_rows(spark), _profiles(spark))
    assert rows.count() == len(ROWS)
    got = {(r.establishment_id, r.normalized_name) for r in s.plausible(rows, "hammer", LEX, RULES).collect()}
    assert got == {(1, "hammer"), (2, "hamer"), (2, "pliers"), (3, "wrench"), (4, "wrench"), (6, "wrench"), (9, "hammer")}


def test_plausibility_under_service_intent(spark):
    rows = s.with_profiles(_rows(spark).where("normalized_name = 'wrench' and osm_category = 'hardware' and confidence > 0.8"), _profiles(spark))
    assert {r.establishment_id for r in s.plausible(rows, "haircut", LEX, RULES).collect()} <= {3}


def test_search_takes_profiles_and_rules(spark):
    at = _rows(spark).withColumn("lat", F.lit(52.5)).withColumn("lon", 13.4 + F.col("establishment_id") / 1000).withColumn("product_id", F.monotonically_increasing_id()).withColumn("last_checked_at", F.lit(1)).withColumn("est_freshness", F.lit(0.5))
    at = at.withColumn("name", F.concat("name", F.lit(" "), F.col("establishment_id").cast("string"))).drop("strategy")
    find = lambda **k: {r.establishment_id for r in s.search(at, "hammer", 52.5, 13.4, 5000, groups=["tools"], lex=LEX, **k).collect()}
    assert find() >= {5, 7, 8} and not find(profiles=_profiles(spark), rules=RULES) & {5, 7, 8}
