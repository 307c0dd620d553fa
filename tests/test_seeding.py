"""Seeds of a catalogue and lint of a vocabulary."""

import re

import pytest
from pyspark.sql import functions as F

from vicinia.operators import catalog, merging, seeding

ENTRY = "array<struct<lang:string,term:string,priority:double,is_active:boolean>>"
SEED = f"product_id long, group_key string, normalized_name string, display_name_en string, display_name_de string, display_name_es string, synonyms array<string>, aliases {ENTRY}, facets array<string>, use_cases {ENTRY}"


@pytest.fixture(scope="module")
def seeds(spark):
    rows = [
        (1, "tools", "saw", "Saw", "Säge", None, ["saw ", "Cutter", None], [("DE", "säge", 5.0, False), (None, "cutter", 99.0, True), ("", "blade", None, None), ("en", "axe", 250.0, True), ("en", " ", 1.0, True)], ["Steel", " steel ", "", None], [("EN", "Cutting wood", None, None), ("en", "cutting WOOD", 3.0, False)]),
        (2, None, "nail", None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SEED)


def test_first_alias_of_a_language_and_spelling_stays(seeds):
    got = sorted((r.product_id, r.lang, r.alias, r.priority, r.is_active) for r in seeding.seed_aliases(seeds).collect())
    assert got == sorted([(1, "und", "saw", 100, True), (1, "en", "Saw", 90, True), (1, "de", "Säge", 90, True), (1, "und", "Cutter", 75, True), (1, "und", "blade", 70, True), (1, "en", "axe", 100, True), (2, "und", "nail", 100, True)])


def test_facets_and_use_cases(seeds):
    assert sorted((r.product_id, r.facet) for r in seeding.seed_facets(seeds).collect()) == [(1, "steel"), (1, "tools")]
    assert [tuple(r) for r in seeding.seed_use_cases(seeds).collect()] == [(1, "en", "Cutting wood", 65, True)]


def test_samples_are_capped_and_counted(spark, seeds):
    aliases = spark.createDataFrame([(1, f"a{i:02d}", i % 3) for i in range(20)] + [(1, "a00", 9), (1, " ", 9)], "product_id long, alias string, priority int")
    merged = spark.createDataFrame([(5, 1), (6, 1)], "establishment_id long, product_id long")
    products = spark.createDataFrame([(1, " ", "saws", "saw", None), (2, "g", None, "nail", 70)], "product_id long, group_key string, product_group string, normalized_name string, priority int")
    rows = seeding.family_connections(products, aliases, seeding.seed_facets(seeds), seeding.seed_use_cases(seeds), merged).collect()
    assert [r.product_id for r in rows] == [2, 1] and rows[0].aliases == [] and rows[0].store_count == 0
    one = rows[1]
    assert one.aliases == ["a00", "a02", "a05", "a08", "a11", "a14", "a17", "a01"] and one.aliases_count == 8 and one.store_count == 2 and one.group == "saws" and one.priority == 50 and one.facets == ["steel", "tools"]


def test_lint(spark):
    v = spark.createDataFrame([("a", "Saw"), ("a", "saw!"), ("b", "saw"), ("b", "iron nail"), ("c", None), ("d", "??")], "group string, term string")
    t = spark.createDataFrame([("sww", "saw"), ("nial", "nail"), ("x", "misc"), ("saw", "SAW"), ("", "saw"), ("q", None), ("hamer", "hammer")], "wrong string, right string")
    got = {(r.issue, r.severity, r.subject, r.detail) for r in seeding.vocabulary_lint(v, ["misc"], ["food"], t).collect()}
    assert got == {("group_without_terms", "error", "c", None), ("empty_term", "error", "d", "??"), ("duplicate_term", "error", "saw", "a"), ("term_in_several_groups", "warning", "saw", "a|b"), ("typo_of_itself", "warning", "saw", "saw"), ("empty_typo", "error", "", "saw"), ("empty_typo", "error", "q", None), ("unknown_typo_target", "error", "hamer", "hammer")}
    assert seeding.vocabulary_lint(v.limit(0), [], [], t.limit(0)).collect() == []


def test_json_array_or_empty(spark):
    est = spark.createDataFrame([(1,), (2,)], "establishment_id long")
    rows = spark.createDataFrame([(1, "b", 0.5), (1, "a", 0.5), (1, None, 0.9)], "establishment_id long, name string, c double")
    got = {r.establishment_id: r.products for r in catalog.products_json(est, rows, ["name", "c"], [-F.col("c"), F.col("name")]).collect()}
    assert got == {1: '[{"name":null,"c":0.9},{"name":"a","c":0.5},{"name":"b","c":0.5}]', 2: "[]"}


def test_services_merge_without_rejected_rows(spark):
    rows = [(1, 7, 3, "imported", 0.5, "likely", 1), (2, 7, 3, "merchant_added", 0.9, "rejected", 1), (3, 7, 3, "rules_generated", 0.9, "likely", 2), (4, 8, 3, "imported", 0.9, "rejected", 2)]
    df = spark.createDataFrame(rows, "id long, establishment_id long, product_id long, source_type string, confidence double, validation_status string, checked_at int")
    assert [(r.id, r.merged_sources, r.merged_candidate_ids) for r in merging.service_winner(df).collect()] == [(1, ["imported", "rules_generated"], [1, 3])]


@pytest.mark.parametrize("name", ["rule_candidates", "seed_pairs"])
@pytest.mark.parametrize("most", [1_000_000, 3])
def test_pairs_are_neither_grouped_nor_shuffled(spark, monkeypatch, name, most):
    """Rules are chosen for categories and products: no pair of place and product is dealt or grouped, with owners broadcast or dealt."""
    from vicinia.operators import candidates
    from vicinia.plans import analytics, catalog

    query = getattr(analytics if name == "rule_candidates" else catalog, name)
    pairs = lambda: {(r.establishment_id, r.product_id): r.confidence for r in query(spark, "/root/testdata/sf0.001").collect()}
    want = pairs()
    monkeypatch.setattr(candidates, "BROADCAST", most)
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((establishment_id|product_id)\S+, (establishment_id|product_id)", plan)
    assert pairs() == want and len(want) > 0
