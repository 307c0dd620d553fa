"""What queries do once a row, a pair or a task, and must not do more often as tables grow."""

from pyspark.sql import functions as F


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_merge_json_parses_nothing_in_a_lambda(spark):
    from vicinia import registry
    from vicinia.functions import html

    merged = spark.createDataFrame([('{"a":1}', '{"b":2}')], "a string, b string").select(html.merge_json(F.col("a"), F.col("b")).alias("m"))
    assert merged.first().m == '{"a":1,"b":2}'
    for df in (merged, registry.queries()["json_merge"](spark, "/root/testdata/sf0.001")):
        p = plan(df)
        # A lambda's body runs once for each key; what it parses there is parsed as often.
        for body in p.split("lambdafunction(")[1:]:
            assert "parseJson" not in body.split("lambda ")[0] and "from_json" not in body.split("lambda ")[0]


def test_serving_gathers_no_lists(spark):
    from vicinia.operators.merging import merge_candidates
    from vicinia.operators.search import serving
    from vicinia.sources.tables import candidates, establishments, products

    sf = "/root/testdata/sf0.001"
    v = serving(merge_candidates(candidates(spark, sf)), establishments(spark, sf), products(spark, sf))
    assert "collect_list" not in plan(v) and "collect_set" not in plan(v)
    assert {"primary_source", "confidence", "validation_status", "last_checked_at", "name", "normalized_name"} <= set(v.columns)


def test_near_pairs_are_dealt_to_many_tasks(spark):
    from vicinia.functions import geo

    # One file of one partition, as a small table of points is: pairs must not all be made by the task that reads it.
    points = spark.range(0, 2000, 1, 1).select("id", (52.4 + F.col("id") * 7919 % 10007 / 300000).alias("lat"), (13.2 + F.col("id") * 104729 % 10009 / 200000).alias("lon"))
    pairs = geo.near_pairs(points, 400.0)
    a, b = (points.select(*[F.col(c).alias(f"{c}{k}") for c in points.columns]) for k in (1, 2))
    d = geo.haversine(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    want = a.join(b, F.col("id1") < F.col("id2")).where(d <= 400.0).select("id1", "id2", d.alias("m"))
    assert {tuple(r) for r in pairs.collect()} == {tuple(r) for r in want.collect()}
    assert pairs.select(F.spark_partition_id().alias("t")).distinct().count() > 1


def test_insert_new_by_one_aggregation(spark):
    from vicinia.operators.candidates import insert_new

    old = spark.createDataFrame([(1, "a"), (1, "a"), (None, "n")], "k int, w string")
    new = spark.createDataFrame([(1, "a", 5, "x"), (2, "b", None, "y"), (3, "c", 7, None), (3, "c", 7, None), (None, "n", 9, "z"), (1, "b", 1, "u")], "k int, w string, v int, t string")
    got = insert_new(old, new, ["k", "w"])
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(2, "b", None, "y"), (3, "c", 7, None), (None, "n", 9, "z"), (1, "b", 1, "u")], key=str)
    assert sorted(map(tuple, insert_new(old, new.drop("t"), ["k", "w"]).collect()), key=str) == sorted([(2, "b", None), (3, "c", 7), (None, "n", 9), (1, "b", 1)], key=str)
    assert sorted(map(tuple, insert_new(old.select("k"), new.select("k"), ["k"]).collect()), key=str) == [(2,), (3,), (None,)]
    # A join would hold both sides sorted, beside what is grouped.
    assert "Join" not in plan(got)


def test_stores_of_merged_rows_are_counted_once(spark):
    from vicinia import registry

    # Two aggregations of two steps: pairs, then products; no third one that makes pairs distinct again.
    assert plan(registry.queries()["stores_per_product"](spark, "/root/testdata/sf0.001")).count("HashAggregate(") == 4


def test_seeds_of_one_partition_are_dealt(spark):
    from vicinia.operators.seeding import seed_aliases

    fields = "product_id long, normalized_name string, display_name_en string, display_name_de string, display_name_es string, synonyms array<string>, aliases array<struct<lang:string,term:string,priority:double,is_active:boolean>>"
    seeds = spark.createDataFrame([(i, f"name {i}", None, None, None, None, None) for i in range(50)], fields).coalesce(1)
    assert "hashpartitioning(product_id" in plan(seed_aliases(seeds))
    assert seed_aliases(seeds).count() == 50


def test_rows_to_be_shown_are_merged_without_a_sort(spark):
    import pytest
    from pyspark.errors import PySparkException

    from vicinia.operators.merging import merge_candidates
    from vicinia.operators.search import serving
    from vicinia.plans.search import _made
    from vicinia.sources.tables import SOURCES, candidates, establishments, products

    sf = "/root/testdata/sf0.001"
    # A string among what an aggregation keeps has Spark sort all candidates, before the shuffle and after it.
    v = _made(spark, sf)
    assert "SortAggregate" not in plan(v) and "HashAggregate" in plan(v)
    # Many candidates a pair, so that sources meet.
    c = candidates(spark, sf).withColumn("product_id", F.col("product_id") % 5)
    lists = ["merged_sources", "merged_methods", "candidate_ids"]
    quick, plain = (merge_candidates(c, sources=x).drop(*lists) for x in (SOURCES, None))
    assert sorted(map(tuple, quick.collect())) == sorted(map(tuple, plain.collect())) and quick.where("n > 3").count() > 0
    assert v.columns == serving(merge_candidates(candidates(spark, sf)), establishments(spark, sf), products(spark, sf)).columns
    with pytest.raises(PySparkException, match="not among the sources: imported"):
        merge_candidates(c, sources=SOURCES[:4]).select("primary_source").collect()
    # Two sources of one weight are told apart by confidence, as before.
    rows = [(1, 1, 1, "validated", "rule", 0.5, "likely", 1), (2, 1, 1, "user_validated", "rule", 0.7, "likely", 1)]
    two = spark.createDataFrame(rows, "id long, establishment_id long, product_id long, source_type string, generation_method string, confidence double, validation_status string, checked_at int")
    assert merge_candidates(two, sources=["validated", "user_validated"]).first().primary_source == "user_validated"


def test_texts_are_judged_once_a_store_and_name(spark):
    from vicinia.operators import search as s
    from vicinia.plans import batch
    from vicinia.plans.search import LEX, _serving

    sf = "/root/testdata/sf0.001"
    got = batch.plausibility_chain(spark, sf)
    # No row of the serving dataset is taken apart into words.
    assert "levenshtein" not in plan(got) and "translate" not in plan(got)
    rows = _serving(spark, sf).withColumn("query", F.explode(F.array(*map(F.lit, batch._JUDGED)))).withColumn("strategy", F.expr("case when product_id % 3 = 0 then 2 when product_group in ('promo', 'large') then 1 else 0 end"))
    each = s.plausible(s.with_profiles(rows, batch._profiles(spark, sf)), F.col("query"), LEX, batch.RULES).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, each.collect())) and got.count() > 0


def test_pages_are_taken_apart_once(spark):
    from vicinia import registry

    # What is left of the plan reads the positions of words, which are written once, not the pages' texts.
    assert "html" not in plan(registry.queries()["website_candidates"](spark, "/root/testdata/sf0.001"))


def test_template_is_dealt_to_many_tasks(spark, monkeypatch):
    from vicinia.sources import osm

    # One file of one partition each, as small tables are: their many pairs must not all be made by one task.
    stores, products = spark.range(0, 30, 1, 1), spark.range(100, 300, 1, 1)
    want = {(s, p) for s in range(30) for p in range(100, 300)}
    for most in (osm.BROADCAST, 1):
        monkeypatch.setattr(osm, "BROADCAST", most)
        t = osm.template(stores, products)
        rows = t.select("store_id", "product_id").collect()
        assert len(rows) == len(want) and set(map(tuple, rows)) == want and t.columns == ["store_id", "product_id", "available"]
        assert t.select(F.spark_partition_id().alias("t")).distinct().count() > 4
