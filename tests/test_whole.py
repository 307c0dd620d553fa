"""Queries read whole tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from vicinia import registry
from vicinia.functions import html
from vicinia.plans.pages import SAMPLE

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()


@pytest.mark.parametrize("name,column,modulus", [("rule_candidates", "product_id", 20), ("match_products_tiered", "product_id", 20), ("rule_candidates", "establishment_id", 5), ("serving_dataset", "product_id", 25), ("plausibility_chain", "product_id", 10), ("running_totals", "id", 10)])
def test_result_has_ids_of_all_kinds(spark, name, column, modulus):
    """These, or what they read, kept to a part of their ids once: all remainders turn up in the result."""
    assert {r[0] for r in QUERIES[name](spark, SF).select((F.col(column) % modulus).cast("int")).distinct().collect()} == set(range(modulus))


@pytest.mark.parametrize("name,source,key", [("stores_per_product", "part", "p_partkey"), ("seed_children", "part", "p_partkey"), ("store_selection", "supplier", "s_suppkey"), ("nearest_places", "customer", "c_custkey"), ("guidance_batch", "customer", "c_custkey"), ("rate_limit_fixed_window", "events", "event_id")])
def test_each_row_of_the_source_has_its_own(spark, name, source, key):
    ids = {"stores_per_product": "product_id", "seed_children": "product_id", "store_selection": "id", "nearest_places": "search_id", "guidance_batch": "search_id", "rate_limit_fixed_window": "event_id"}
    want = {x[0] for x in duckdb.sql(f"select {key} from '{SF}/{source}.parquet'").fetchall()}
    got = {r[0] for r in QUERIES[name](spark, SF).select(ids[name]).distinct().collect()}
    assert got == want if name != "nearest_places" else len(got) > 0.8 * len(want)


def test_page_queries_read_the_table(spark, tmp_path):
    """The hand-written page as one row of a table among others, with what is added to each; a page of the table has its brands found."""
    rows = [(7, SAMPLE), (8, ""), (9, None), (10, "<p>Nur Werkzeug Meister</p>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    jsonld, crumbs, brands = (QUERIES[n](spark, str(tmp_path)).collect() for n in ("html_jsonld", "html_breadcrumbs", "html_brands"))
    assert sorted(r.page_id for r in jsonld) == [7] * 6 + [8] * 3 + [10] * 3
    by = {r.page_id: r for r in crumbs}
    assert set(by) == {7, 8, 9, 10} and by[7].crumbs == "Start|Saws|A & B|Home|Tools|Page 7" and by[7].description == 'Fine "tools"' and by[7].schema_hours == "Mo-Fr 09:00-18:00"
    assert by[8].crumbs == "Start|Home|Page 8" and by[8].description == 'About "8"' and by[9].description is None
    assert {r.page_id: r.brands for r in brands}[7].startswith("Acme") and "Nur Werkzeug" in {r.page_id: r.brands for r in brands}[10]


@pytest.mark.parametrize("name", ["html_breadcrumbs", "html_brands"])
def test_page_queries_give_all_pages(spark, name):
    want = {x[0] for x in duckdb.sql(f"select page_id from '{SF}/pages.parquet'").fetchall()}
    assert {r.page_id for r in QUERIES[name](spark, SF).collect()} == want


def test_template_and_lenient_json_are_over_whole_tables(spark):
    n = lambda t: spark.read.parquet(f"{SF}/{t}.parquet").count()
    assert QUERIES["store_product_template"](spark, SF).count() == n("supplier") * n("part")
    assert QUERIES["json_lenient_parse"](spark, SF).count() == n("events")


def test_lenient_json(spark):
    rows = [(1, '{"a":1}', '{"a":1}'), (2, 'Sure: {"b":{"c":2}} done', '{"b":{"c":2}}'), (3, "{no", None), (4, None, None)]
    got = spark.createDataFrame(rows, "id int, s string, want string").withColumn("found", html.lenient_json(F.col("s"))).collect()
    assert all(r.found == r.want for r in got)
