"""Pairs of places and products: all of them, dealt evenly, in an order that packs well, no work done for a pair but its row."""

import pytest
from pyspark.sql import functions as F

from vicinia.operators import candidates, catalog
from vicinia.sources import osm

EST = "id long, app_categories array<string>"


def _size(df, path):
    """Bytes a row as Parquet."""
    df.write.parquet(str(path))
    n = df.sparkSession.read.parquet(str(path)).count()
    return sum(f.stat().st_size for f in path.rglob("*.parquet")) / n


def _rules(spark):
    rows = [("a", "g", 0.5), ("b", "g", 0.7), ("b", "h", 0.8), ("c", "h", 0.6), (None, "g", 0.9)]
    return spark.createDataFrame(rows, "app_category string, product_group string, base_confidence double").withColumn("base_confidence", F.col("base_confidence").cast("decimal(5,4)"))


@pytest.mark.parametrize("most", [1_000_000, 1])
@pytest.mark.parametrize("block", [128, 2])
@pytest.mark.parametrize("with_facets", [False, True])
def test_rules_of_odd_rows(spark, monkeypatch, most, block, with_facets):
    """Null and repeated ids, null groups and categories, facets: as pair by pair."""
    monkeypatch.setattr(candidates, "BROADCAST", most)
    monkeypatch.setattr(candidates, "BLOCK", block)
    est = [(1, ["a", "b"]), (1, ["c"]), (2, ["c", None]), (None, ["b"]), (3, []), (4, None), (5, ["a", "a"])]
    prods = [(i, "g") for i in range(20)] + [(3, "h"), (None, "h"), (None, "g"), (30, None), (31, "z"), (7, "g")]
    extra = [(5, "h"), (30, "h"), (None, "g"), (6, None)] if with_facets else []
    p, f = spark.createDataFrame(prods, "id long, product_group string"), spark.createDataFrame(extra, "product_id long, facet string")
    rows = candidates.rule_candidates(spark.createDataFrame(est, EST), _rules(spark), p, f if with_facets else None).collect()
    cats = {}
    for i, cs in est:
        cats.setdefault(i, set()).update(c for c in cs or [] if c is not None)
    want = {}
    for e, cs in cats.items():
        for i, g in {*prods, *extra}:
            for c, rg, conf in [("a", "g", 0.5), ("b", "g", 0.7), ("b", "h", 0.8), ("c", "h", 0.6)]:
                if c in cs and rg == g:
                    want[e, i] = max(want.get((e, i), (0, "", "")), (conf, c, g))
    assert len(rows) == len(want) and {(r.establishment_id, r.product_id): (float(r.confidence), r.app_category, r.product_group) for r in rows} == want
    assert rows[0].asDict().keys() == {"establishment_id", "product_id", "app_category", "product_group", "confidence", "source_type", "validation_status", "why", "inferred_from"}
    assert {(r.validation_status, r.why) for r in rows if r.app_category == "b" and r.product_group == "h"} == {("likely", "category b sells h")}


def _thousands(spark):
    return spark.range(0, 3000, 1, 1), spark.range(10**6, 10**6 + 1000, 1, 1)


def test_rule_pairs_pack(spark, tmp_path):
    """Three million pairs take less than a third of a byte each; a plain join's order leaves a long run of different ids, which takes more with each further place."""
    stores, products = _thousands(spark)
    est = stores.withColumn("app_categories", F.array(F.lit("b")))
    assert _size(candidates.rule_candidates(est, _rules(spark), products.withColumn("product_group", F.lit("g"))).select("establishment_id", "product_id", "confidence"), tmp_path / "rules") < 0.3


def test_blocks_hold_a_share_of_each_kind(spark):
    """Each task has its even share of the ids of each kind, in blocks that are bounded."""
    b = candidates.blocks(spark.range(0, 64_000, 1, 1).withColumn("kind", F.col("id") % 2), ["kind"], "id")
    rows = b.select(F.spark_partition_id().alias("t"), "kind", F.size("ids").alias("n")).groupBy("t", "kind").agg(F.sum("n").alias("n"), F.max("n").alias("most")).collect()
    n = candidates.tasks(b)
    assert len(rows) == 2 * n and sum(r.n for r in rows) == 64_000 and all(r.n < 2 * 32_000 / n and r.most <= candidates.BLOCK for r in rows)


def test_template_packs(spark, tmp_path):
    assert _size(osm.template(*_thousands(spark)), tmp_path / "template") < 0.3


def test_seed_pairs_pack(spark, tmp_path):
    stores, products = _thousands(spark)
    seeds = spark.createDataFrame([("b", "group", "g", 0.7)], "category string, kind string, value string, confidence double")
    named = products.withColumn("product_group", F.lit("g")).withColumn("normalized_name", F.lit("x"))
    assert _size(catalog.seed_pairs(stores.withColumn("app_category", F.lit("b")), named, seeds), tmp_path / "seeds") < 0.3
