"""Readers, writers, scopes and small column functions that no query reaches."""

import datetime

import pytest
from pyspark.sql import functions as F

from vicinia.functions import text
from vicinia.operators import catalog, search
from vicinia.sources import osm, scratch, tables


def test_json_and_csv_round_trip(spark, tmp_path):
    rows = [(1, 'say "hi", all', None), (2, "é", 2.5)]
    df = spark.createDataFrame(rows, "id long, name string, x double")
    tables.write_json(df.coalesce(1), str(tmp_path / "j"))
    assert [tuple(r) for r in spark.read.schema(df.schema).json(str(tmp_path / "j")).orderBy("id").collect()] == rows
    (tmp_path / "whole.json").write_text('[{"a": 1},\n {"a": 2, "b": {"c": "x"}}]')
    assert [r.a for r in tables.read_json(spark, str(tmp_path / "whole.json")).orderBy("a").collect()] == [1, 2]
    tables.write_csv(df.coalesce(1), str(tmp_path / "c"))
    lines = next((tmp_path / "c").glob("part-*")).read_text().splitlines()
    assert lines[0] == "id,name,x" and lines[1] == '1,"say ""hi"", all",'
    back = spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(str(tmp_path / "c")).orderBy("id").collect()
    assert [tuple(r) for r in back] == rows


def test_first_available(spark):
    spark.range(1).createOrReplaceTempView("legacy_offers_view")
    assert tables.first_available(spark, ["no_such_table", "legacy_offers_view", "other"]) == "legacy_offers_view"
    assert tables.first_available(spark, ["no_such_table"]) is None


def test_scopes():
    boxes, city = {"moabit": (52.5, 13.3, 52.6, 13.4)}, (52.3, 13.0, 52.7, 13.8)
    assert osm.resolve_scope(boxes, city, bbox="1,2,3,4")["bbox"] == (1.0, 2.0, 3.0, 4.0)
    assert osm.resolve_scope(boxes, city, area="Mitte") == {"kind": "area", "area": "Mitte"}
    assert osm.resolve_scope(boxes, city, neighborhood="moabit")["bbox"] == boxes["moabit"] and osm.resolve_scope(boxes, city)["bbox"] == city
    with pytest.raises(ValueError, match="south"):
        osm.resolve_scope(boxes, city, bbox="3,2,1,4")


def test_serving_is_written_once_and_read_by_box(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([(1, 52.5, 13.4), (2, 10.0, 20.0)], "id long, lat double, lon double")

    for _ in range(2):
        got = scratch.built(spark, "t", str(tmp_path), make, search.write_serving).where("lat between 52 and 53").collect()
        assert [r.id for r in got] == [1]
    assert len(made) == 1


def test_unaccented_letters(spark):
    df = spark.createDataFrame([("Việt ﬁne Ǻ Straße Łódź ① Ｆｕｌｌ",), ("Café",), (None,)], "c string")
    rows = df.select(text.normalize(F.col("c")).alias("n"), text.stable_normalize(F.col("c")).alias("s")).collect()
    assert rows[0].n == "viet ne a stra e odz" and rows[0].s == "viet fine a stra e odz 1 full"
    assert rows[1].n == rows[1].s == "cafe" and rows[2].n is None


def test_phones_days_and_stamps(spark):
    df = spark.createDataFrame([(" +49 (30) 123-45", datetime.date(2024, 3, 1)), ("030/12 34", datetime.date(2024, 2, 25)), ("", datetime.date(2023, 12, 31))], "p string, d date")
    today = F.lit("2024-03-01").cast("date")
    got = df.select(text.clean_phone(F.col("p")).alias("p"), text.relative_day(F.col("d"), today).alias("d")).collect()
    assert [(r.p, r.d) for r in got] == [("+493012345", "today"), ("0301234", "5 days ago"), ("", "2023-12-31")]
    stamped = catalog.stamp(spark.createDataFrame([(1, True), (2, False)], "id int, hit boolean"), F.col("hit")).orderBy("id").collect()
    assert stamped[0].updated_at is not None and stamped[1].updated_at is None
