"""Truth tables and properties of the functions."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from vicinia.functions import geo, hours, html, scores, text
from vicinia.operators import merging, ordering, search


def one(spark, col, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given", "want"),
    [("  Größe ÉCOLE  ", "gro e ecole"), ("Łódź-Øl", "odz l"), ("!!!", ""), ("", ""), ("a_b\tc", "a b c"), ("été", "ete")],
)
def test_normalize(spark, given, want):
    assert one(spark, text.normalize(F.lit(given))) == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("cat", "car", False), ("cats", "cars", True), ("cats", "dogs", False), ("charger", "chargers", True), ("headphone", "headfone", True), ("abcdefg", "abcxyfg", False), ("", "", True)],
)
def test_fuzzy_token(spark, a, b, want):
    assert one(spark, text.fuzzy_token(F.lit(a), F.lit(b))) is want


def test_fuzzy_phrase_and_slug(spark):
    assert one(spark, text.fuzzy_phrase(F.lit("usb cabl"), F.lit("usb cable long"))) is True
    assert one(spark, text.fuzzy_phrase(F.lit("xylophone"), F.lit("cable"))) is False
    assert one(spark, text.slugify(F.lit("--Fünf & Drei!"))) == "funf-drei"
    assert one(spark, text.slugify(F.lit("!!!"))) is None


HOURS = [
    ("Mo-Fr 09:00-18:00", "2024-01-15 10:00:00", "open"),
    ("Mo-Fr 09:00-18:00", "2024-01-15 17:30:00", "closed"),  # 18:30 in Berlin
    ("Mo-Fr 09:00-18:00", "2024-07-15 07:30:00", "open"),  # 09:30 in summer
    ("Fr-Mo 20:00-02:00", "2024-01-20 00:30:00", "open"),  # Saturday 01:30
    ("Fr-Mo 20:00-02:00", "2024-01-17 21:00:00", "closed"),
    ("24/7", "2024-01-17 03:00:00", "open"),
    ("Sa 10:00-14:00; Su off", "2024-01-20 10:00:00", "open"),
    ("off", "2024-01-20 10:00:00", "closed"),
    ("", "2024-01-20 10:00:00", "unknown"),
    ("by appointment", "2024-01-20 10:00:00", "unknown"),
    ("08:00-12:00,13:00-24:00", "2024-01-20 22:30:00", "open"),
]


@pytest.mark.parametrize(("spec", "at", "want"), HOURS)
def test_opening_status(spark, spec, at, want):
    assert one(spark, hours.opening_status(F.lit(spec), F.lit(at).cast("timestamp"))) == want


def test_haversine(spark):
    d = lambda *p: one(spark, geo.haversine(*map(F.lit, p)))
    assert d(52.5, 13.4, 52.5, 13.4) == 0
    assert d(52.5, 13.4, 48.1, 11.5) == pytest.approx(d(48.1, 11.5, 52.5, 13.4))
    assert d(0.0, 0.0, 0.0, 180.0) == pytest.approx(math.pi * geo.EARTH_M)
    assert geo.box(90.0, 0.0, 1000)[1] == 90.0


def test_near_pairs_against_all_pairs(spark):
    r = random.Random(4)
    pts = [(i, 52.5 + r.random() * 0.05, 13.4 + r.random() * 0.05) for i in range(150)] + [(900, None, 13.4), (901, 52.5, float("nan"))]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {(x.id1, x.id2) for x in geo.near_pairs(df, 300.0).collect()}

    def hav(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * geo.EARTH_M * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    want = {(a[0], b[0]) for a in pts[:150] for b in pts[:150] if a[0] < b[0] and hav(a, b) <= 300}
    assert got == want


def test_radius_functions(spark):
    assert one(spark, geo.travel_minutes(F.lit(0.0))) == 0
    assert one(spark, geo.travel_minutes(F.lit(10.0))) == 1
    assert one(spark, geo.suggested_radius_km(F.lit(2600.0), F.lit(2.0))) == 3.0
    assert one(spark, geo.expanded_radius_km(F.lit(14.0))) == 15.0


def test_freshness_bounds(spark):
    f = lambda *a: one(spark, scores.freshness(*[F.lit(x) if x is not None else F.lit(None).cast("double") for x in a[:3]], F.lit(a[3]), F.lit(a[4])))
    assert f(0.0, 0.0, 0.0, False, "active") == 0.99
    assert f(None, None, None, True, "inactive") == 0.05
    assert f(10.0, 0.0, 0.0, False, "temporarily_closed") == 0.78


def test_lenient_json(spark):
    assert one(spark, html.lenient_json(F.lit('x {"a": {"b": 1}} y'))) == '{"a": {"b": 1}}'
    assert one(spark, html.lenient_json(F.lit("{broken"))) is None


def test_page_sample(spark):
    from vicinia.plans.pages import SAMPLE

    h = F.lit(SAMPLE)
    assert one(spark, html.title(h)) == "A & B"
    assert one(spark, html.meta_description(h)) == 'Fine "tools"'
    assert one(spark, html.headings(h)) == ["Tools"]
    assert one(spark, html.breadcrumbs(h)) == ["Start", "Saws", "Home", "Tools"]
    assert one(spark, html.hours_in_schema(h)) == "Mo-Fr 09:00-18:00"
    assert "Acme" in one(spark, html.brands(h))


def test_greedy_two_key_equals_sequential_model(spark):
    r = random.Random(2)
    rows = [(i, r.randint(0, 8), r.choice("abcdef"), r.random()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, store long, place string, rank double")
    got = {x.id for x in ordering.greedy_two_key(df, ["-rank"], "store", "place").collect()}
    s, p, want = set(), set(), set()
    for i, a, b, _ in sorted(rows, key=lambda x: -x[3]):
        if a not in s and b not in p:
            s.add(a)
            p.add(b)
            want.add(i)
    assert got == want


def test_merge_is_order_free_and_guarded(spark):
    rows = [(1, 1, 1, "ai_generated", "m", "0.9", "rejected", 1), (2, 1, 1, "merchant_added", "m", "0.5", "likely", 2), (3, 1, 1, "merchant_added", "n", "0.5", "unvalidated", 3)]
    df = spark.createDataFrame(rows, "id long, establishment_id long, product_id long, source_type string, generation_method string, c string, validation_status string, checked_at int").withColumn("confidence", F.col("c").cast("decimal(5,4)"))
    a, b = merging.merge_candidates(df).first(), merging.merge_candidates(df.orderBy(F.desc("id"))).first()
    assert a == b and a.primary_source == "merchant_added" and a.candidate_ids == [1, 2, 3] and float(a.confidence) == 0.91
    assert float(merging.merge_candidates(df, exclude_rejected=True).first().confidence) == 0.51
    assert merging.merge_candidates(df.limit(0)).count() == 0


def test_effective_query(spark):
    e = lambda *a: one(spark, search.effective_query(*[F.lit(x) for x in a]))
    assert e("lamp", "light bulb", 0.7, "product", 0, True) == "light bulb"
    assert e("lamp", "lamps", 0.5, "product", 0, True) == "lamps"
    assert e("lamp", "light bulb", 0.5, "product", 1, True) == "lamp"
    assert e("lamp", "lamps", 0.7, "product", 0, False) == "lamp"
    assert e("lamp", "", 0.9, "product", 0, True) == "lamp"


def test_rate_limit_stream_matches_batch(spark, tmp_path):
    from vicinia.operators.insights import fixed_window_limit
    from vicinia.streaming import events as st

    r = random.Random(1)
    base = dt.datetime(2024, 1, 1)
    rows = [(i, r.randint(1, 3), base + dt.timedelta(seconds=r.randint(0, 300))) for i in range(80)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = st.rate_limit(st.read_events(spark, str(tmp_path / "in"), df.schema), "user_id", "ts", 60, 5).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {x.event_id: x.allowed for x in spark.table("limited").collect()}
    want = {x.event_id: x.allowed for x in fixed_window_limit(df, "user_id", "ts", 60, 5).collect()}
    assert got == want and not all(want.values())


def test_once_each_and_split(spark, tmp_path):
    from vicinia.streaming import events as st

    rows = [(1, "a", dt.datetime(2024, 1, 1), 0, None), (2, "b", dt.datetime(2024, 1, 1), 3, None), (3, "b", dt.datetime(2024, 1, 1), 3, None)]
    df = spark.createDataFrame(rows, "event_id long, interaction_id string, ts timestamp, results int, reason string")
    df.write.parquet(str(tmp_path / "in"))
    e = st.once_each(st.read_events(spark, str(tmp_path / "in"), df.schema), "interaction_id", "ts")
    st.split_failed(e, str(tmp_path / "s"), str(tmp_path / "f"), str(tmp_path / "c")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2
    assert spark.read.parquet(str(tmp_path / "f")).count() == 1
