"""Searches in batch against one search at a time and brute force."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from vicinia.functions import geo
from vicinia.operators import batch, search
from vicinia.plans import batch as plans
from vicinia.plans.search import LEX, _serving

SF = "/root/testdata/sf0.001"


def meters(a, b, c, d):
    h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * geo.EARTH_M * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def points(seed, n, spread):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lat, lon = r.choice([(52.5, 13.4), (-33.9, 18.4), (69.9, -20.0), (0.0, 0.0)])
        out.append((i, lat + r.uniform(-spread, spread), lon + r.uniform(-spread, spread)))
    return out


@pytest.fixture(scope="module")
def world(spark):
    searches = [(i, a, o, random.Random(i).choice([50.0, 300.0, 2_000.0, 15_000.0])) for i, a, o in points(1, 80, 0.15)] + [(900, None, 1.0, 500.0), (901, 91.0, 1.0, 500.0), (902, 52.5, 13.4, None)]
    places = points(2, 300, 0.15) + [(900, None, 2.0), (901, 1.0, 200.0)]
    return searches, places, spark.createDataFrame(searches, "search_id long, lat double, lon double, radius_m double"), spark.createDataFrame(places, "place_id long, lat double, lon double")


def valid(p):
    return p[1] is not None and p[2] is not None and abs(p[1]) <= 90 and abs(p[2]) <= 180


def test_radius_join_is_brute_force(world):
    searches, places, s, p = world
    got = {(r.search_id, r.place_id) for r in batch.radius_join(s, p).collect()}
    want = {(a[0], b[0]) for a in searches if valid(a) and a[3] is not None for b in places if valid(b) and meters(a[1], a[2], b[1], b[2]) <= a[3]}
    assert got == want and len(want) > 100


def test_box_join_is_the_box_of_one_search(world):
    searches, places, s, p = world
    got = {(r.search_id, r.place_id) for r in batch.box_join(s, p).collect()}
    want = set()
    for i, a, o, r in searches:
        if valid((i, a, o)) and r is not None:
            south, north, west, east = geo.box(a, o, r)
            want |= {(i, x[0]) for x in places if valid(x) and south <= x[1] <= north and west <= x[2] <= east}
    assert got == want


@pytest.mark.parametrize("k,most", [(1, 20_000.0), (5, 6_000.0), (400, 9_000.0)])
def test_nearest_join_is_brute_force(world, k, most):
    searches, places, s, p = world
    got = sorted((r.search_id, r.nth, r.place_id) for r in batch.nearest_join(s, p, k, most).collect())
    want = []
    for a in searches:
        if valid(a):
            near = sorted((meters(a[1], a[2], b[1], b[2]), b[0]) for b in places if valid(b))
            want += [(a[0], n + 1, i) for n, (m, i) in enumerate(x for x in near if x[0] <= most) if n < k]
    assert got == sorted(want)


def test_nearest_join_of_nothing(world):
    _, _, s, p = world
    assert batch.nearest_join(s, p.limit(0), 2, 4_000.0).collect() == [] and batch.nearest_join(s.limit(0), p, 2, 4_000.0).collect() == []


def test_batch_is_search_by_search(spark):
    """Each search of a batch against search() with the same literals."""
    rows = _serving(spark, SF)
    asked = [(1, "blue anvil", 52.5, 13.4, 9000.0, [3, 7, 12], ["promo", "economy"], []), (2, "blue", 52.45, 13.3, 15_000.0, [], [], []), (3, "rod", 52.5, 13.4, 99_000.0, [], ["small"], ["groceries"]), (4, "misc", 52.5, 13.4, 9000.0, [3], [], []), (5, "light gear", 52.41, 13.6, 12_000.0, [5], [], []), (6, "ring", None, 13.4, 9000.0, [3], [], [])]
    batched = batch.search_batch(spark.createDataFrame(asked, "search_id long, query string, lat double, lon double, radius_m double, product_ids array<bigint>, groups array<string>, intents array<string>"), rows, LEX)
    got = {i: [] for i, *_ in asked}
    for r in sorted(batched.collect(), key=lambda r: (r.search_id, r.nth)):
        got[r.search_id].append((r.establishment_id, r.product_id, r.strategy, round(r["rank"], 4)))
    for i, q, lat, lon, radius, ids, groups, intents in asked[:5]:
        one = search.search(rows, q, lat, lon, radius, product_ids=ids, groups=groups, intents=intents, lex=LEX).collect()
        assert got[i] == [(r.establishment_id, r.product_id, r.strategy, round(r["rank"], 4)) for r in one]
    assert got[6] == got[4] == [] and len(got[1]) > 0


def test_plans_send_points_not_searches(spark):
    plan = batch.search_batch(plans.searches(spark, SF), _serving(spark, SF), LEX)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan


def test_profiles_of_a_store_are_one(spark):
    best = search.best_profiles(plans.profiles(spark, SF))
    assert best.count() == best.select("establishment_id").distinct().count() == plans.profiles(spark, SF).select("establishment_id").distinct().count()
    assert best.where(F.size("profile.roles") == 0).count() == 0


def test_retrieve_by_bands_is_that_of_all_rows(spark):
    """Points in dense, sparse and empty places get the best rows of their boxes, ties and nulls included, through several bands."""
    rng = random.Random(3)
    rows, k = [], 0
    for e in range(60):
        lat, lon = (52.5 + rng.uniform(-0.004, 0.004), 13.4 + rng.uniform(-0.004, 0.004)) if e < 50 else (52.8 + e / 100, 13.0)
        for _ in range(20):
            k += 1
            rows.append((e, k, lat, lon, rng.choice(["0.9000", "0.5500", "0.5501", None]), rng.choice([dt.datetime(2024, 1, d) for d in (1, 2, 3)] + [None])))
    df = spark.createDataFrame(rows, "establishment_id long, product_id long, lat double, lon double, c string, last_checked_at timestamp").withColumn("confidence", F.col("c").cast("decimal(5,4)")).drop("c")
    points = [(52.5, 13.4, 400.0), (52.5, 13.4, 60.0), (53.31, 13.0, 900.0), (10.0, 10.0, 900.0)]
    assert len(batch._bands(df, 7)) >= 2
    got = {}
    for r in batch.retrieve(spark.createDataFrame(points, "lat double, lon double, radius_m double"), df, 7).collect():
        got.setdefault((r.search_lat, r.search_lon, r.radius_m), set()).add((r.establishment_id, r.product_id))
    for p in points:
        s, n, w, e = geo.box(*p)
        mine = [x for x in rows if s <= x[2] <= n and w <= x[3] <= e]
        mine.sort(key=lambda x: (x[4] is None, -float(x[4] or 0), x[5] is None, -(x[5].timestamp() if x[5] else 0), x[0], x[1]))
        assert got.get(p, set()) == {x[:2] for x in mine[:7]}


def test_searches_stay_with_their_point(spark):
    """Once points have their rows, nothing is dealt anew by search or by store, and a point ranks ids, not rows."""
    plan = batch.search_batch(plans.searches(spark, SF), _serving(spark, SF), LEX, profiles=plans._profiles(spark, SF), rules=plans.RULES)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(search_id" not in plan


def test_nearest_join_meets_few_places_of_one_point(spark, monkeypatch):
    """Of many places at one point a search meets k, the smallest ids."""
    met, join = [], batch.radius_join

    def counted(a, b):
        met.append(join(a, b).count())
        return join(a, b)

    monkeypatch.setattr(batch, "radius_join", counted)
    s = spark.createDataFrame([(1, 52.5, 13.4)], "search_id long, lat double, lon double")
    p = spark.range(400).selectExpr("1000 - id as place_id", "52.5e0 as lat", "13.4e0 + (id % 2) / 1000e0 as lon")
    got = [(r.place_id, r.nth) for r in batch.nearest_join(s, p, 3, 4_000.0).orderBy("nth").collect()]
    assert got == [(602, 1), (604, 2), (606, 3)] and sum(met) <= 6


def test_texts_are_judged_once_a_query_and_name(spark, monkeypatch):
    """No row of a search is taken apart into words, unless there are too many pairs of queries and names; the rows are the same."""
    ask = lambda: batch.search_batch(plans.searches(spark, SF), _serving(spark, SF), LEX, profiles=plans._profiles(spark, SF), rules=plans.RULES).select("search_id", "establishment_id", "product_id", "strategy", "rank", "nth")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    got = ask()
    assert "levenshtein" not in plan(got)
    monkeypatch.setattr(batch, "PAIRS", 0)
    each = ask()
    assert "levenshtein" in plan(each)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, each.collect())) and got.count() > 0


def test_strong_finds_are_counted_not_sorted(spark):
    """Rows of a product or group that is asked for, each once; none under intents; and no window over all that searches find."""
    point = ["search_lat", "search_lon", "radius_m"]
    asked = [(1, 0.0, [1, 9], ["g"], []), (2, 0.0, [1], [], []), (3, 0.0, None, None, None), (4, 0.0, [1], ["g"], ["x"]), (5, 1.0, [1], ["g"], []), (6, None, [1], ["g"], [])]
    q = spark.createDataFrame([(i, lat, 0.0, 5.0, p, g, x) for i, lat, p, g, x in asked], "search_id long, search_lat double, search_lon double, radius_m double, product_ids array<bigint>, groups array<string>, intents array<string>")
    ids = spark.createDataFrame([(0.0, 0.0, 5.0, 7, p, g) for p, g in [(1, "g"), (2, "g"), (3, "h"), (9, None), (None, "g")]], "search_lat double, search_lon double, radius_m double, establishment_id long, product_id long, product_group string")
    got = batch.strong_finds(q, ids, point)
    assert {r.search_id: r.strong for r in got.collect()} == {1: 4, 2: 1, 3: 0, 4: 0, 5: 0, 6: 0}
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_hit_rates_sort_no_rows_that_are_not_shown(spark):
    """Windows are over rows that have passed the chain of plausibility alone: each orders by rank."""
    plan = plans.persona_hit_rate(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "windowspecdefinition(" in x and "search_id" in x]
    assert windows and all("rank" in x for x in windows)
