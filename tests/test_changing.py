"""Versioned tables, refreshes of what has changed, and streams that are interrupted."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from vicinia.functions import html
from vicinia.operators import insights, refresh
from vicinia.operators.merging import merge_candidates
from vicinia.operators.search import serving
from vicinia.sources import scratch
from vicinia.sources.tables import candidates, establishments, products
from vicinia.sources.versions import Versioned
from vicinia.streaming import events as st

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_versions_switch_as_a_whole(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"), "id", 8)
    assert t.read() is None and t.manifest()["version"] == 0
    t.replace(spark.range(100).withColumn("v", F.lit(1)))
    before = t.read()
    ids = spark.createDataFrame([(3,), (40,), (None,)], "id long")
    parts = t.parts_of(ids.where("id is not null"))
    assert 1 <= len(parts) <= 2
    files = {k: v for k, v in t.manifest()["parts"].items() if int(k) not in parts}
    written = t.write_parts(t.read(parts).withColumn("v", F.when(F.col("id").isin(3, 40), 2).otherwise(F.col("v"))), parts)
    assert t.read().where("v = 2").count() == 0  # written but not switched
    assert t.publish(written, before.schema, parts) == 2
    assert [r.id for r in t.read().where("v = 2").orderBy("id").collect()] == [3, 40] and t.read().count() == 100
    assert all(t.manifest()["parts"][k] == v for k, v in files.items())
    assert before.where("v = 2").count() == 0  # a reader of the old version
    assert t.vacuum() == 0 and t.replace(spark.range(5).withColumn("v", F.lit(9))) == 3 and t.vacuum() == 2
    assert t.read().count() == 5


def test_an_emptied_part_and_a_taken_number(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"), "id", 4)
    t.replace(spark.range(20).withColumn("v", F.lit(1)))
    t.replace(t.read([2]).limit(0), [2])
    assert t.read().where(t.part() == 2).count() == 0 < t.read().count()
    with pytest.raises(RuntimeError, match="another"):
        t._switch({"version": 2, "schema": None, "parts": {}, "batches": {}})
    assert t.manifest()["version"] == 2


def test_refresh_touches_only_what_changed(spark, tmp_path):
    old, e, p = candidates(spark, SF), establishments(spark, SF), products(spark, SF)
    t = Versioned(spark, str(tmp_path / "s"), "establishment_id", 64)
    refresh.refresh_serving(t, None, old, e, p)
    first = t.manifest()["parts"]
    new = old.withColumn("validation_status", F.when((F.col("establishment_id") == 4) & (F.col("product_id") % 2 == 0), "rejected").otherwise(F.col("validation_status")))
    new = new.withColumn("establishment_id", F.when((F.col("establishment_id") == 6) & (F.col("product_id") == new.select(F.min("product_id")).first()[0]), 8).otherwise(F.col("establishment_id")))
    moved = refresh.changed_owners(old, new, "id", ["product_id", "source_type", "confidence", "validation_status"])
    ids = {r[0] for r in moved.collect()}
    assert ids <= {4, 6, 8} and 4 in ids
    assert refresh.refresh_serving(t, moved, new, e, p) == len(ids)
    assert rows_of(t.read().select("establishment_id", "product_id", "confidence", "validation_status")) == rows_of(serving(merge_candidates(new), e, p).select("establishment_id", "product_id", "confidence", "validation_status"))
    touched = {k for k, v in t.manifest()["parts"].items() if first.get(k) != v}
    assert touched <= {str(x) for x in t.parts_of(moved)} and len(touched) <= 3
    assert refresh.refresh_serving(t, moved.limit(0), new, e, p) == 0 and t.manifest()["version"] == 2


def test_freshness_without_times_and_scope(spark):
    rows = spark.createDataFrame([(1, None, None, None, None, None, 0.5), (2, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 1), False, "active", 0.5)], "id long, last_seen_at timestamp, last_imported_at timestamp, last_enriched_at timestamp, closed_candidate boolean, active_status string, freshness double")
    out, n = refresh.refresh_freshness(rows, F.lit("2024-01-01").cast("timestamp"))
    assert {r.id: r.freshness for r in out.collect()} == {1: 0.05, 2: 0.99} and n.first()[0] == 2
    assert refresh.refresh_freshness(rows, F.lit("2024-01-01").cast("timestamp"), F.col("active_status") == "active")[1].first()[0] == 1


def test_a_table_is_built_again_when_its_source_changes(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "src"))
    read = lambda: scratch.built(spark, "x", str(tmp_path / "src"), lambda: spark.read.parquet(str(tmp_path / "src")), lambda df, path: df.write.parquet(path)).count()
    assert read() == 3 == read()
    spark.range(3, 5).write.mode("append").parquet(str(tmp_path / "src"))
    assert read() == 5


# ---- streams

EVENTS = "key string, n long, ts timestamp, v long"


def feed(spark, tmp_path, name, rows, files):
    for i in range(files):
        spark.createDataFrame(rows[i::files], EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return st.read_events(spark, str(tmp_path / name), spark.createDataFrame([], EVENTS).schema, 1)


def last_of(rows):
    best = {}
    for k, n, ts, v in rows:
        if k is not None and (k not in best or (ts, n) > best[k][:2]):
            best[k] = (ts, n, v)
    return {k: v[2] for k, v in best.items()}


def test_upserts_that_are_run_again_change_nothing(spark, tmp_path):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", "c", "d", None]), i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randint(0, 50)), i) for i in range(60)]
    t = Versioned(spark, str(tmp_path / "t"), "key", 4)
    e = feed(spark, tmp_path, "in", rows, 3)
    st.upsert_stream(e, t, ["ts", "n"], str(tmp_path / "c1")).awaitTermination()
    assert {x.key: x.v for x in t.read().collect()} == last_of(rows)
    version = t.manifest()["version"]
    st.upsert_stream(e, t, ["ts", "n"], str(tmp_path / "c2")).awaitTermination()  # as after a lost checkpoint: the same batches once more
    assert t.manifest()["version"] == version and {x.key: x.v for x in t.read().collect()} == last_of(rows)


def test_a_stream_that_dies_between_write_and_switch(spark, tmp_path, monkeypatch):
    rows = [("a", i, dt.datetime(2024, 1, 1, 0, 0, i), i) for i in range(10)] + [("b", 20, dt.datetime(2024, 1, 1), 7)]
    t = Versioned(spark, str(tmp_path / "t"), "key", 4)
    e = feed(spark, tmp_path, "in", rows, 2)
    switch, calls = Versioned._switch, []

    def dies(self, manifest):
        calls.append(manifest["version"])
        if len(calls) == 2:
            raise RuntimeError("killed")
        switch(self, manifest)

    monkeypatch.setattr(Versioned, "_switch", dies)
    with pytest.raises(Exception, match="killed"):
        st.upsert_stream(e, t, ["ts", "n"], str(tmp_path / "c")).awaitTermination()
    assert t.manifest()["version"] == 1
    half = {x.key: x.v for x in t.read().collect()}
    assert half and half != last_of(rows) or calls == [1, 2]
    st.upsert_stream(e, t, ["ts", "n"], str(tmp_path / "c")).awaitTermination()
    assert {x.key: x.v for x in t.read().collect()} == last_of(rows) and t.manifest()["version"] == 2


def test_sliding_look_backs_are_the_batch_at_each_day_end(spark, tmp_path):
    r = random.Random(6)
    base = dt.datetime(2024, 1, 1)
    rows = sorted(((dt.timedelta(days=r.choice([0, 1, 2, 3, 5, 9, 21, 22, 40]), seconds=r.randint(0, 86_399)), r.choice([0, 3, None, -1])) for _ in range(200)), key=lambda x: x[0])
    rows = [(base + d, v) for d, v in rows]
    schema = "ts timestamp, results long"
    for i in range(4):  # in order of time, so that nothing comes late
        spark.createDataFrame(rows[i * 50 : (i + 1) * 50], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    e = st.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    q = st.sliding_look_backs(e, "ts").writeStream.format("memory").queryName("look_backs_test").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(x.day_end, x.days): (x.n, x.unresolved, x.active_days) for x in spark.table("look_backs_test").collect()}
    batch = spark.createDataFrame(rows, schema)
    ends = sorted({d for d, _ in got})
    assert len(ends) >= 30 and len(got) == 3 * len(ends)
    for end in (ends[0], ends[5], ends[20], ends[-1]):
        want = {x.days: (x.n, x.unresolved, x.active_days) for x in insights.look_backs(batch, F.lit(end)).collect()}
        assert all(got[end, k] == want.get(k, (0, 0, 0)) for k in (30, 14, 7))


# ---- what was wrong


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ('{"a":1,"b":{"c":2},"z":null}', '{"d":[1,{"x":"y"}],"e":true,"b":"t"}', {"a": 1, "z": None, "d": [1, {"x": "y"}], "e": True, "b": "t"}),
        (None, '{"a":1.5}', {"a": 1.5}),
        ('{"a":{"deep":[[]]}}', None, {"a": {"deep": [[]]}}),
        ('{broken', '{"q":"\\u00fc\\n"}', {"q": "ü\n"}),
        ("[1]", '"text"', {}),
        ('{"a":{"k":1}}', '{"a":{"l":2}}', {"a": {"l": 2}}),
    ],
)
def test_merged_json_keeps_types(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert json.loads(df.select(html.merge_json(F.col("a"), F.col("b")).alias("m")).first().m) == want


def test_review_flags(spark):
    day = dt.date(2024, 6, 1)
    rows = [
        (1, "x", 5, 0, "active", "Mo 9:00", day, ["low_validation"], 1),
        (2, "x", 0, 0, "active", " ", day - dt.timedelta(days=120), ["missing_products", "missing_opening_hours"], 3),
        (3, None, None, None, "inactive", None, day - dt.timedelta(days=121), ["missing_categories", "missing_products", "stale_data"], 5),
        (4, "x", 5, 1, "active", "24/7", None, None, None),
        (5, " ", 5, 5, None, "", day, ["missing_categories"], 2),
    ]
    df = spark.createDataFrame([r[:7] for r in rows], "id long, app_category string, n_products long, n_validated long, active_status string, opening_hours string, updated_at date")
    flagged = insights.review_flags(df, F.lit("2024-06-01").cast("date"))
    assert {r.id: (r.flags.split("|"), r.score) for r in flagged.collect()} == {r[0]: r[7:] for r in rows if r[7]}
    assert [r.id for r in insights.review_queue(flagged, 2).collect()] == [3, 2]
    assert {r.flag: r.n for r in insights.flag_totals(flagged).collect()} == {"low_validation": 1, "missing_products": 2, "missing_opening_hours": 1, "missing_categories": 2, "stale_data": 1}


def test_district_refresh_writes_what_can_be_best(spark, monkeypatch):
    """A place of a category that sells all of a large catalogue: all candidates come back, but only the few that can be among its best are written and merged."""
    from vicinia.operators import refresh

    sizes, write = [], refresh.scratch.written

    def counted(df, name):
        out = write(df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(refresh.scratch, "written", counted)
    e = spark.createDataFrame([(1, "Mitte", "active", ["a", "b"]), (2, "Mitte", "active", ["b"]), (3, "Elsewhere", "active", ["a"])], "id long, district string, active_status string, app_categories array<string>")
    rules = spark.createDataFrame([("a", "g", "0.5"), ("b", "g", "0.7"), ("b", "q", "0.65")], "app_category string, product_group string, base string").withColumn("base_confidence", F.col("base").cast("decimal(5,4)")).drop("base")
    products = spark.range(1, 3001).selectExpr("id", "case when id % 1000 = 0 then 'q' else 'g' end as product_group", "cast(id % 7 as int) as priority")
    cands = [(10, 1, 6, "rules_generated", refresh.METHOD, "0.7", "rejected"), (11, 1, 13, "rules_generated", refresh.METHOD, "0.4", "likely"), (12, 1, 20, "merchant_added", "m", "0.9", "rejected"), (13, 2, 5, "merchant_added", "m", "0.9", "validated")]
    x = spark.createDataFrame(cands, "id long, establishment_id long, product_id long, source_type string, generation_method string, c string, validation_status string").withColumn("confidence", F.col("c").cast("decimal(5,4)")).drop("c").withColumn("checked_at", F.lit(None).cast("timestamp"))
    after, merged = refresh.district_refresh("mitte", e, rules, products, x, merge_candidates(x), 3, ["q"])
    got = {(r.establishment_id, r.product_id) for r in merged.collect()}
    assert got == {(1, 1000), (1, 13), (1, 20), (2, 5), (2, 1000), (2, 6)}
    assert max(sizes) < 100 and after.count() == 2 * 3000 + 2


def test_changed_owners_shuffle_a_row_an_owner(spark):
    cols = "establishment_id long, id long, a string, b string"
    old = [(1, 1, "x", None), (2, 2, "x", "y"), (3, 3, "x", "y"), (3, 3, "x", "y"), (4, 4, "x", "y"), (5, 5, "x", "y"), (6, 6, None, None), (7, 7, "q", ""), (8, 8, "ab", "c"), (None, 9, "x", "y"), (10, 10, "x", "y"), (10, 11, "z", "y")]
    new = [(1, 1, None, "x"), (2, 2, "x", "y"), (3, 3, "x", "y"), (5, 4, "x", "y"), (5, 5, "x", "y"), (6, 6, None, None), (7, 7, "q", None), (8, 8, "a", "bc"), (None, 9, "x", "z"), (10, 10, "z", "y"), (10, 11, "x", "y"), (11, 12, None, None)]
    changed = refresh.changed_owners(spark.createDataFrame(old, cols), spark.createDataFrame(new, cols), "id", ["a", "b"])
    assert sorted(r[0] for r in changed.collect()) == [1, 3, 4, 5, 7, 8, 10, 11]
    dealt = changed._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:]
    assert dealt and all(x.startswith("establishment_id#") and x.split(")")[0].count("#") == 1 for x in dealt)


def test_rows_put_over_the_parts(spark, tmp_path):
    t = Versioned(spark, str(tmp_path / "t"), "id", 4)
    t.replace(spark.range(20).selectExpr("id", "'old' as v"))
    before, parts = t.read(), t.manifest()["parts"]
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert t.put(ids(3, 4, 5), ids(3, 4).selectExpr("'new' as v", "id")) == 2 and t.put(ids(4, 5), ids(5, 5).selectExpr("id", "'newer' as v")) == 3
    got = sorted((r.id, r.v) for r in t.read().collect())
    assert got == sorted([(i, "old") for i in range(20) if i not in (3, 4, 5)] + [(3, "new"), (5, "newer"), (5, "newer")])
    assert t.manifest()["parts"] == parts and before.where("v = 'old'").count() == 20 and t.layers() == 2
    assert sorted((r.id, r.v) for k in range(4) for r in t.read([k]).collect()) == got
    assert t.vacuum() == 0 and sorted((r.id, r.v) for r in t.read().collect()) == got
    with pytest.raises(ValueError, match="as a whole"):
        t.replace(t.read([1]), [1])
    with pytest.raises(ValueError, match="columns"):
        t.put(ids(1), ids(1))
    t.replace(t.read())
    assert t.layers() == 0 and t.vacuum() > 0 and sorted((r.id, r.v) for r in t.read().collect()) == got


def test_a_refresh_of_all_parts_writes_what_changed(spark, tmp_path, monkeypatch):
    """Some rows of most parts change: the rest of them is not written again, and each of several refreshes gives what a full rebuild does."""
    old, e, p = candidates(spark, SF), establishments(spark, SF), products(spark, SF)
    t = Versioned(spark, str(tmp_path / "s"), "establishment_id", 2)
    refresh.refresh_serving(t, None, old, e, p)
    monkeypatch.setattr(refresh, "LAYERS", 2)
    at = lambda k: old.withColumn("confidence", F.expr(f"case when establishment_id % 10 in (4, {k}) then cast(0.5 + {k} / 100 as decimal(5,4)) else confidence end"))
    shown = ["establishment_id", "product_id", "name", "district", "normalized_name", "confidence", "validation_status"]
    layers, before = [], old
    for k in range(1, 4):
        now = at(k)
        moved = refresh.changed_owners(before, now, "id", ["confidence"])
        parts = t.manifest()["parts"]
        refresh.refresh_serving(t, moved, now, e, p)
        layers.append(t.layers())
        assert (t.manifest()["parts"] == parts) == (k < 3)
        assert rows_of(t.read().select(*shown)) == rows_of(serving(merge_candidates(now), e, p).select(*shown))
        before = now
    assert layers == [1, 2, 0]


def test_places_too_many_to_be_sent_to_all_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh, "BROADCAST", 1)
    c, e, p = candidates(spark, SF), establishments(spark, SF), products(spark, SF)
    t = Versioned(spark, str(tmp_path / "s"), "establishment_id", 8)
    refresh.refresh_serving(t, None, c, e, p)
    full = serving(merge_candidates(c), e, p)
    assert rows_of(t.read().select(*full.columns)) == rows_of(full)
