"""Running sums, deep pages, greedy choices and window openings against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from vicinia import registry
from vicinia.operators import insights, ordering

SF = "/root/testdata/sf0.001"


def test_running_sums_and_numbers(spark):
    r = random.Random(1)
    rows = [(i, r.choice([1, 2, 3, None]), r.choice([5, None, -2, 7])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k int, v int")
    got = {x.id: (x.n, x.s) for x in ordering.running(df, [F.col("k").desc_nulls_last(), F.col("id")], {"n": F.lit(1), "s": F.col("v")}).collect()}
    total, want = 0, {}
    for n, (i, _, v) in enumerate(sorted(rows, key=lambda x: (-(x[1] or 0), x[0]))):
        total += v or 0
        want[i] = (n + 1, total)
    assert got == want
    assert ordering.numbered(df.limit(0), [F.col("id")]).collect() == []


@pytest.mark.parametrize("offset,limit", [(0, 10), (95, 30), (490, 30), (600, 5), (7, 0)])
def test_deep_pages(spark, offset, limit):
    df = spark.range(500).withColumn("x", (F.col("id") * 7919) % 1000)
    want = sorted(range(500), key=lambda i: ((i * 7919) % 1000, i))[offset : offset + limit]
    got = ordering.page(df, [F.col("x"), F.col("id")], offset, limit).collect()
    assert [r.id for r in got] == want and all(r.total == 500 for r in got)


@pytest.mark.parametrize("seed", range(4))
def test_greedy_choice_is_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([0, 1, 2, None]), r.choice("abcdefgh") if r.random() < 0.9 else None, r.randint(0, 9)) for i in range(120)]
    got = {x.id for x in ordering.greedy_two_key(spark.createDataFrame(rows, "id long, k1 long, k2 string, score int"), ["-score", "id"], "k1", "k2").collect()}
    a, b, want = set(), set(), set()
    for i, x, y, _ in sorted(rows, key=lambda x: (-x[3], x[0])):
        if x not in a and y not in b:
            a.add(x)
            b.add(y)
            want.add(i)
    assert got == want


def test_greedy_choice_of_a_long_chain_and_of_nothing(spark):
    """Each row hangs on the one before it: keys (0, 0), (1, 0), (1, 1), (2, 1) and so on."""
    rows = [(i, (i + 1) // 2, i // 2) for i in range(24)]
    df = spark.createDataFrame(rows, "id long, a long, b long")
    assert sorted(r.id for r in ordering.greedy_two_key(df, ["id"], "a", "b").collect()) == list(range(0, 24, 2))
    assert ordering.greedy_two_key(df.limit(0), ["id"], "a", "b").collect() == []


def test_budget(spark):
    rows = [(1, 3.0, True), (2, 3.0, False), (3, 3.0, True), (4, None, True), (5, 3.0, True), (6, 1.0, True)]
    df = spark.createDataFrame(rows, "id long, cost double, able boolean")
    got = {r.id: (r.spent_before, r.skipped) for r in ordering.within_budget(df, [F.col("id")], F.col("cost"), 6.0, F.col("able"), 2.0, 11.0).collect()}
    assert got == {1: (0.0, None), 2: (3.0, "website_signals_not_strong"), 3: (3.0, None), 4: (6.0, "run_budget_cap_reached"), 5: (6.0, "run_budget_cap_reached"), 6: (9.0, "daily_budget_cap_reached")}


@pytest.mark.parametrize("name", ["store_selection", "deep_page", "running_totals"])
def test_no_task_sees_all_rows(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and (name == "deep_page" or "SinglePartition" not in plan)


@pytest.mark.parametrize("seconds,spread", [(60, 400), (60, 20_000), (7, 100), (3_600, 10_000_000)])
def test_windows_open_as_a_loop_says(spark, seconds, spread):
    r = random.Random(seconds + spread)
    base = dt.datetime(1969, 12, 31, 23, 50)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), None if r.random() < 0.02 else base + dt.timedelta(seconds=r.randint(0, spread))) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, who string, ts timestamp")
    got = {x.event_id: x.n_in_window for x in insights.fixed_window_limit(df, "who", "ts", seconds, 3).collect()}
    opened, n, want = {}, {}, {}
    for i, k, t in sorted((x for x in rows if x[1] and x[2]), key=lambda x: (x[2], x[0])):
        if k not in opened or t >= opened[k] + dt.timedelta(seconds=seconds):
            opened[k], n[k] = t, 0
        n[k] += 1
        want[i] = n[k]
    assert got == want
