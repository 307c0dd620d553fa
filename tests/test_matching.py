"""Indexed joins of texts against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from vicinia.functions import text
from vicinia.operators import matching, search


def words(seed, n=160):
    r = random.Random(seed)
    out = {"", "a", "ab", "abc", "abcd"}
    while len(out) < n:
        w = "".join(r.choice("abc") for _ in range(r.choice([1, 2, 3, 4, 5, 6, 7, 8, 9, 12])))
        out.add(w)
        for _ in range(3):
            i = r.randrange(len(w) + 1)
            w = r.choice([w[:i] + "z" + w[i:], w[:i] + w[i + 1 :], w[:i] + "y" + w[i + 1 :]])
            out.add(w)
    for size in (29, 30, 31, 32, 33, 34, 60, 200):
        w = "".join(r.choice("abcdef") for _ in range(size))
        out |= {w, w[1:], w[2:], w[:-2], "x" + w, w[:9] + "zz" + w[11:], w[:9] + w[11:] + "q", w[:5] + "u" + w[5:-1] + "vv"}
    return sorted(out)


def phrases(seed, n):
    r = random.Random(seed)
    pool = ["blue", "blu", "anvil", "anvils", "hammer", "hamer", "screwdriver", "screwdrivr", "of", "x", "repair", "repairs"]
    return sorted({" ".join(r.choice(pool) for _ in range(r.randint(0, 4))) for _ in range(n)} | {"", "b", "an", "ham", "blue anvil repair of", "crewdri"})


def frame(spark, xs, name):
    return spark.createDataFrame([(x,) for x in [*xs, *xs[:3], None]], f"{name} string")


def all_pairs(spark, xs, ys, rule, a, b):
    left, right = spark.createDataFrame([(x,) for x in xs], f"{a} string"), spark.createDataFrame([(y,) for y in ys], f"{b} string")
    return {tuple(r) for r in left.crossJoin(right).where(rule(F.col(a), F.col(b))).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_words_are_all_found(spark, seed):
    xs, ys = [w for w in words(seed) if w], [w for w in words(seed + 10) + words(seed) if w]
    ys = sorted(set(ys))
    got = matching.near_words(spark.createDataFrame([(x,) for x in xs], "a string"), spark.createDataFrame([(y,) for y in ys], "b string")).collect()
    assert len(got) == len({tuple(r) for r in got})
    assert {tuple(r) for r in got} == all_pairs(spark, xs, ys, text.fuzzy_token, "a", "b")


def test_containments_are_all_found(spark):
    xs, ys = phrases(1, 60), phrases(2, 200)
    got = matching.containments(frame(spark, xs, "needle"), frame(spark, ys, "haystack")).collect()
    assert sorted(tuple(r) for r in got) == sorted((x, y) for x in xs for y in ys if x in y)


def test_near_phrases_are_all_found(spark):
    xs, ys = phrases(3, 60), phrases(4, 200)
    got = [tuple(r) for r in matching.near_phrases(frame(spark, xs, "query"), frame(spark, ys, "term")).collect()]
    assert sorted(got) == sorted(all_pairs(spark, xs, ys, text.fuzzy_phrase, "query", "term"))


def test_plans_have_no_nested_loop(spark):
    q, t = frame(spark, phrases(5, 9), "query"), frame(spark, phrases(6, 9), "term")
    names = t.select(F.col("term").alias("name"), F.xxhash64("term").alias("product_id"))
    vocabulary = t.select(F.substring("term", 1, 2).alias("group"), "term")
    for df in (search.match_products(q, names), search.match_services(q, names.withColumnRenamed("product_id", "service_id")), search.theta_terms(q, t.withColumn("priority", F.lit(1))), search.fuzzy_terms(q, t), search.infer_groups(q, vocabulary, [])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_empty_sides(spark):
    q, t = frame(spark, ["a"], "query"), frame(spark, ["a"], "term")
    assert matching.near_phrases(q.limit(0), t).collect() == [] and matching.near_phrases(q, t.limit(0)).collect() == []


def test_phrases_stand_as_whole_words(spark):
    r = random.Random(8)
    pages = [(i, [r.choice("abcde") for _ in range(r.randint(0, 60))]) for i in range(40)] + [(90, ["the"] * 500 + ["rare", "the"])]
    phrases = ["a", "a b", "b a c", "a a", "a a a", "e d c b", "the rare", "rare the", "the the", "zz", "a zz", "", None, "a b"]
    got = {(x.page_id, x.phrase): x.n for x in matching.phrase_hits(spark.createDataFrame(pages, "page_id long, words array<string>"), spark.createDataFrame([(p,) for p in phrases], "phrase string")).collect()}
    want = {}
    for i, ws in pages:
        for p in {p for p in phrases if p}:
            ps = p.split(" ")
            n = sum(ws[k : k + len(ps)] == ps for k in range(len(ws)))
            if n:
                want[i, p] = n
    assert got == want


def test_website_candidates_by_name_synonym_and_schema(spark):
    from vicinia.operators.candidates import website_candidates

    pages = spark.createDataFrame([(1, "we sell a blue anvil here", "shop"), (2, "anvils of iron", "shop"), (3, "iron blue anvil", "none"), (4, "", "shop")], "page_id long, bag string, category string")
    products = spark.createDataFrame([(7, "tools", "blue anvil", ["iron"]), (8, "tools", "blue anvil", ["iron"]), (9, "tools", "hammer", None), (10, "misc", "we", ["sell"])], "product_id long, product_group string, name string, synonyms array<string>")
    weights = spark.createDataFrame([("shop", "tools", 0.9)], "category string, product_group string, weight double")
    schema = spark.createDataFrame([(4, "hammer drill"), (3, "anvil"), (4, "")], "page_id long, schema_name string")
    got = {(r.page_id, r.product_id): r.confidence for r in website_candidates(pages, products, weights, ["we"], schema).collect()}
    assert got == {(1, 7): 0.578, (1, 8): 0.578, (2, 7): 0.468, (2, 8): 0.468, (3, 7): 0.94, (3, 8): 0.94, (4, 9): 0.538}
    assert {(r.page_id, r.product_id) for r in website_candidates(pages, products, weights, ["we"]).collect()} == {(1, 7), (1, 8), (2, 7), (2, 8), (3, 7), (3, 8)}


def test_page_phrases_and_its_sql_count_finds_that_overlap(spark, tmp_path):
    import duckdb

    from vicinia import registry

    spark.createDataFrame([(1, "The the the end. der der"), (2, "the"), (3, None)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "the the der"), (2, "der der the end")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = {(1, "the the", 2), (1, "der der", 1), (1, "der", 2), (1, "the", 3), (1, "end", 1), (2, "the", 1)}
    assert {tuple(r) for r in registry.queries()["page_phrases"](spark, str(tmp_path)).select("page_id", "phrase", "n").collect()} == want
    assert set(con.sql(f"select page_id, phrase, n from ({registry.oracle_sql()['page_phrases']})").fetchall()) == want
