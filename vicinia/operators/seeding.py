"""Catalogue seeds: child rows of products, samples of them, and lint of a vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinia.functions import text
from vicinia.operators.catalog import samples
from vicinia.sources import scratch

# Priorities of what a seed row gives, by where it stands.
PRIORITY = {"name": 100, "display": 90, "synonym": 75, "alias": 70, "use_case": 65}
SAMPLES = {"aliases": 8, "facets": 6, "use_cases": 5}


def priority(c: Column, default: int) -> Column:
    """A whole number within 0 and 100."""
    n = c.cast("double")
    return F.when(n.isNull() | F.isnan(n), default).otherwise(F.least(F.lit(100), F.greatest(F.lit(0), F.floor(n + 0.5)))).cast("int")


def _first_of_each(items: Column, key) -> Column:
    """Of array entries with one key the first: an entry stays if no entry before it has its key. Within a row, so without a shuffle."""
    keys = F.transform(items, key)
    return F.filter(items, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def _entry(lang: Column, term: Column, rank: Column, active: Column) -> Column:
    lang = F.lower(F.trim(lang))
    return F.struct(F.when(F.coalesce(lang, F.lit("")) == "", "und").otherwise(lang).alias("lang"), F.trim(F.coalesce(term, F.lit(""))).alias("term"), rank.alias("priority"), F.coalesce(active, F.lit(True)).alias("is_active"))


def _children(df: DataFrame, items: Column, name: str) -> DataFrame:
    given = F.filter(items, lambda x: x["term"] != "")
    kept = _first_of_each(given, lambda x: F.concat_ws("::", x["lang"], F.lower(x["term"])))
    # A few bytes of seeds are much work, so rows are dealt by product, as samples of them need it, and do not stay with the one task that reads a small file.
    return df.repartition("product_id").select("product_id", F.explode(kept).alias("x")).select("product_id", "x.lang", F.col("x.term").alias(name), "x.priority", "x.is_active")


def _listed(c: Column, default: int) -> Column:
    """Entries of an array of (lang, term, priority, is_active); null for none."""
    return F.transform(c, lambda x: _entry(x["lang"], x["term"], priority(x["priority"], default), x["is_active"]))


def seed_aliases(seeds: DataFrame) -> DataFrame:
    """(product_id, lang, alias, priority, is_active): the name (100), display names of three languages (90), synonyms (75) and listed aliases (70, or their own); of one language and spelling, whatever its
    case, the first stays. seeds: product_id, normalized_name, display_name_en, _de, _es, synonyms (texts), aliases (lang, term, priority, is_active)."""
    t = F.lit(True)
    names = F.array(_entry(F.lit("und"), F.col("normalized_name"), F.lit(PRIORITY["name"]), t), *[_entry(F.lit(x), F.col(f"display_name_{x}"), F.lit(PRIORITY["display"]), t) for x in ("en", "de", "es")])
    synonyms = F.transform(F.coalesce("synonyms", F.array().cast("array<string>")), lambda x: _entry(F.lit("und"), x, F.lit(PRIORITY["synonym"]), t))
    listed = _listed(F.col("aliases"), PRIORITY["alias"])
    return _children(seeds, F.concat(names, synonyms, F.coalesce(listed, F.filter(names, lambda _: F.lit(False)))), "alias")


def seed_facets(seeds: DataFrame) -> DataFrame:
    """(product_id, facet): the group and the listed facets in lower case, each once."""
    given = F.transform(F.coalesce("facets", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    every = F.array_distinct(F.filter(F.concat(F.array("group_key"), given), lambda x: F.coalesce(x, F.lit("")) != ""))
    return seeds.select("product_id", F.explode(every).alias("facet"))


def seed_use_cases(seeds: DataFrame) -> DataFrame:
    """(product_id, lang, use_case, priority, is_active) of use_cases (lang, term, priority, is_active), 65 where none is given."""
    return _children(seeds.where("use_cases is not null"), _listed(F.col("use_cases"), PRIORITY["use_case"]), "use_case")


def family_connections(products: DataFrame, aliases: DataFrame, facets: DataFrame, use_cases: DataFrame, merged: DataFrame, top: int = 320) -> DataFrame:
    """G-A12: products with the number of stores and samples of their aliases, facets and use cases; counts are those of the samples. Highest priority first, then most stores, most aliases, name.

    A sample has each value once, by priority and then by the value. Only products that are not behind the last of the first `top` by priority and stores can
    be among them; they alone get samples."""
    def sampled(df: DataFrame, value: str, name: str) -> DataFrame:
        rank = F.coalesce("priority", F.lit(0)) if "priority" in df.columns else F.lit(0)
        one = df.where(F.trim(F.coalesce(value, F.lit(""))) != "").groupBy("product_id", F.trim(value).alias(value)).agg(F.max(rank).alias("rank"))
        return samples(one, "product_id", value, [F.desc("rank"), F.col(value)], SAMPLES[name], name)

    stores = merged.groupBy("product_id").agg(F.count("*").alias("store_count"))
    every = products.join(stores, "product_id", "left").withColumn("store_count", F.coalesce("store_count", F.lit(0))).withColumn("priority", F.coalesce("priority", F.lit(50)))
    every = scratch.written(every, "families")
    order = F.struct("priority", "store_count")
    last = every.orderBy(order.desc()).limit(top).agg(F.min(order).alias("last"))
    # Products level with the last one stay: aliases and names decide among them.
    out = scratch.written(every.join(F.broadcast(last)).where(order >= F.col("last")).drop("last"), "first-families")
    ids = out.select("product_id").distinct()
    for df, value, name in ((aliases, "alias", "aliases"), (facets.select("product_id", F.lower("facet").alias("facet")), "facet", "facets"), (use_cases, "use_case", "use_cases")):
        sample = sampled(df.join(ids, "product_id", "left_semi"), value, name)
        out = out.join(sample, "product_id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>"))).withColumn(f"{name}_count", F.coalesce(f"{name}_count", F.lit(0)))
    out = out.withColumn("group", F.coalesce(F.nullif(F.trim("group_key"), F.lit("")), F.nullif(F.trim("product_group"), F.lit("")), F.lit("uncategorized")))
    return out.orderBy(F.desc("priority"), F.desc("store_count"), F.desc("aliases_count"), "normalized_name", "product_id").limit(top)


def vocabulary_lint(vocabulary: DataFrame, generic: list[str], broad: list[str], typos: DataFrame) -> DataFrame:
    """G-A24: (issue, severity, subject, detail) over (group, term), a group without terms having one null, and typos (wrong, right):

    groups without terms, terms without letters, terms that repeat in their group (each once, with the group), terms of several groups (with the groups), and corrections that are blank, lead to themselves, or
    lead to what is neither a term, a word of one, nor a generic or broad term."""
    v = vocabulary.select("group", "term", text.normalize(F.col("term")).alias("n"))
    row = lambda df, issue, severity, subject, detail: df.select(F.lit(issue).alias("issue"), F.lit(severity).alias("severity"), subject.alias("subject"), detail.alias("detail"))
    c = F.col
    bare = v.groupBy("group").agg(F.count("term").alias("k")).where("k = 0")
    blank = v.where("term is not null and n = ''")
    repeated = v.where("n <> ''").groupBy("group", "n").agg(F.count("*").alias("k")).where("k > 1")
    shared = v.where("n <> ''").groupBy("n").agg(F.array_sort(F.collect_set("group")).alias("groups")).where("size(groups) > 1")
    words = v.select(F.explode(F.array_union(F.array("n"), text.tokens(c("n")))).alias("right_n")).where("right_n <> ''").distinct()
    t = typos.select("wrong", "right", text.normalize(c("wrong")).alias("wrong_n"), text.normalize(c("right")).alias("right_n")).fillna("", ["wrong_n", "right_n"])
    whole = t.where("wrong_n <> '' and right_n <> ''")
    known = whole.where(~c("right_n").isin(generic + broad)) if generic + broad else whole
    issues = [
        row(bare, "group_without_terms", "error", c("group"), F.lit(None).cast("string")),
        row(blank, "empty_term", "error", c("group"), c("term")),
        row(repeated, "duplicate_term", "error", c("n"), c("group")),
        row(shared, "term_in_several_groups", "warning", c("n"), F.array_join("groups", "|")),
        row(t.where("wrong_n = '' or right_n = ''"), "empty_typo", "error", c("wrong"), c("right")),
        row(whole.where("wrong_n = right_n"), "typo_of_itself", "warning", c("wrong_n"), c("right_n")),
        row(known.join(words, "right_n", "left_anti"), "unknown_typo_target", "error", c("wrong_n"), c("right_n")),
    ]
    out = issues[0]
    for x in issues[1:]:
        out = out.unionByName(x)
    return out
