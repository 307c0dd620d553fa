"""Catalogue maintenance: catalogue assembly, detail pages, edits, aliases, runs, SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinia.operators.candidates import block_join, blocks, unpacked


def assemble(products: DataFrame, aliases: DataFrame) -> DataFrame:
    """Q12: active products with their sorted alias sets."""
    a = aliases.groupBy("product_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return products.join(a, products.id == a.product_id, "left").drop("product_id").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def samples(children: DataFrame, key: str, value: str, order: list, most: int, name: str) -> DataFrame:
    """Q15, Q16, G-A12: the first few child values of each parent and how many of them are shown."""
    r = children.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= most)
    return r.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.col(value).alias("v")))), lambda x: x["v"]).alias(name), F.count("*").alias(f"{name}_count"))


def establishment_detail(est: DataFrame, merged: DataFrame, products: DataFrame, aliases: DataFrame, establishment_id: int, most: int = 120) -> DataFrame:
    """Q15: an establishment with its best products that are not rejected, and aliases of each."""
    p = products.select(F.col("id").alias("product_id"), "normalized_name")
    rows = merged.where((F.col("establishment_id") == establishment_id) & (F.col("validation_status") != "rejected")).orderBy(F.desc("confidence"), "product_id").limit(most)
    rows = rows.join(p, "product_id").join(samples(aliases, "product_id", "alias", [F.desc("priority"), "alias"], 8, "aliases"), "product_id", "left")
    each = rows.groupBy("establishment_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("by"), "product_id", "normalized_name", "aliases"))).alias("products"))
    return est.where(F.col("id") == establishment_id).join(each, F.col("id") == F.col("establishment_id"), "left").drop("establishment_id")


def products_json(est: DataFrame, rows: DataFrame, fields: list[str], order: list) -> DataFrame:
    """G-A17: each establishment (establishment_id and more) with its rows as a JSON array of objects in order, [] where it has none. Null fields are written."""
    one = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], F.struct(*fields).alias("row"))
    text = F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["row"]), {"ignoreNullFields": "false"})
    return est.join(rows.groupBy("establishment_id").agg(text.alias("products")), "establishment_id", "left").withColumn("products", F.coalesce("products", F.lit("[]")))


def edit(old: DataFrame, new: DataFrame, allowed: list[str], key: str = "id") -> tuple[DataFrame, DataFrame]:
    """The table after edits of allowed fields, and events with before and after; one more with added and removed categories where the sets differ."""
    fields = [c for c in allowed if c in new.columns]
    j = old.join(new.select(key, *[F.col(c).alias(f"n_{c}") for c in fields], F.lit(True).alias("hit")), key, "left")
    after = j.select(*[F.when(F.col("hit"), F.coalesce(f"n_{c}", c)).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in old.columns])
    b = old.select(key, F.struct(*fields).alias("before")).join(after.select(key, F.struct(*fields).alias("after")), key).where("not (before <=> after)")
    events = b.select(key, F.lit("establishment_edited").alias("event_type"), F.to_json("before").alias("before"), F.to_json("after").alias("after"))
    if "app_categories" in fields:
        diff = b.where(~F.array_sort(F.col("before.app_categories")).eqNullSafe(F.array_sort(F.col("after.app_categories"))))
        cats = diff.select(key, F.lit("category_set").alias("event_type"), F.to_json(F.struct(F.array_except("before.app_categories", "after.app_categories").alias("removed"))).alias("before"), F.to_json(F.struct(F.array_except("after.app_categories", "before.app_categories").alias("added"))).alias("after"))
        events = events.unionByName(cats)
    return after, events


def alias_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Aliases matched by product, language and case-blind text get the new priority and become active; others are added."""
    k = lambda df, p: df.select("product_id", "lang", F.lower(F.trim("alias")).alias("k"), *[F.col(c).alias(f"{p}_{c}") for c in ("alias", "priority", "active")])
    j = k(old, "o").join(k(new.withColumn("active", F.lit(True)), "n"), ["product_id", "lang", "k"], "full")
    return j.select("product_id", "lang", F.coalesce("o_alias", "n_alias").alias("alias"), F.coalesce("n_priority", "o_priority").alias("priority"), F.coalesce("n_active", "o_active").alias("active"))


def sync_groups(products: DataFrame) -> DataFrame:
    """group_key and product_group fill each other; family slug from the name."""
    from vicinia.functions.text import slugify

    g = F.coalesce("group_key", "product_group")
    return products.withColumn("family_slug", F.coalesce("family_slug", slugify(F.col("normalized_name")))).withColumn("product_group", F.coalesce("product_group", g)).withColumn("group_key", g)


def stamp(df: DataFrame, changed: Column | None = None) -> DataFrame:
    """updated_at of changed rows."""
    return df.withColumn("updated_at", F.when(changed if changed is not None else F.lit(True), F.current_timestamp()).otherwise(F.col("updated_at") if "updated_at" in df.columns else F.lit(None).cast("timestamp")))


def finish_runs(runs: DataFrame, items: DataFrame) -> DataFrame:
    """Runs with what their items did."""
    per = items.groupBy("run_id").agg(F.count("*").alias("items"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.sum("cost"), 6).alias("cost"))
    j = runs.join(per, "run_id", "left")
    return j.withColumn("status", F.when(F.col("items").isNull(), "empty").when(F.col("failed") == F.col("items"), "failed").otherwise("done"))


def sample_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    """A seeded sample of n rows, by a keyed hash of their id: the same however the rows are dealt out."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), "id").limit(n)


def visible(df: DataFrame) -> DataFrame:
    """rows that any reader may see: not switched off, and not rejected, as far as the table has such columns."""
    for c, ok in (("is_active", F.coalesce(F.col("is_active"), F.lit(True)) if "is_active" in df.columns else None), ("validation_status", F.coalesce(F.col("validation_status"), F.lit("")) != "rejected" if "validation_status" in df.columns else None)):
        df = df.where(ok) if c in df.columns else df
    return df


def category_label(app_categories: Column, osm_category: Column, unknown: str) -> Column:
    """P8."""
    return F.coalesce(F.try_element_at(app_categories, F.lit(1)), osm_category, F.lit(unknown))


def locale_keys(*columns: str, locale: str = "de") -> list[Column]:
    """Sort keys in the order of a locale, letters before marks and case, by Spark's collation; the plain column last, for ties."""
    return [*[F.collate(F.col(c), locale) for c in columns], *[F.col(c) for c in columns]]


def result_record(rows: DataFrame) -> DataFrame:
    """Serving rows as nested records: offer, store and product structs; the name by language, the website of the store or else the row's source."""
    offer = F.struct(F.concat_ws("_", F.lit("candidate"), F.col("establishment_id").cast("string"), F.col("product_id").cast("string"), F.coalesce("primary_source", F.lit("unknown"))).alias("id"), F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)).alias("confidence"), F.coalesce("validation_status", F.lit("unvalidated")).alias("status"))
    store = F.struct(F.col("establishment_id").alias("id"), F.coalesce("name", F.lit("")).alias("name"), F.col("lat").alias("lat"), F.col("lon").alias("lng"), F.coalesce("website", "source_url").alias("website"))
    product = F.struct(F.col("product_id").alias("id"), F.coalesce("name_en", "name_de", "name_es", "normalized_name").alias("name"), F.col("normalized_name").alias("normalized_name"))
    return rows.select(offer.alias("offer"), store.alias("store"), product.alias("product"), "rank")


def register_functions(spark: SparkSession) -> None:
    """V1: SQL functions."""
    spark.sql("create or replace temporary function canonical_slugify(s string) returns string return nullif(regexp_replace(regexp_replace(lower(s), '[^a-z0-9]+', '-'), '^-+|-+$', ''), '')")
    spark.sql(
        "create or replace temporary function compute_freshness(seen double, imported double, enriched double, closed boolean, status string) returns double return "
        "round(least(0.99d, greatest(0.05d, 1d - least(0.58d, 0.010d * coalesce(seen, 365d)) - least(0.23d, 0.004d * coalesce(imported, 365d)) - least(0.15d, 0.0025d * coalesce(enriched, 365d)) "
        "- case when closed then 0.18d else 0d end - case status when 'temporarily_closed' then 0.12d when 'inactive' then 0.28d else 0d end)), 4)"
    )


def directions_url(lat: Column, lon: Column, from_lat: Column | None = None, from_lon: Column | None = None, base: str = "https://www.google.com/maps/dir/?api=1") -> Column:
    """P5."""
    pt = lambda a, b: F.concat_ws(",", a.cast("string"), b.cast("string"))
    to = F.concat(F.lit(base + "&destination="), pt(lat, lon))
    return to if from_lat is None else F.when(from_lat.isNull() | from_lon.isNull(), to).otherwise(F.concat(F.lit(base + "&origin="), pt(from_lat, from_lon), F.lit("&destination="), pt(lat, lon)))


def fill_template(c: Column, values: dict[str, Column]) -> Column:
    """P9."""
    for k, v in values.items():
        c = F.replace(c, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return c


def valid_results(rows: DataFrame) -> DataFrame:
    """Rows whose nested store, product and rank are whole."""
    return rows.where("store.id is not null and store.lat is not null and store.lng is not null and product.id is not null and rank is not null")


def seed_pairs(est: DataFrame, products: DataFrame, rules: DataFrame) -> DataFrame:
    """Pairs by a rule table (category, kind in group/name, value, confidence); the best rule of each pair; a place has one category."""
    r = rules
    by_group = products.join(r.where("kind = 'group'"), F.col("product_group") == F.col("value"))
    by_name = products.join(r.where("kind = 'name'"), F.col("normalized_name") == F.col("value"))
    # A pair's best rule is that of the place's category and the product, so rules are chosen there, and pairs are not grouped.
    offers = by_group.unionByName(by_name).groupBy(F.col("id").alias("product_id"), "category").agg(F.max("confidence").alias("confidence"))
    owners = est.select(F.col("id").alias("establishment_id"), F.col("app_category").alias("category")).distinct()
    return unpacked(block_join(blocks(offers, ["category", "confidence"], "product_id"), owners, ["category"]), "product_id").select("establishment_id", "product_id", "confidence")


def stale(df: DataFrame, at: str, days: int, as_of: Column) -> DataFrame:
    """F8."""
    return df.where(F.col(at).isNull() | (F.col(at) < as_of - F.expr(f"interval {days} days")))
