"""Refreshes: of one district as a whole, and of the serving dataset, the freshness scores and the audit log as far as something has changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinia.functions import scores
from vicinia.operators.candidates import BROADCAST, dealt_join, rule_rows, ruled
from vicinia.operators.merging import keep_latest, merge_candidates, store_order, top_k
from vicinia.operators.search import serving, shown_pairs, shown_products, shown_stores
from vicinia.sources import scratch
from vicinia.sources.versions import PART, Versioned

METHOD = "district_refresh"
#: Refreshes that are put over the serving dataset before one writes it as a whole.
LAYERS = 4


def district_refresh(district: str, establishments: DataFrame, rules: DataFrame, products: DataFrame, cands: DataFrame, merged: DataFrame, per_store: int = 12, quota_groups: list[str] | None = None, facets: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates, merged) of the places of a district after a refresh; rows of other places are not in them.

    Places are those of the district (case-blind, part of its name) that are active or closed for a time. Each gets the rule candidates of its
    categories, confidence within 0.3 and 0.99, but for pairs whose rule candidate was validated or rejected; they replace those of
    an earlier refresh. All candidates that are not rejected are merged, and the best `per_store` rows of a place, 3 to 20, stand in for
    all merged rows that are not validated. A validated pair keeps its row unless the new one is validated too.

    A place's new pairs are far more than the few that can be among its best. What a pair without other candidates is worth depends on the place's set of categories and the
    product alone, so such pairs are ranked once for each set, and a place meets as many of the first of its set as it may need: `per_store` and one for each pair that it has candidates
    of, which are merged by themselves. The candidates are worked out in full where they are read. What several steps read (the places' candidates, the best) is written once."""
    per_store = min(max(per_store, 3), 20)
    name = district.strip().replace("%", "").replace("_", "")
    if not name:
        raise ValueError("a district is needed")
    e = establishments.where(F.col("district").ilike(f"%{name}%") & F.col("active_status").isin("active", "temporarily_closed"))
    pair, ids = ["establishment_id", "product_id"], e.select(F.col("id").alias("establishment_id"))
    mine = scratch.written(cands.join(ids, "establishment_id", "left_semi"), "mine")
    own = (F.col("source_type") == "rules_generated") & (F.col("generation_method") == METHOD)
    locked = mine.where(own & F.col("validation_status").isin("validated", "rejected")).select(*pair).distinct()
    offers, sets = ruled(e, rules, products, facets)
    low = F.greatest(F.lit("0.3").cast("decimal(5,4)"), F.col("confidence")).cast("decimal(5,4)")
    row = lambda df, *first: rule_rows(df, *first).select(*first, "source_type", F.lit(METHOD).alias("generation_method"), low.alias("confidence"), "validation_status")
    # An upsert by pair, source and method: a row that is there keeps its id and gets the new values.
    old = mine.where(own).select(*pair, F.col("id").alias("old_id"))
    taken = F.coalesce("old_id", -F.abs(F.xxhash64(*pair)) - 1)
    unseen = F.lit(None).cast(cands.schema["checked_at"].dataType).alias("checked_at")

    def upserted(made: DataFrame) -> DataFrame:
        new = row(made.join(locked, pair, "left_anti"), *pair)
        fresh = new.join(old, pair, "left").select(taken.alias("id"), *pair, "source_type", "generation_method", "confidence", "validation_status", unseen)
        return mine.where(~own).select(*fresh.columns).unionByName(mine.where(own).join(new, pair, "left_anti").select(*fresh.columns)).unionByName(fresh)

    p = products.select(F.col("id").alias("product_id"), "product_group", "priority")
    worth = lambda df: merge_candidates(df, exclude_rejected=True).join(p, "product_id", "left").fillna({"product_group": "uncategorized", "priority": 50}).select(*pair, "primary_source", "confidence", "validation_status", "product_group", "priority")
    known = scratch.written(mine.select(*pair).distinct(), "known")
    others = worth(upserted(known.join(sets, "establishment_id").join(offers, ["categories", "product_id"])))
    # One row a set and product, merged as those of places are.
    each = row(offers, "categories", "product_id").withColumnRenamed("categories", "establishment_id").withColumn("id", F.lit(0).cast("long")).withColumn("checked_at", unseen)
    each = worth(each).withColumnRenamed("establishment_id", "categories")
    asks = sets.join(known.groupBy("establishment_id").agg(F.count("*").alias("held")), "establishment_id", "left").select("establishment_id", "categories", (F.coalesce("held", F.lit(0)) + per_store).cast("int").alias("asked"))
    # Lists are as long as the longest that a place asks for; a place meets the part of the next power of two.
    most = asks.agg(F.max("asked")).first()[0] or 0
    level = lambda c: F.ceil(F.log2(c.cast("double"))).cast("int")
    first = lambda df, *by: df.withColumn("rn", F.row_number().over(Window.partitionBy("categories", *by).orderBy(*store_order()))).where(F.col("rn") <= most)
    listed = first(each).drop("rn").unionByName(first(each.where(F.col("product_group").isin(quota_groups or [])), "product_group").drop("rn")) if quota_groups else first(each).drop("rn")
    listed = listed.distinct()
    for by, rn in (([], "store_rn"), (["product_group"], "group_rn")):
        listed = listed.withColumn(rn, F.row_number().over(Window.partitionBy("categories", *by).orderBy(*store_order())))
    quota = F.col("product_group").isin(quota_groups or [])
    need = F.when(quota, F.least("store_rn", "group_rn")).otherwise(F.col("store_rn"))
    listed = listed.withColumn("level", F.explode(F.sequence(level(need), F.lit(max(most - 1, 0).bit_length()))))
    # A place's own list: by rank in its set, or in the group where the group has a place of its own.
    met = dealt_join(asks.withColumn("level", level(F.col("asked"))), listed, ["categories", "level"], "establishment_id")
    met = met.where((F.col("store_rn") <= F.col("asked")) | (quota & (F.col("group_rn") <= F.col("asked")))).join(known, pair, "left_anti")
    best = top_k(met.select(*others.columns).unionByName(others), per_store, quota_groups)
    safe = merged.join(ids, "establishment_id", "left_semi").where("validation_status = 'validated'").select(*pair, "confidence", "validation_status")
    rows, safe = scratch.written(best.select(*pair, "confidence", "validation_status"), "best"), scratch.written(safe, "safe")
    # A new row takes the place of a validated one only if it is validated as well.
    put = rows.where("validation_status = 'validated'").unionByName(rows.where("validation_status <> 'validated'").join(safe, pair, "left_anti"))
    return upserted(dealt_join(offers, sets, ["categories"]).select(*pair, "app_category", "product_group", "confidence")), put.unionByName(safe.join(put, pair, "left_anti"))


def changed_owners(old: DataFrame, new: DataFrame, key: str, values: list[str], owner: str = "establishment_id") -> DataFrame:
    """The owners of rows that were added, dropped or changed between two snapshots (the keys that K3 finds), on both sides where a row moved.

    An owner's rows of the two sides are told apart by their number and the sums of two 64-bit hashes of each, so rows that are on both sides cancel out, keys that repeat do no harm, and
    what is shuffled is one row a task and owner, not all rows of both sides. A change that leaves both sums as they were, by a chance of 2^-128, would go unseen."""
    rows = lambda df, sign: df.select(owner, key, *values, F.lit(sign).alias("sign"))
    r = rows(old, 1).unionByName(rows(new, -1)).where(F.col(owner).isNotNull())
    # A hash passes over nulls, so which columns are null is hashed as well. Halves are summed, as sums of whole hashes would overflow.
    gaps = [F.col(c).isNull() for c in (key, *values)]
    halves = [F.col("sign") * x for h in ("h1", "h2") for x in (F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
    r = r.select(owner, F.col("sign").cast("long").alias("sign"), *[F.xxhash64(F.lit(seed), *gaps, key, *values).alias(h) for h, seed in (("h1", 1), ("h2", 2))])
    sums = r.groupBy(owner).agg(F.sum("sign").alias("s0"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(halves, 1)])
    return sums.where(" or ".join(f"s{i} <> 0" for i in range(len(halves) + 1))).select(owner)


def _dealt_serving(store: Versioned, cands: DataFrame, establishments: DataFrame, products: DataFrame, sources: list[str] | None) -> DataFrame:
    """The serving dataset of some candidates, dealt to the store's parts. What a pair's place says is the widest part of a row and joins it only when it has been dealt, if places are few enough to be sent to all tasks."""
    shown = shown_stores(establishments)
    if shown.limit(BROADCAST + 1).count() > BROADCAST:
        return store.dealt(serving(merge_candidates(cands, sources=sources), establishments, products))
    mine = cands.join(F.broadcast(shown.select("establishment_id")), "establishment_id", "left_semi")
    pairs = shown_pairs(merge_candidates(mine, sources=sources)).join(shown_products(products), "product_id")
    return store.dealt(pairs).join(F.broadcast(shown), "establishment_id")


def refresh_serving(store: Versioned, changed: DataFrame | None, cands: DataFrame, establishments: DataFrame, products: DataFrame, sources: list[str] | None = None) -> int:
    """The serving dataset after a change, as a new version; the number of establishments worked out anew.

    `changed` names establishments whose candidates or own rows differ from those that the store was built from; None builds all. Only their candidates are
    merged, and only parts of the table that hold them are written; other parts stay as they are, file by file. If they are in more than half of the parts, which would write most of the table again for some rows
    of each part, their rows alone are put over it; the refresh after LAYERS such ones writes the whole table, so a read has few layers to leave rows out of. A change of a product's
    name or group touches the establishments that offer it, which the caller names. `sources`: as for merge_candidates."""
    if changed is None or store.read() is None:
        store.replace(_dealt_serving(store, cands, establishments, products, sources))
        return establishments.count()
    ids = scratch.written(changed.select(F.col("establishment_id").cast("long").alias("establishment_id")).where("establishment_id is not null").distinct(), "changed")
    parts = store.parts_of(ids)
    if not parts:
        return 0
    mine = establishments.join(ids.withColumnRenamed("establishment_id", "id"), "id", "left_semi")
    fresh = _dealt_serving(store, cands.join(ids, "establishment_id", "left_semi"), mine, products, sources)
    few, layers = 2 * len(parts) <= store.n, store.layers()
    if (few and not layers) or layers >= LAYERS:
        touched = None if layers else parts
        rest = store.read(touched).join(ids, "establishment_id", "left_anti")
        store.replace(rest.unionByName(fresh.drop(PART)), touched)
    else:
        store.put(ids, fresh)
    return ids.count()


def refresh_freshness(establishments: DataFrame, as_of: Column, scope: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """V1: (establishments, updated_rows) with the freshness of those in scope worked out from last_seen_at, last_imported_at and last_enriched_at; a missing time counts as a year ago."""
    days = lambda c: (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.col(c).cast("timestamp"))) / 86_400_000_000.0
    mine = F.coalesce(scope, F.lit(False)) if scope is not None else F.lit(True)
    score = scores.freshness(days("last_seen_at"), days("last_imported_at"), days("last_enriched_at"), F.coalesce("closed_candidate", F.lit(False)), F.col("active_status"))
    return establishments.withColumn("freshness", F.when(mine, score).otherwise(F.col("freshness"))), establishments.agg(F.count_if(mine).alias("updated_rows"))


def prune_audit(log: DataFrame, n: int = 1) -> tuple[DataFrame, DataFrame]:
    """V1: (log, deleted_rows) without all but the newest n (1 at least) rows of a candidate; rows of validated and rejected ones stay. Rows as JSON of K3: the new row says the status, else the old."""
    status = F.coalesce(F.get_json_object("new_row", "$.validation_status"), F.get_json_object("old_row", "$.validation_status"))
    gone = scratch.written(keep_latest(log, "candidate_id", "changed_at", "id", n, status.isin("validated", "rejected")).select("id"), "gone")
    return log.join(gone, "id", "left_anti"), gone.agg(F.count("*").alias("deleted_rows"))
