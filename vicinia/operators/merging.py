"""Merging, choosing and upserting of candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinia.functions.scores import choose

# Weights by which the primary source of a merged pair is chosen.
MERGE_WEIGHT = {"merchant_added": 6, "user_validated": 5, "validated": 5, "website_extracted": 4, "imported": 3, "rules_generated": 2, "ai_generated": 1}
SERVICE_PRIORITY = {"merchant_added": 6, "user_validated": 5, "website_extracted": 4, "imported": 3, "rules_generated": 2, "ai_generated": 1}


def _weight(c: Column, table: dict[str, int]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), F.lit(0))


def merge_candidates(cands: DataFrame, exclude_rejected: bool = False, weights: dict[str, int] | None = None, sources: list[str] | None = None) -> DataFrame:
    """G-A1 and G-A2: one row a (establishment, product) pair by partial aggregation alone: no window, no join back.

    The primary source is that of the highest weight, then confidence, then lowest id. Confidence is the best one plus 0.03 if any
    row is validated, else 0.01 if any is likely, 0.99 at most. Status: validated, likely, unvalidated, rejected in that order.
    exclude_rejected leaves rejected rows out first, as the scoped refresh does; a pair of only rejected rows is then gone.
    `sources` names all source types that occur, another one is an error. Where no two of them weigh the same, the highest weight alone names a pair's source, so all that is kept of a
    pair is numbers and rows are hashed; a name that goes along with a pair has all rows sorted, before and after the shuffle."""
    if exclude_rejected:
        cands = cands.where("validation_status <> 'rejected'")
    weights = weights or MERGE_WEIGHT
    w = _weight(F.col("source_type"), weights)
    best = F.struct(w.alias("w"), F.coalesce(F.col("confidence"), F.lit(-1)).alias("c"), (-F.col("id")).alias("i"))
    has = lambda s: F.max(F.col("validation_status") == s)
    primary = F.max_by("source_type", best)
    named = {weights.get(x, 0): x for x in sources or []}
    if sources and len(named) == len(set(sources)):
        stray = F.raise_error(F.concat(F.lit("not among the sources: "), F.coalesce("source_type", F.lit("null")))).cast("int")
        primary = choose(F.max(choose(F.col("source_type"), {x: k for k, x in named.items()}, stray)), named, None)
    g = cands.groupBy("establishment_id", "product_id").agg(
        primary.alias("primary_source"),
        F.array_sort(F.collect_set("source_type")).alias("merged_sources"),
        F.array_sort(F.collect_set("generation_method")).alias("merged_methods"),
        F.array_sort(F.collect_list("id")).alias("candidate_ids"),
        F.max("confidence").alias("top"),
        has("validated").alias("v"), has("likely").alias("l"), has("unvalidated").alias("u"),
        F.max("checked_at").alias("last_checked_at"),
        F.count("*").alias("n"),
    )
    bonus = F.when(F.col("v"), F.lit(0.03)).when(F.col("l"), F.lit(0.01)).otherwise(F.lit(0.0)).cast("decimal(5,4)")
    status = F.when(F.col("v"), "validated").when(F.col("l"), "likely").when(F.col("u"), "unvalidated").otherwise("rejected")
    conf = F.least(F.lit(0.99).cast("decimal(5,4)"), F.col("top") + bonus).cast("decimal(5,4)")
    return g.select("establishment_id", "product_id", "primary_source", "merged_sources", "merged_methods", "candidate_ids", conf.alias("confidence"), status.alias("validation_status"), "last_checked_at", "n")


def store_order() -> list[Column]:
    """Merged rows of a place, the best first: status, confidence, source, priority, product."""
    from vicinia.functions.scores import source_rank, status_rank

    return [status_rank(F.col("validation_status")).desc(), F.col("confidence").desc_nulls_last(), source_rank(F.col("primary_source")).desc(), F.col("priority").desc(), F.col("product_id")]


def top_k(merged: DataFrame, k: int = 8, quota_groups: list[str] | None = None, quota_from: float = 0.62) -> DataFrame:
    """The k best rows of each establishment, with a place for the best of each quota group that would miss out.

    merged needs product_group and priority. Order: status, confidence, source, priority, product. Quota rows are not rejected, have a
    confidence of quota_from and come first; rejected rows are dropped at the end. All windows share one partitioning."""
    order = store_order()
    store, group = Window.partitionBy("establishment_id"), Window.partitionBy("establishment_id", "product_group")
    r = merged.withColumn("store_rank", F.row_number().over(store.orderBy(*order))).withColumn("group_rank", F.row_number().over(group.orderBy(*order)))
    quota = F.col("product_group").isin(quota_groups or []) & (F.col("group_rank") == 1) & (F.col("validation_status") != "rejected") & (F.col("confidence") >= quota_from) & (F.col("store_rank") > k)
    r = r.withColumn("quota", quota).where((F.col("store_rank") <= k) | F.col("quota"))
    r = r.withColumn("selected_rank", F.row_number().over(store.orderBy(F.col("quota").desc(), "store_rank")))
    return r.where((F.col("selected_rank") <= k) & (F.col("validation_status") != "rejected"))


def service_winner(cands: DataFrame) -> DataFrame:
    """W4, G-A3: of the rows of each (establishment, service) that are not rejected the one with the highest priority, confidence, time and id, and the sources and ids of all of them."""
    key = F.struct(_weight(F.col("source_type"), SERVICE_PRIORITY), "confidence", "checked_at", "id")
    best = F.max_by(F.struct("id", "source_type", "confidence", "validation_status"), key).alias("w")
    every = [F.array_sort(F.collect_set("source_type")).alias("merged_sources"), F.array_sort(F.collect_list("id")).alias("merged_candidate_ids")]
    return cands.where("validation_status <> 'rejected'").groupBy("establishment_id", "product_id").agg(best, *every).select("establishment_id", "product_id", "w.*", "merged_sources", "merged_candidate_ids")


def strategy_merge(rows: DataFrame) -> DataFrame:
    """Of rows of (store, product) found by several strategies the one with the highest priority; the first found on a tie."""
    from vicinia.functions.scores import merge_priority

    score = merge_priority(F.col("strategy"), F.col("validation_status"), F.col("source_type"), F.col("confidence"))
    return rows.withColumn("score", score).withColumn("rn", F.row_number().over(Window.partitionBy("establishment_id", "product_id").orderBy(F.col("score").desc(), "found"))).where("rn = 1").drop("rn")


def fingerprint(spelling: Column | None = None) -> Column:
    """Normalized name, where that is not known, and rounded place."""
    from vicinia.functions.geo import rounded_key
    from vicinia.functions.text import normalize

    return F.concat_ws("|", normalize(F.col("name")) if spelling is None else spelling, rounded_key(F.col("lat")).cast("string"), rounded_key(F.col("lon")).cast("string"))


def dedupe_ranked(rows: DataFrame) -> DataFrame:
    """The best-ranked row of each place. A store has one fingerprint, so one window by it also leaves one row a store."""
    w = Window.partitionBy("fingerprint").orderBy(F.col("rank").desc(), "establishment_id", "product_id")
    return rows.withColumn("fingerprint", fingerprint()).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], values: list[str], protect: Column | None = None) -> DataFrame:
    """The table after an upsert, with op in insert, update, keep. Rows for which `protect` holds (over o_ columns) stay as they are, and
    so do rows whose values are not distinct from the new ones."""
    o = old.select(*keys, *[F.col(v).alias(f"o_{v}") for v in values], F.lit(True).alias("in_old"))
    n = new.select(*keys, *[F.col(v).alias(f"n_{v}") for v in values], F.lit(True).alias("in_new"))
    j = o.join(n, keys, "full")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"o_{v}").eqNullSafe(F.col(f"n_{v}"))
    fixed = F.coalesce(protect, F.lit(False)) if protect is not None else F.lit(False)
    op = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull() | fixed | same, "keep").otherwise("update")
    j = j.withColumn("op", op)
    return j.select(*keys, *[F.when(F.col("op") == "keep", F.col(f"o_{v}")).otherwise(F.col(f"n_{v}")).alias(v) for v in values], "op")


def stale(merged: DataFrame, selected: DataFrame) -> DataFrame:
    """K2: merged rows that are not validated and not selected again."""
    return merged.where("validation_status <> 'validated'").join(selected, ["establishment_id", "product_id"], "left_anti")


def audit_diff(old: DataFrame, new: DataFrame, key: str, values: list[str], manual_only: Column | None = None) -> DataFrame:
    """K3: (key, action, old_row, new_row) between two snapshots; rows as JSON. manual_only restricts what is audited (over o_ and n_ columns)."""
    o = old.select(key, F.struct(*values).alias("o"))
    n = new.select(key, F.struct(*values).alias("n"))
    j = o.join(n, key, "full").where(~F.col("o").eqNullSafe(F.col("n")))
    if manual_only is not None:
        j = j.where(manual_only)
    action = F.when(F.col("o").isNull(), "insert").when(F.col("n").isNull(), "delete").otherwise("update")
    return j.select(key, action.alias("action"), F.to_json("o").alias("old_row"), F.to_json("n").alias("new_row"))


def keep_latest(log: DataFrame, key: str, at: str, row_id: str, n: int, keep: Column | None = None) -> DataFrame:
    """Rows of the log to prune: all but the latest n (1 at least) of each key, none for which `keep` holds."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), F.col(row_id).desc())
    out = log.withColumn("rn", F.row_number().over(w)).where(F.col("rn") > max(n, 1))
    return (out.where(~F.coalesce(keep, F.lit(False))) if keep is not None else out).drop("rn")


def suffix_duplicates(df: DataFrame, slug: str, key: str) -> DataFrame:
    """The second and later rows of a slug get -key."""
    rn = F.row_number().over(Window.partitionBy(slug).orderBy(key))
    return df.withColumn("rn", rn).withColumn(slug, F.when(F.col("rn") > 1, F.concat_ws("-", slug, F.col(key).cast("string"))).otherwise(F.col(slug))).drop("rn")


def import_dedupe(rows: DataFrame) -> DataFrame:
    """The most complete row of each external id, then of each name, place and category; weights 3 2 1 1 1."""
    given = lambda c: (F.coalesce(F.col(c), F.lit("")) != "").cast("int")
    r = rows.withColumn("completeness", 3 * given("name") + 2 * given("address") + given("website") + given("phone") + given("opening_hours"))
    for key in ([F.col("external_id")], [F.lower("name"), F.round("lat", 4), F.round("lon", 4), F.col("category")]):
        r = r.withColumn("rn", F.row_number().over(Window.partitionBy(*key).orderBy(F.col("completeness").desc(), "seq"))).where("rn = 1").drop("rn")
    return r


def promote(stage: DataFrame, dim: DataFrame) -> DataFrame:
    """The dimension after promotion of a stage, column by column: curated categories stay; new website and phone win, old hours, description
    and source win; the status is the stage's; freshness 0.9 on insert; the closed flag is cleared."""
    s, d = stage.alias("s"), dim.alias("d")
    c = lambda a, b, n: F.coalesce(F.col(f"{a}.{n}"), F.col(f"{b}.{n}")).alias(n)
    hours = F.coalesce(F.col("d.opening_hours"), F.col("s.opening_hours"))
    staged = F.col("s.external_id").isNotNull()
    return s.join(d, F.col("s.external_id") == F.col("d.external_id"), "full").select(
        c("s", "d", "external_id"), c("s", "d", "name"),
        F.when(F.coalesce(F.size("d.app_categories"), F.lit(0)) > 0, F.col("d.app_categories")).otherwise(F.col("s.app_categories")).alias("app_categories"),
        c("s", "d", "website"), c("s", "d", "phone"), hours.alias("opening_hours"), c("d", "s", "description"), c("d", "s", "source_url"),
        F.when(staged, F.col("s.active_status")).otherwise(F.col("d.active_status")).alias("active_status"),
        F.when(staged, F.lit(False)).otherwise(F.col("d.closed_candidate")).alias("closed_candidate"),
        F.when(staged & F.col("s.opening_hours").isNotNull(), F.lit(0.88)).otherwise(F.col("d.hours_confidence")).alias("hours_confidence"),
        F.coalesce(F.col("d.freshness"), F.lit(0.9)).alias("freshness"),
    )


def missing_decay(dim: DataFrame, seen: DataFrame, as_of: Column, grace_days: int = 21) -> DataFrame:
    """Entities not seen and last seen before the grace period: closed candidates, active ones unknown, freshness 0.12 less, 0.05 at least."""
    gone = F.col("seen").isNull() & (F.col("last_seen_at") < as_of - F.expr(f"interval {grace_days} days"))
    j = dim.join(seen.select("external_id").distinct().withColumn("seen", F.lit(True)), "external_id", "left")
    return j.withColumn("closed_candidate", gone | F.col("closed_candidate")).withColumn("active_status", F.when(gone & (F.col("active_status") == "active"), "unknown").otherwise(F.col("active_status"))).withColumn("freshness", F.when(gone, F.greatest(F.lit(0.05), F.col("freshness") - 0.12)).otherwise(F.col("freshness"))).drop("seen")


def coherence_repair(merged: DataFrame, cands: DataFrame) -> DataFrame:
    """K7: candidates to add for merged pairs without one."""
    lost = merged.join(cands.select("establishment_id", "product_id").distinct(), ["establishment_id", "product_id"], "left_anti")
    return lost.select("establishment_id", "product_id", F.col("primary_source").alias("source_type"), F.lit("coherence_repair").alias("generation_method"), "confidence", "validation_status")


def prune_nonserving(cands: DataFrame, merged: DataFrame, scope: Column | None = None) -> DataFrame:
    """K8: rule candidates that are neither validated nor rejected and whose pair is not merged, within a scope."""
    c = cands.where("source_type = 'rules_generated' and validation_status not in ('validated', 'rejected')")
    return (c.where(scope) if scope is not None else c).join(merged.select("establishment_id", "product_id"), ["establishment_id", "product_id"], "left_anti")


def category_mismatch(cands: DataFrame, rules: DataFrame) -> DataFrame:
    """K5: candidates that a rule (osm_category, product_group) forbids, rejected; repeated matches count once."""
    return cands.where("validation_status not in ('validated', 'rejected')").join(rules.distinct(), ["osm_category", "product_group"], "left_semi").withColumn("validation_status", F.lit("rejected"))


def relabel_legacy(cands: DataFrame, method: str) -> DataFrame:
    """K6: AI rows of a legacy method get the inferred label; other rows stay."""
    old = (F.col("source_type") == "ai_generated") & (F.col("generation_method") == method)
    return cands.withColumn("source_type", F.when(old, "ai_inferred").otherwise(F.col("source_type")))


def manual_decisions(cands: DataFrame, decisions: DataFrame) -> DataFrame:
    """The last decision on each candidate sets status and confidence; a removal drops it."""
    from vicinia.functions.scores import manual_confidence

    last = decisions.groupBy("id").agg(F.max_by(F.struct("action", "new_confidence"), "at").alias("d"))
    j = cands.join(last, "id", "left").where("d is null or d.action <> 'removed'")
    conf = F.when(F.col("d").isNull(), F.col("confidence").cast("double")).otherwise(manual_confidence(F.col("d.action"), F.col("confidence").cast("double"), F.col("d.new_confidence")))
    return j.withColumn("confidence", conf).withColumn("validation_status", F.coalesce(F.col("d.action"), F.col("validation_status"))).drop("d")


def bulk_edit(est: DataFrame, ids: DataFrame, status: str | None, categories: list[str], mode: str = "append") -> DataFrame:
    """Status and categories of the listed establishments."""
    new = F.array_sort(F.array_distinct(F.array(*[F.lit(c.strip().lower()) for c in categories])))
    mine = est.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    cats = new if mode == "replace" else F.array_sort(F.array_union(F.coalesce("app_categories", F.array().cast("array<string>")), new))
    mine = mine.withColumn("app_categories", F.when(F.col("hit"), cats).otherwise(F.col("app_categories")))
    return (mine.withColumn("active_status", F.when(F.col("hit"), status).otherwise(F.col("active_status"))) if status else mine).drop("hit")
