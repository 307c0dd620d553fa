"""Demand, quality, coverage and curation analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinia.functions import scores
from vicinia.sources import scratch


def term_insights(searches: DataFrame) -> DataFrame:
    """G-A6, L3: per term total, resolved, unresolved, mean results (negative counts as 0). Blank terms have no row but count in totals()."""
    r = F.greatest(F.coalesce("results", F.lit(0)), F.lit(0))
    return searches.where(F.trim(F.coalesce("term", F.lit(""))) != "").groupBy(F.lower(F.trim("term")).alias("term")).agg(F.count("*").alias("total"), F.count_if(r > 0).alias("resolved"), F.count_if(r == 0).alias("unresolved"), F.round(F.avg(r), 2).alias("avg_results"))


def totals(searches: DataFrame) -> DataFrame:
    """G-A6."""
    r = F.greatest(F.coalesce("results", F.lit(0)), F.lit(0))
    return searches.agg(F.count("*").alias("total"), F.count_if(r == 0).alias("unresolved"), F.round(F.count_if(r == 0) / F.count("*"), 4).alias("unresolved_rate"))


def daily_no_results(searches: DataFrame, days: int = 14) -> DataFrame:
    """G-A6: unresolved searches of each of the last days that have some."""
    d = searches.where(F.coalesce("results", F.lit(0)) <= 0).groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return d.orderBy(F.desc("day")).limit(days)


def endpoint_counts(searches: DataFrame) -> DataFrame:
    """G-A6."""
    return searches.groupBy(F.coalesce("endpoint", F.lit("unknown")).alias("endpoint")).agg(F.count("*").alias("n"))


def demand_report(failed: DataFrame) -> DataFrame:
    """G-A5: per query number, distinct days, first and last time, an example and a district."""
    return failed.groupBy("query").agg(F.count("*").alias("n"), F.countDistinct(F.to_date("ts")).alias("days"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"), F.max("district").alias("district"))


def by_district(failed: DataFrame) -> DataFrame:
    """G-A13."""
    return failed.groupBy(F.coalesce(F.nullif(F.trim("district"), F.lit("")), F.lit("unknown")).alias("district")).agg(F.count("*").alias("n"))


def category_quality(rows: DataFrame, least: int = 20) -> DataFrame:
    """G-A7: per group total, suspicious, validated, and suspicious ones of 0.82 on."""
    g = rows.groupBy("product_group").agg(F.count("*").alias("total"), F.count_if("suspicious").alias("suspicious"), F.count_if(F.col("validation_status") == "validated").alias("validated"), F.count_if(F.col("suspicious") & (F.col("confidence") >= 0.82)).alias("high_confidence"))
    return g.where(F.col("total") >= least).withColumn("suspicious_rate", F.round(F.col("suspicious") / F.col("total"), 4))


def source_precision(rows: DataFrame) -> DataFrame:
    """G-A8."""
    return rows.groupBy("source_type").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("validation_status").isin("likely", "validated")) / F.count("*"), 4).alias("precision"), F.round(F.avg(F.col("confidence").cast("double")), 4).alias("avg_confidence"))


def district_overview(est: DataFrame, top: int = 5) -> DataFrame:
    """G-A10: conditional counts and the most common categories of each district."""
    base = est.groupBy("district").agg(
        F.count("*").alias("total"), F.count_if(F.col("active_status") == "active").alias("active"), F.count_if("closed_candidate").alias("closed"),
        F.count("website").alias("with_website"), F.count_if(F.col("opening_hours") != "").alias("with_hours"), F.count("duplicate_of").alias("duplicates"),
    )
    cats = est.groupBy("district", "app_category").agg(F.count("*").alias("n"))
    ranked = cats.withColumn("rn", F.row_number().over(Window.partitionBy("district").orderBy(F.desc("n"), "app_category"))).where(F.col("rn") <= top)
    best = ranked.groupBy("district").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "app_category"))), lambda x: x["app_category"]), "|").alias("top_categories"))
    return base.join(best, "district")


#: Days after which a place counts as stale, and places that a review queue shows.
STALE_DAYS, QUEUE = 120, 160


def review_flags(est: DataFrame, as_of: Column, stale_days: int = STALE_DAYS) -> DataFrame:
    """G-A11: flags of what a place lacks, and their weights as a score. n_products and n_validated count merged rows that are not rejected; a place that has products but no
    validated one is low on validation, one that is active needs opening hours, and one not updated within the days is stale."""
    none = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    n, v = F.coalesce("n_products", F.lit(0)), F.coalesce("n_validated", F.lit(0))
    old = F.coalesce(F.col("updated_at") < as_of - F.expr(f"interval {stale_days} days"), F.lit(False))
    active = F.coalesce(F.col("active_status") == "active", F.lit(False))
    rules = [("missing_categories", none(F.col("app_category")), 2), ("missing_products", n == 0, 2), ("low_validation", (n > 0) & (v == 0), 1), ("missing_opening_hours", active & none(F.col("opening_hours")), 1), ("stale_data", old, 1)]
    flags = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c, _ in rules]))
    score = sum((F.when(c, w).otherwise(0) for _, c, w in rules), F.lit(0))
    return est.withColumn("flags", F.array_join(flags, "|")).withColumn("score", score).where("score > 0")


def review_queue(flagged: DataFrame, top: int = QUEUE) -> DataFrame:
    """G-A11, L5: the flagged places with the highest score, of these those not updated for longest."""
    return flagged.orderBy(F.desc("score"), F.col("updated_at").asc_nulls_first(), "id").limit(top)


def catalog_overview(products: DataFrame, sample: int = 6) -> DataFrame:
    """G-A12, L5: products of each group with the first few names."""
    r = products.withColumn("rn", F.row_number().over(Window.partitionBy("product_group").orderBy("normalized_name", "id")))
    return r.groupBy("product_group").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= sample, F.struct("rn", "normalized_name")))), lambda x: x["normalized_name"]), "|").alias("sample"))


def run_rollup(runs: DataFrame, as_of: Column) -> DataFrame:
    """G-A9, G-A14: cost of the last 7 and 30 days, and of finished runs a day."""
    ago = lambda n: F.col("ts") >= as_of - F.expr(f"interval {n} days")
    return runs.agg(F.round(F.sum(F.when(ago(7), F.col("cost"))), 2).alias("cost_7d"), F.round(F.sum(F.when(ago(30), F.col("cost"))), 2).alias("cost_30d"), F.round(F.count_if(F.col("covered")) / F.count("*"), 4).alias("coverage"))


def curation_suggestions(events: DataFrame, as_of: Column, window_days: int, least: int = 3, precision: float = 0.8) -> DataFrame:
    """G-A4: per (category, group) of events in the window support, positive ones and precision; eligible by the unrounded ratio."""
    e = events.where((F.col("created_at") >= as_of - F.expr(f"interval {window_days} days")) & (F.trim(F.coalesce("app_category", F.lit(""))) != ""))
    positive = F.col("event_type").isin("product_validated", "product_added")
    g = e.groupBy(F.lower(F.trim("app_category")).alias("app_category"), "product_group").agg(F.count("*").alias("support"), F.count_if(positive).alias("positive"))
    ratio = F.col("positive") / F.col("support")
    return g.where(F.col("support") >= least).select("app_category", "product_group", "support", "positive", F.round(ratio, 4).alias("precision"), (ratio >= precision).alias("eligible"))


def apply_suggestions(suggestions: DataFrame, rules: DataFrame, top: int, overwrite: bool = False) -> DataFrame:
    """Rules after the best eligible suggestions: the learned confidence, or the greater of old and new."""
    best = suggestions.where("eligible").orderBy(F.desc("precision"), F.desc("support"), "app_category", "product_group").limit(top)
    new = best.select("app_category", "product_group", F.round(scores.learned_confidence(F.col("precision"), F.col("support")), 4).alias("new"))
    j = rules.join(new, ["app_category", "product_group"], "full")
    conf = F.coalesce("new", "base_confidence") if overwrite else F.greatest("new", "base_confidence")
    op = F.when(F.col("base_confidence").isNull(), "insert").when(F.col("new").isNull(), "keep").otherwise("update")
    return j.select("app_category", "product_group", conf.alias("base_confidence"), op.alias("op"))


def look_backs(searches: DataFrame, as_of: Column, days: tuple[int, ...] = (30, 14, 7)) -> DataFrame:
    """For each rolling look-back the searches, the unresolved ones and the days that have some; one pass over the longest."""
    r = F.greatest(F.coalesce("results", F.lit(0)), F.lit(0))
    within = lambda n: F.col("ts") >= as_of - F.expr(f"interval {n} days")
    rows = searches.where(within(max(days)) & (F.col("ts") < as_of)).select("ts", r.alias("r"), F.explode(F.array_compact(F.array(*[F.when(within(n), n) for n in days]))).alias("days"))
    return rows.groupBy("days").agg(F.count("*").alias("n"), F.count_if(F.col("r") == 0).alias("unresolved"), F.countDistinct(F.to_date("ts")).alias("active_days"))


def affected(rows: DataFrame, changed: Column, key: str = "establishment_id") -> DataFrame:
    """G-A20: how many rows a change touches, and of how many keys."""
    return rows.where(changed).agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"))


def open_demand(failed: DataFrame) -> DataFrame:
    """G-A11: terms that are still unresolved and when the last was asked for."""
    return failed.where("not resolved").agg(F.countDistinct(F.lower(F.trim("query"))).alias("unresolved_terms"), F.max("ts").alias("last_seen"))


def flag_totals(flagged: DataFrame) -> DataFrame:
    """G-A11: how many places have each flag, whether the queue shows them or not."""
    return flagged.select(F.explode(F.split("flags", r"\|")).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


def stores_per_product(merged: DataFrame, products: DataFrame) -> DataFrame:
    """G-A12: stores of each product, those without any included. merged has one row a pair, so rows count stores: nothing is made distinct again."""
    n = merged.where("validation_status <> 'rejected'").groupBy("product_id").agg(F.count("establishment_id").alias("n_stores"))
    return products.select(F.col("id").alias("product_id")).join(n, "product_id", "left").withColumn("n_stores", F.coalesce("n_stores", F.lit(0)))


def coverage(est: DataFrame, merged: DataFrame, top: int = 10) -> DataFrame:
    """G-A22: of the places those with website, hours and products, the mean confidence and the most common place categories."""
    has = merged.select(F.col("establishment_id").alias("id")).distinct().withColumn("has", F.lit(True))
    base = est.join(has, "id", "left").agg(F.count("*").alias("places"), F.count("website").alias("with_website"), F.count_if(F.col("opening_hours") != "").alias("with_hours"), F.count("has").alias("with_products"))
    mean = merged.agg(F.round(F.avg(F.col("confidence").cast("double")), 4).alias("mean_confidence"))
    cats = est.groupBy("osm_category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "osm_category").limit(top)
    best = cats.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("by"), "osm_category"))), lambda x: x["osm_category"]), "|").alias("top_categories"))
    return base.join(F.broadcast(mean)).join(F.broadcast(best))  # one row each


def snapshot_compare(before: DataFrame, after: DataFrame, most: int = 12) -> DataFrame:
    """Names added and removed per establishment between two snapshots (establishment_id, names)."""
    j = before.withColumnRenamed("names", "b").join(after.withColumnRenamed("names", "a"), "establishment_id")
    show = lambda x, y: F.array_join(F.slice(F.array_sort(F.array_except(x, y)), 1, most), "|")
    return j.select("establishment_id", show("a", "b").alias("added"), show("b", "a").alias("removed"), F.size("a").alias("n_after"))


def stage_counts(candidates: DataFrame, merged: DataFrame, serving: DataFrame, est: DataFrame) -> DataFrame:
    """G-A19: one row of what each stage of the pipeline holds: candidates, merged pairs, serving rows and stores, places with a website."""
    parts = [candidates.agg(F.count("*").alias("candidates")), merged.agg(F.count("*").alias("merged")), serving.agg(F.count("*").alias("serving"), F.countDistinct("establishment_id").alias("stores")), est.agg(F.count("website").alias("with_website"))]
    out = parts[0]
    for x in parts[1:]:  # one row each
        out = out.join(F.broadcast(x))
    return out


def density(per_store: DataFrame) -> DataFrame:
    """G-A22: mean, maximum and percentiles of products per store."""
    return per_store.agg(F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("max"), F.percentile("n", 0.5).alias("p50"), F.percentile("n", 0.9).alias("p90"))


def enrichment_audit(rows: DataFrame) -> DataFrame:
    """G-A18: plausible and doubtful rows and their shares."""
    plausible = (F.col("validation_status") == "validated") | ((F.col("confidence") >= 0.66) & ~F.col("suspicious"))
    return rows.agg(F.count("*").alias("n"), F.count_if(plausible).alias("plausible"), F.count_if(~plausible).alias("doubtful"), F.round(F.count_if(plausible) / F.count("*"), 4).alias("plausible_ratio"))


def result_summary(rows: DataFrame) -> DataFrame:
    """G-A25: counts and mean confidence, a null as 0."""
    return rows.groupBy("establishment_id").agg(F.count_if(F.col("validation_status") == "validated").alias("validated"), F.count_if(F.col("validation_status") == "likely").alias("likely"), F.round(F.avg(F.coalesce(F.col("confidence").cast("double"), F.lit(0.0))), 3).alias("mean_confidence"))


def failed_events(searches: DataFrame) -> DataFrame:
    """Searches that go to the failed log too."""
    return searches.where((F.coalesce("results", F.lit(0)) <= 0) | F.col("reason").isin("no_results_products", "no_results_any"))


def valid_events(searches: DataFrame) -> DataFrame:
    """rows within the allowed ranges; the rest is for quarantine."""
    return searches.where(F.length("term").between(1, 160) & (F.col("radius_km").isNull() | F.col("radius_km").between(0, 50)) & F.col("results").between(-1, 5000))


def _next_cells(cells: DataFrame, keys: list[str], of: str, many: int = 1024) -> DataFrame:
    """(keys, of, after): for each cell of a key the next cell that has events. Cells are looked through block by block and blocks one by one, so a key's timeline
    is spread over tasks by blocks of `many` cells."""
    c = cells.withColumn("block", F.expr(f"{of} div {many}"))
    inner = c.withColumn("after", F.lead(of).over(Window.partitionBy(*keys, "block").orderBy(of)))
    blocks = c.groupBy(*keys, "block").agg(F.min(of).alias("first"))
    blocks = blocks.withColumn("later", F.lead("first").over(Window.partitionBy(*keys).orderBy("block"))).drop("first")
    return inner.join(blocks, [*keys, "block"]).select(*keys, of, F.coalesce("after", "later").alias("after"))


def window_openings(times: DataFrame, key: str, seconds: int) -> DataFrame:
    """(key, us) of the events that open a window, over distinct times (key, us) in microseconds: a key's first, and from each opening the first event `seconds` later or more.

    Pointer jumping: each event points to the first one that is a window away; pointers double from round to round, and each round marks what those marked
    so far point to. After r rounds the first 2^r openings of every key are marked. A key's events meet by cells of one window's length, and never all in one task."""
    span = seconds * 1_000_000
    t = times.select(F.col(key).alias("k"), "us").distinct().withColumn("cell", F.floor(F.col("us") / span).cast("long"))
    cells = t.groupBy("k", "cell").agg(F.min("us").alias("first_us"))
    # The first event a window later lies in the next cell, not before the same place of it; else it is the first of the next cell after that which has any.
    probes = t.select("k", (F.col("cell") + 1).alias("cell"), (F.col("us") + span).alias("at"), "us", F.lit(None).cast("long").alias("event"))
    seen = probes.unionByName(t.select("k", "cell", F.col("us").alias("at"), F.lit(None).cast("long").alias("us"), F.col("us").alias("event")))
    down = Window.partitionBy("k", "cell").orderBy(F.desc("at"), F.col("us").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    near = seen.withColumn("to", F.last("event", True).over(down)).where("us is not null").select("k", "us", (F.col("cell") - 1).alias("cell"), "to")
    after = _next_cells(cells.select("k", "cell"), ["k"], "cell")
    second = after.select("k", F.col("cell").alias("after"), F.col("after").alias("second"))
    far = after.join(second, ["k", "after"], "left").select("k", "cell", F.when(F.col("after") == F.col("cell") + 1, F.col("second")).otherwise(F.col("after")).alias("far_cell"))
    far = far.join(cells.select("k", F.col("cell").alias("far_cell"), F.col("first_us").alias("far")), ["k", "far_cell"]).select("k", "cell", "far")
    start = t.groupBy("k").agg(F.min("us").alias("us")).withColumn("open", F.lit(True))
    now = near.join(far, ["k", "cell"], "left").select("k", "us", F.coalesce("to", "far").alias("to")).join(start, ["k", "us"], "left")
    now = scratch.written(now, "pointers")
    while not now.where("to is not null and open").isEmpty():
        marks = now.where("open and to is not null").select("k", F.col("to").alias("us")).distinct().withColumn("hit", F.lit(True))
        jump = now.select("k", F.col("us").alias("to"), F.col("to").alias("further"))
        more = now.join(marks, ["k", "us"], "left").join(jump, ["k", "to"], "left")
        now = scratch.written(more.select("k", "us", F.col("further").alias("to"), F.coalesce("open", "hit").alias("open")), "pointers")
    return now.where("open").select(F.col("k").alias(key), "us")


def fixed_window_limit(events: DataFrame, key: str, at: str, seconds: int = 60, most: int = 120) -> DataFrame:
    """R1 in batch: windows open at a key's first event and last `seconds`; events beyond `most` in a window are not allowed. Events without a key or a time are in no window.

    Windows are at least their length apart, so an event's opening is in its own cell of that length or the one before."""
    span = seconds * 1_000_000
    e = events.select("event_id", F.col(key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("us")).where("k is not null and us is not null")
    opens = window_openings(e, "k", seconds).select("k", F.col("us").alias("opened"), F.floor(F.col("us") / span).cast("long").alias("cell"))
    opens = opens.select("k", "opened", F.explode(F.array("cell", F.col("cell") + 1)).alias("cell")).groupBy("k", "cell").agg(F.array_sort(F.collect_list("opened")).alias("opens"))  # two at most
    placed = e.withColumn("cell", F.floor(F.col("us") / span).cast("long")).join(opens, ["k", "cell"])
    placed = placed.withColumn("opened", F.array_max(F.filter("opens", lambda o: o <= F.col("us"))))
    n = F.row_number().over(Window.partitionBy("k", "opened").orderBy("us", "event_id"))
    return placed.select("event_id", F.col("k").alias(key), n.alias("n_in_window")).withColumn("allowed", F.col("n_in_window") <= most)
