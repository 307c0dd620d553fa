"""Queries of tables that change: refreshes of what has changed, and streams into versioned tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vicinia.operators import refresh as r
from vicinia.plans.registry import Registry
from vicinia.plans.search import SERVING_WITH
from vicinia.sources import scratch
from vicinia.sources.tables import SOURCES, candidates, establishments, load, products, views
from vicinia.sources.versions import Versioned
from vicinia.streaming import events as st

query = Registry()

# A day's changes: some stores' candidates are rejected, some get a better confidence, one in a hundred stores closes.
_STATUS2 = "case when establishment_id % 50 = 7 and product_id % 3 = 0 then 'rejected' else validation_status end"
_CONF2 = "case when establishment_id % 50 = 9 then cast(least(0.95, confidence + 0.05) as decimal(5,4)) else confidence end"
_ACTIVE2 = "case when id % 100 = 11 then 'inactive' else active_status end"
_AFTER = SERVING_WITH.replace("cand as (select ", "cand0 as (select ").replace("est as (select ", "est0 as (select ")
_AFTER = _AFTER.replace(", mrg as (", f", est as (select * exclude (active_status), {_ACTIVE2} as active_status from est0), cand as (select id, establishment_id, product_id, source_type, generation_method, {_CONF2} as confidence, {_STATUS2} as validation_status, checked_at from cand0), mrg as (", 1)


@query(f"{_AFTER} select establishment_id, product_id, district, confidence, validation_status from srv")
def serving_refresh(spark, sf_dir):
    """The serving dataset is built, some candidates and stores change, and only what belongs to them is worked out anew; the result is that of a full rebuild."""
    old, e, p = candidates(spark, sf_dir), establishments(spark, sf_dir), products(spark, sf_dir)
    new = old.withColumn("validation_status", F.expr(_STATUS2)).withColumn("confidence", F.expr(_CONF2))
    e2 = e.withColumn("active_status", F.expr(_ACTIVE2))
    store = Versioned(spark, scratch.new(spark, "serving"), "establishment_id")
    r.refresh_serving(store, None, old, e, p, SOURCES)
    moved = r.changed_owners(old, new, "id", ["product_id", "source_type", "confidence", "validation_status"])
    shut = r.changed_owners(e.withColumn("establishment_id", F.col("id")), e2.withColumn("establishment_id", F.col("id")), "id", ["active_status", "name", "district"])
    r.refresh_serving(store, moved.unionByName(shut), new, e2, p, SOURCES)
    return store.read().select("establishment_id", "product_id", "district", "confidence", "validation_status")


_TIMES = "timestamp '2024-06-01' - to_days(cast(seen_days as integer)) as seen, timestamp '2024-06-01' - to_days(cast(import_days as integer)) as imported, timestamp '2024-06-01' - to_days(cast(enrich_days as integer)) as enriched"
_DECAY = "greatest(0.05e0, least(0.99e0, 1 - least(0.58e0, seen_days * 0.010e0) - least(0.23e0, import_days * 0.004e0) - least(0.15e0, coalesce(enrich_days, 365) * 0.0025e0) - case when closed_candidate then 0.18e0 else 0e0 end - case active_status when 'temporarily_closed' then 0.12e0 when 'inactive' then 0.28e0 else 0e0 end))"


@query(f"{views('est')} select id, case when id % 2 = 0 then round({_DECAY}, 4) else freshness end as freshness, (select count(*) from est where id % 2 = 0) as updated_rows from est")
def freshness_refresh(spark, sf_dir):
    """V1: freshness of all stores of one source from the times at which they were seen, imported and enriched."""
    ago = lambda c: F.expr(f"timestamp'2024-06-01' - make_dt_interval(cast({c} as int))")
    e = establishments(spark, sf_dir).withColumn("last_seen_at", ago("seen_days")).withColumn("last_imported_at", ago("import_days")).withColumn("last_enriched_at", ago("enrich_days"))
    rows, n = r.refresh_freshness(e, F.lit("2024-06-01").cast("timestamp"), F.col("id") % 2 == 0)
    return rows.select("id", "freshness").join(F.broadcast(n))  # one row


@query(f"{views('cand')}, g as (select *, row_number() over (partition by establishment_id, product_id order by checked_at desc, id desc) as rn from cand), d as (select id from g where rn > 2 and not (validation_status = 'rejected' or validation_status = 'validated')) select id, (select count(*) from d) as deleted_rows from cand where id not in (select id from d)")
def audit_prune(spark, sf_dir):
    """V1: the newest two audit rows of each pair stay, and all that say validated or rejected."""
    row = F.to_json(F.struct("validation_status", "confidence"))
    log = candidates(spark, sf_dir).select("id", F.concat_ws(":", "establishment_id", "product_id").alias("candidate_id"), F.col("checked_at").alias("changed_at"), F.when(F.col("id") % 2 == 0, row).alias("new_row"), row.alias("old_row"))
    kept, n = r.prune_audit(log, 2)
    return kept.select("id").join(F.broadcast(n))  # one row


def _stream(spark, sf_dir):
    batch = load(spark, sf_dir, "events")
    return spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)


@query("select concat(user_id, ':', event_type) as request_id, first(event_id order by ts desc, event_id desc) as event_id, first(value order by ts desc, event_id desc) as value, first(props order by ts desc, event_id desc) as props from events where user_id is not null and event_type is not null group by 1")
def request_log_stream(spark, sf_dir):
    """The log of requests as a stream of upserts by request id into a versioned table; the last event of each request stays."""
    e = _stream(spark, sf_dir).select(F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("request_id"), "event_id", "ts", "value", "props")
    root = scratch.new(spark, "requests")
    store = Versioned(spark, f"{root}/table", "request_id", 8)
    st.upsert_stream(e, store, ["ts", "event_id"], f"{root}/state").awaitTermination()
    return store.read().select("request_id", "event_id", "value", "props")


_DAYS = "with e as (select ts, case when event_type = 'error' then 0 else 1 end as results from events), lim as (select date_trunc('day', max(ts) - interval 1 day) as upto, date_trunc('day', min(ts)) as since from e), de as (select unnest(generate_series(since + interval 1 day, upto, interval 1 day)) as day_end from lim)"


@query(f"{_DAYS}, k(days) as (values (30), (14), (7)) select day_end, days, count(ts) as n, count(*) filter (where results = 0) as unresolved, count(distinct cast(ts as date)) as active_days from de cross join k left join e on ts < day_end and ts >= day_end - to_days(days) group by 1, 2")
def look_back_stream(spark, sf_dir):
    """R3 as a stream: 30, 14 and 7 days back at each day's end, as far as the watermark has come."""
    e = _stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("results"))
    root = scratch.new(spark, "look-backs")
    rows = st.sliding_look_backs(e, "ts")
    out = rows.writeStream.foreachBatch(lambda df, b: df.write.mode("overwrite").parquet(f"{root}/days/batch={b}"))
    out.option("checkpointLocation", f"{root}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{root}/days").select(F.col("day_end").cast("timestamp_ntz").alias("day_end"), "days", "n", "unresolved", "active_days")
