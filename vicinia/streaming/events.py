"""Structured Streaming of search and interaction events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vicinia.sources.versions import Versioned


def read_events(spark: SparkSession, path: str, schema, files_a_trigger: int = 16) -> DataFrame:
    """Files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def once_each(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """The first event of a key; state older than the watermark is dropped."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def daily(events: DataFrame, at: str, late: str = "1 day") -> DataFrame:
    """Events and failures a UTC day."""
    return events.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("results") <= 0).alias("failed")).select(F.to_date("w.start").alias("day"), "n", "failed")


def sink(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a folder, what is there now and then stop."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def split_failed(events: DataFrame, searches: str, failed: str, checkpoint: str) -> StreamingQuery:
    """Each batch to the log of searches, those without results to the failed log as well. A batch that is run again overwrites its own part."""

    def write(batch: DataFrame, batch_id: int) -> None:
        from vicinia.operators.insights import failed_events

        batch.persist()
        batch.write.mode("overwrite").parquet(f"{searches}/batch={batch_id}")
        failed_events(batch).write.mode("overwrite").parquet(f"{failed}/batch={batch_id}")
        batch.unpersist()

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rate_limit(events: DataFrame, key: str, at: str, seconds: int = 60, most: int = 120, late: str = "1 hour") -> DataFrame:
    """(event_id, key, allowed). A key's window opens at its first event and lasts `seconds`, so it is state of its own, not window().
    A key's state goes once the watermark has passed its window."""
    us = seconds * 1_000_000

    def count(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, n = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(["_us", "event_id"])
        ok = []
        for t in rows["_us"]:
            opened, n = (t, 1) if opened is None or t >= opened + us else (opened, n + 1)
            ok.append(n <= most)
        state.update((int(opened), int(n)))
        state.setTimeoutTimestamp(max((int(opened) + us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows["event_id"], key: rows[key], "allowed": ok})

    e = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).select("event_id", key, "_at", F.unix_micros("_at").alias("_us"))
    return e.groupBy(key).applyInPandasWithState(count, f"event_id long, {key} {e.schema[key].dataType.simpleString()}, allowed boolean", "opened long, n int", "append", GroupStateTimeout.EventTimeTimeout)


def upsert_stream(events: DataFrame, store: Versioned, at: list[str], checkpoint: str, name: str = "events") -> StreamingQuery:
    """The last event of each key of the store, kept as a versioned table; what is there now and then stop. Events are compared by `at`, and an older one never replaces a newer.

    A batch writes the parts of the table that it touches and then switches to them together with its own number. A batch that runs again because the
    stream died before its own bookkeeping finds its number and does nothing; one that died before the switch has changed nothing and is done anew."""

    def put(batch: DataFrame, batch_id: int) -> None:
        if store.manifest()["batches"].get(name, -1) >= batch_id:
            return
        rows = batch.where(F.col(store.key).isNotNull())
        parts = store.parts_of(rows)
        if not parts:
            return
        old = store.read(parts)
        both = rows if old is None else rows.unionByName(old)
        row = F.struct(*batch.columns)
        last = both.groupBy(store.key).agg(F.max_by(row, F.struct(*at)).alias("r")).select("r.*")
        store.replace(last.select(*batch.columns), parts, (name, batch_id))

    return events.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sliding_look_backs(searches: DataFrame, at: str, days: tuple[int, ...] = (30, 14, 7), late: str = "1 day") -> DataFrame:
    """R3 as a stream: at the end of each UTC day, for each look-back, the searches, the unresolved ones and the days that had some.

    Two stateful steps: days are counted first, and sliding windows of the longest look-back then add up days, so state is one row a day and one a window, however many
    searches there are. Rows later than `late` are dropped with their day; a day end is given once the watermark has passed it, and only where the longest look-back has a search."""
    r = F.greatest(F.coalesce("results", F.lit(0)), F.lit(0))
    day = searches.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("d")).agg(F.count("*").alias("n"), F.count_if(r == 0).alias("unresolved"))
    day = day.select(F.window_time("d").alias("at"), F.col("d.end").alias("day_end"), "n", "unresolved")
    each = day.withColumn("w", F.window("at", f"{max(days)} days", "1 day"))
    sums = []
    for k in days:
        inside = F.col("day_end") > F.col("w.end") - F.expr(f"interval {k} days")
        sums += [F.sum(F.when(inside, F.col("n")).otherwise(0)).alias(f"n_{k}"), F.sum(F.when(inside, F.col("unresolved")).otherwise(0)).alias(f"unresolved_{k}"), F.count_if(inside).alias(f"active_days_{k}")]
    out = each.groupBy("w").agg(*sums)
    rows = [F.struct(F.lit(k).alias("days"), F.col(f"n_{k}").alias("n"), F.col(f"unresolved_{k}").alias("unresolved"), F.col(f"active_days_{k}").alias("active_days")) for k in days]
    return out.select(F.col("w.end").alias("day_end"), F.explode(F.array(*rows)).alias("r")).select("day_end", "r.*")
