"""URL filters by temporal list join.

Dated list entries (add or remove a pattern on a list) become validity intervals; each capture is then joined as of its fetch time
with the entries that were active then. Patterns are a whole URL, a host, or a domain with its subdomains, so a capture looks up
a handful of keys and the join is an equi-join on the key. Each key's intervals are one sorted array: one row on the list side
however long its history, and a search of the array for the entry in force instead of a range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that a key's captures are dealt into, so one host with a large share of all captures is not one task's.
SALT = 8


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a final dot; empty if there is none."""
    h = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(h, r"\.$", "")


def exact_of(url: Column) -> Column:
    """Host, path and query; without scheme, port, fragment and a final slash."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(rest, r"/$", ""))


def lookup_keys(url: Column) -> Column:
    """u:<url>, h:<host> and d:<domain> for the host and each of its parents with a dot."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, n), ".")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(F.array(F.concat(F.lit("u:"), exact_of(url)), F.concat(F.lit("h:"), host)), parents))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, key, action, valid_from, valid_to) from (list, key, action, at): an entry holds until the next one of its list and key.

    Of entries at one moment, remove wins over add. Entries with a null in list, key, action or at are void; repeated ones count once."""
    at_once = entries.where("list is not null and key is not null and action in ('add', 'remove') and at is not null").groupBy("list", "key", "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "key").orderBy("at")
    return at_once.select("list", "key", "action", F.col("at").alias("valid_from"), F.lead("at").over(w).alias("valid_to"))


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, fetched_at, blocked, lists, n_matches) for each row of captures, which needs page_id, url and fetched_at.

    A capture is blocked if an add entry of a block list is in force for one of its keys at fetch time and no allow list (a list named
    allow...) holds one as well. Null or unparsable URLs and null fetch times match nothing and are kept. Repeated rows count
    each for themselves. No entries block nothing."""
    # 128 bits stand for a row on its way through the join: captures by the ten billion don't meet in them.
    rows = captures.select("page_id", "url", "fetched_at").withColumn("row", F.xxhash64("page_id", "url", "fetched_at")).withColumn("row2", F.xxhash64(F.lit(2), "fetched_at", "url", "page_id"))
    active = intervals(entries).where("action = 'add'").groupBy("key").agg(F.collect_list(F.struct("list", "valid_from", "valid_to")).alias("spans"))
    salted = active.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    asked = rows.select("row", "row2", "fetched_at", F.explode(F.array_distinct(lookup_keys(F.col("url")))).alias("key")).where("fetched_at is not null").distinct().withColumn("salt", F.pmod("row", F.lit(SALT)).cast("int"))
    valid = F.filter("spans", lambda s: (s["valid_from"] <= F.col("fetched_at")) & (s["valid_to"].isNull() | (F.col("fetched_at") < s["valid_to"])))
    hits = asked.join(salted, ["key", "salt"]).select("row", "row2", F.explode(valid).alias("s")).select("row", "row2", F.col("s.list").alias("list"))
    per = hits.groupBy("row", "row2").agg(F.array_sort(F.collect_set("list")).alias("lists"), F.count("*").alias("n"))
    out = rows.join(per, ["row", "row2"], "left")
    lists = F.coalesce("lists", F.array().cast("array<string>"))
    allowed, listed = F.exists(lists, lambda x: x.startswith("allow")), F.exists(lists, lambda x: ~x.startswith("allow"))
    return out.select("page_id", "fetched_at", (listed & ~allowed).alias("blocked"), F.array_join(lists, ",").alias("lists"), F.coalesce("n", F.lit(0)).cast("long").alias("n_matches"))
