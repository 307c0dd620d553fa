"""Benchmark decontamination by SimHash windows and multi-index Hamming blocks; DataFrame operations only.

Windows of a document have the size in words of a benchmark item and get a 64-bit SimHash of their words and word pairs. Items
are indexed by four 16-bit blocks of their own fingerprint with every value within RADIUS // 4 flips: two fingerprints within
RADIUS agree on some block up to RADIUS // 4 bits (pigeonhole), so the equi-join on blocks finds all of them (Norouzi et
al., 2012). Candidates are then checked exactly: the weight of the item's shingles that the window holds, over the weight
of all of them, a shingle weighing ln(1 + items / items that hold it).

Of all windows only those are fingerprinted that can hold enough of an item's weight. An item's heaviest shingles, the ones that fewest items
hold, are taken until they weigh more than a window may lack: each window that passes holds one of these, so documents meet items by them
alone, and a phrase that many items open with brings nothing together. Around such a place all of the item's shingles are looked up. A
window that passes holds them either all at one offset, and then the window at that offset holds them too; or at several, and then so does
the window that starts at the first of them. So windows start at each such offset, and at each shared shingle that another offset follows
within an item's length. A window meets all items of its size by the index: of pairs that have nothing in common, 0.42 rows each meet in some
block and 1.2 % lie within the radius, so the work grows with windows that hold a rare shingle times items of one size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinia.llm.common import discard, keep_ids, let, materialize, word_array

#: Fingerprints up to so many bits apart are candidates. Of windows that have just the similarity 0.8 some 13 bits differ, with a
#: deviation of about 3.3; a test holds the share that lies within the radius to 0.995.
RADIUS = 23
BLOCKS, BITS = 4, 16
#: Rare item shingles that are sent to all tasks, 40 bytes each; with more the join is a shuffle, dealt by SALT as well as by shingle.
BROADCAST_SPOTS, SALT = 200_000, 16


def shingles(words: Column, k: int | Column) -> Column:
    """Hashes of the k-word shingles of a word array, in order; empty if it has fewer words."""
    k = F.lit(k) if isinstance(k, int) else k

    def of(w: Column) -> Column:
        last = F.size(w) - k + 1
        return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, k)))).otherwise(F.array().cast("array<bigint>"))

    return let(words, of)


def simhashes(df: DataFrame, key: str, words: str) -> DataFrame:
    """(key, fp): 64-bit SimHash of words and word pairs. One row a feature and 64 sums over them, added up before the shuffle."""
    pairs = F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.xxhash64(F.lit(2), F.slice(words, i, 2)))).otherwise(F.array().cast("array<bigint>"))
    features = df.select(key, F.explode(F.concat(F.transform(words, lambda w: F.xxhash64(F.lit(1), w)), pairs)).alias("h"))
    sums = features.groupBy(key).agg(F.count("*").alias("n"), *[F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(64)])
    one = F.lit(1).cast("long")
    bits = [F.when(2 * F.col(f"b{b}") > F.col("n"), F.shiftleft(one, b)).otherwise(F.lit(0).cast("long")) for b in range(64)]
    fp = F.aggregate(F.array(*bits), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    return sums.select(key, fp.alias("fp"))


def _masks(flips: int) -> list[int]:
    return [m for m in range(1 << BITS) if m.bit_count() <= flips]


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, similarity: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, similarity, n_windows): items that a document holds, with the best window's similarity.

    docs needs doc_id and text, benchmark item_id and text; other columns are ignored. Null or blank texts and items hold and
    leak nothing. An item of fewer than n words is one shingle of all of them. Texts are searched whole. Rows that repeat, or
    documents that share an id, count as one document. Texts that share an item_id are each searched for and weighed for
    themselves; the row has the best of them. No items or no documents give no rows."""
    items = benchmark.select("item_id", word_array(F.col("text")).alias("words")).where("size(words) > 0 and item_id is not null").distinct()
    items = items.withColumn("k", F.least(F.size("words"), F.lit(n))).withColumn("item", F.xxhash64("item_id", "words"))
    shingled = items.select("item", "item_id", "k", F.size("words").alias("len"), "words", shingles(F.col("words"), F.col("k")).alias("s"))
    shingled = materialize(shingled, "items")
    n_items = shingled.count()
    spots = materialize(shingled.select("item", "k", "len", F.posexplode("s").alias("ipos", "h")), "spots")
    own = spots.select("item", "h", "k", "len").distinct()
    weights = own.join(own.groupBy("h").agg(F.count("*").alias("df")), "h").withColumn("w", F.log(1 + F.lit(float(n_items)) / F.col("df")))
    weights = materialize(weights.select("item", "h", "k", "len", "w"), "weights")
    heavy = Window.partitionBy("item").orderBy(F.desc("w"), "h").rowsBetween(Window.unboundedPreceding, -1)
    before, total = F.coalesce(F.sum("w").over(heavy), F.lit(0.0)), F.sum("w").over(Window.partitionBy("item"))
    # Of what may be lacking a hair more, so that rounding loses none.
    rare = weights.withColumn("rare", before <= (1 - similarity) * total * (1 + 1e-9)).where("rare").select("item", "h", "k", "len")
    rare = materialize(rare, "rare")
    n_rare = rare.count()

    texts = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    met = None
    for k in range(1, n + 1):  # shingle lengths: n, and those of items that are shorter
        if k < n and shingled.where(F.col("k") == k).isEmpty():
            continue
        mine = rare.where(F.col("k") == k).select("h", "item", "len", "k")
        seen = texts.select("doc_id", F.posexplode(shingles(word_array(F.col("text")), k)).alias("pos", "h"))
        if n_rare <= BROADCAST_SPOTS:
            at = seen.join(F.broadcast(mine), "h")
        else:
            at = seen.withColumn("salt", F.pmod("pos", F.lit(SALT))).join(mine.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["h", "salt"])
        at = at.select("doc_id", "item", "len", "k", F.floor(F.col("pos") / F.col("len")).cast("int").alias("region"))
        met = at if met is None else met.unionByName(at)
    met = materialize(met.distinct(), "met")
    # All of the item's shingles in the region, of an item's length, and in those beside it: no window with a place in it reaches further.
    worded = keep_ids(texts, met.select("doc_id").distinct(), "doc_id").select("doc_id", word_array(F.col("text")).alias("words"))
    first = F.greatest(F.lit(0), (F.col("region") - 1) * F.col("len"))
    part = F.slice("words", first + 1, (F.col("region") + 2) * F.col("len") - first + F.col("k") - 1)
    around = worded.join(met, "doc_id").select("doc_id", "item", "len", "k", first.alias("first"), part.alias("part"))
    around = around.select("doc_id", "item", "len", "first", F.posexplode(shingles(F.col("part"), F.col("k"))).alias("at", "h"))
    found = around.join(spots.select("item", "h", "ipos"), ["item", "h"]).select("doc_id", "item", "len", (F.col("first") + F.col("at")).alias("pos"), (F.col("first") + F.col("at") - F.col("ipos")).alias("offset"))
    found = materialize(found.distinct(), "anchors")
    # Anchors of an item in a document in order of place; a change of offset makes those before it, within an item's length, starts as well.
    there = Window.partitionBy("doc_id", "item")
    changes = found.withColumn("change", F.when(F.lag("offset").over(there.orderBy("pos", "offset")) != F.col("offset"), F.col("pos")))
    changes = changes.withColumn("next", F.min("change").over(there.orderBy(F.desc("pos"), F.desc("offset")).rowsBetween(Window.unboundedPreceding, -1)))
    starts = F.array_distinct(F.concat(F.array(F.greatest("offset", F.lit(0))), F.when(F.col("next") - F.col("pos") < F.col("len"), F.array("pos")).otherwise(F.array().cast("array<int>"))))

    # One row a document: where windows start, by size. Each has its own places only.
    places = materialize(changes.select("doc_id", F.explode(starts).alias("start"), "len").distinct(), "places")
    ids = places.select("doc_id").distinct()
    near = keep_ids(texts, ids, "doc_id").select("doc_id", word_array(F.col("text")).alias("words"))
    windows = near.join(places, "doc_id").select("doc_id", "start", "len", F.slice("words", F.col("start") + 1, F.col("len")).alias("w"))
    windows = materialize(windows.withColumn("key", F.sha2(F.concat_ws(" ", F.col("len").cast("string"), F.array_join("w", " ")), 256)), "windows")
    distinct = materialize(windows.groupBy("key", "len").agg(F.max("w").alias("w")), "distinct")
    prints = materialize(distinct.join(simhashes(distinct, "key", "w"), "key"), "prints")
    index_of_items = simhashes(shingled, "item", "words").withColumnRenamed("fp", "ifp").join(shingled.select("item", "len"), "item")

    def blocks(fp: str) -> Column:
        return F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.shiftrightunsigned(fp, BITS * b).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int").alias("value")) for b in range(BLOCKS)]))

    masks = F.array(*map(F.lit, _masks(radius // BLOCKS)))
    index = index_of_items.select("item", "len", "ifp", blocks("ifp").alias("x"))
    index = index.select("item", "len", "ifp", F.col("x.block").alias("block"), F.explode(F.transform(masks, lambda m: m.bitwiseXOR(F.col("x.value")))).alias("value"))
    probes = prints.select("key", "len", "fp", blocks("fp").alias("x")).select("key", "len", "fp", F.col("x.block").alias("block"), F.col("x.value").alias("value"))
    close = probes.join(index, ["len", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).select("key", "item").distinct()

    weighed = weights.groupBy("item").agg(F.first("k").alias("k"), F.first("len").alias("len"), F.collect_list(F.struct("h", "w")).alias("s"))
    held = close.join(prints.select("key", "w"), "key").join(weighed, "item").withColumn("ws", shingles(F.col("w"), F.col("k")))
    total = lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x["w"])
    held = held.select("key", "item", "len", (total(F.filter("s", lambda x: F.array_contains("ws", x["h"]))) / total(F.col("s"))).alias("similarity")).where(F.col("similarity") >= similarity)
    held = held.join(shingled.select("item", "item_id"), "item")
    leaks = windows.select("doc_id", "key", "len", "start").join(held, ["key", "len"]).groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.countDistinct("start").alias("n_windows"))
    leaks = materialize(leaks, "leaks")
    discard(docs.sparkSession, shingled, spots, weights, rare, met, found, places, windows, distinct, prints)
    return leaks
