"""Importance resampling towards a target distribution, with hashed n-gram features from a streaming CRC ring.

A document is scanned once. The scan keeps a ring of running zlib states, one for each of the last n words as a start; a further
word extends each of them by a space and itself, opens its own, and every state so reached names a feature's bucket. The buckets are
written once, two bytes each, and both the counts and the weights are read from there. Counts are summed in each task before they
are shuffled: a table of buckets is all that reaches the driver. Ranks come from a count of each whole-number score, whose range
is bounded by the rule of the score, so no task ever sorts all documents."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vicinia.llm.common import TEXTS_A_BATCH, discard, materialize

#: Digits, a-z and every byte of a character beyond ASCII; the text is lowered before.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def ring_states(words: list[bytes], n: int) -> list[int]:
    """The CRC-32 of every run of 1 to n words joined by one space, in order of where runs end, shorter ones first."""
    ring: list[int] = []
    out: list[int] = []
    for w in words:
        more = b" " + w
        ring = [zlib.crc32(w), *[zlib.crc32(more, s) for s in ring[: n - 1]]]
        out += ring
    return out


def scan(text: str | None, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """(words, bucket of each feature) of a whole text."""
    words = _WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    return len(words), np.array(ring_states(words, n) if n > 1 else list(map(zlib.crc32, words)), np.int64) % buckets


def emit_buckets(rows: DataFrame, keys: list[str], n: int, buckets: int) -> DataFrame:
    """keys, n_words and the buckets of a text's features as packed little-endian numbers; a map over rows."""
    packed = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS_A_BATCH):
                b = whole.slice(at, TEXTS_A_BATCH)
                got = [scan(t.as_py(), n, buckets) for t in b.column(len(keys))]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keys))], pa.array([w for w, _ in got], pa.int64()), pa.array([x.astype(packed).tobytes() for _, x in got], pa.binary())], names=[*keys, "n_words", "features"])

    texts = rows.select(*keys, F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, ", ".join([f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys] + ["n_words long", "features binary"]))


def bucket_counts(emitted: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs over all rows: each task sums its own, at most one row a bucket and task is shuffled."""
    packed = "<u2" if buckets <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), packed), minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in emitted.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of a nat by which a bucket is likelier in the target than in the source, both smoothed by one; rounded down."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    m = float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + m) / ((s + 1) * (t.sum() + m)))).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variate from the id's digest, rounded down; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, share_percent: int) -> DataFrame:
    """rows (doc_id, score, eligible, others) with rank: 1, 2, 3... for the floor(share x eligible / 100) highest scores, ties to the smaller doc_id.

    Scores are whole numbers of a bounded range (gains within 1000 ln 2^64, variates within 26 000), so the table of their counts has
    at most some 200 000 rows and the driver takes its running sum. Only rows of one score are then ordered, each score by itself."""
    counts = [(r.score, r.n) for r in rows.where("eligible").groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).collect()]
    draws = share_percent * sum(n for _, n in counts) // 100
    before, offsets = 0, []
    for score, n in counts:
        if before >= draws:
            break
        offsets.append((score, before))
        before += n
    spark = rows.sparkSession
    base = spark.createDataFrame(offsets, "score long, before long")
    took = rows.where("eligible").join(F.broadcast(base), "score")
    order = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_first(), "n_features", "weight")
    rank = F.col("before") + F.row_number().over(order)
    took = took.withColumn("rank", F.when(rank <= draws, rank)).drop("before")
    low = offsets[-1][0] if offsets else None
    rest = rows.where(~F.col("eligible") | (F.col("score") < low)) if offsets else rows
    return took.unionByName(rest.withColumn("rank", F.lit(None).cast("long")))


def importance_resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, min_words: int = 20, share_percent: int = 10, seed: int = 2024) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) for each row of docs, weighed towards the texts of target.

    docs needs doc_id and text, target text; other columns are ignored. Null and empty texts have no features, weight 0, and are never
    drawn, since they have fewer than min_words words. Rows that repeat a doc_id each count for themselves and share a variate; equal
    scores go by doc_id (null first), then by features and weight. An empty target or no documents leave the smoothed counts, so weights
    are still defined; no documents give no rows. Texts of any length are scanned whole."""
    spark = docs.sparkSession
    emitted = materialize(emit_buckets(docs, ["doc_id"], n, buckets), "buckets")
    aims = bucket_counts(emit_buckets(target, [], n, buckets), buckets)
    gains = bucket_gains(bucket_counts(emitted, buckets), aims)
    packed = "<u2" if buckets <= 1 << 16 else "<u4"
    shared = spark.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            found = [np.frombuffer(x.as_py(), packed) for x in b.column(2)]
            weights = [int(g[x].sum()) // len(x) if len(x) else 0 for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array(weights, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    kind = emitted.schema["doc_id"].dataType.simpleString()
    weighed = emitted.select("doc_id", "n_words", "features").mapInArrow(weigh, f"doc_id {kind}, n_words long, n_features long, weight long")
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= min_words).alias("eligible"))
    scored = materialize(scored, "scores")
    discard(spark, emitted)
    return ranked(scored, share_percent).select("doc_id", "n_features", "weight", "score", "rank")
