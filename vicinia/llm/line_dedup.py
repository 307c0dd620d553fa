"""Line deduplication by a sharded minimal perfect hash.

Lines are counted as pairs of 64-bit hashes, once a document. Those that at least two documents hold are dealt to shards by the
first hash, and each shard gets a minimal perfect hash over its lines: levels of bit arrays in which a line owns the place that no
other line of the level claims, its number being the rank of that bit. The number indexes three plain arrays: a fingerprint (the
second hash), how many documents hold the line, and the largest doc_id that does. Documents do not join lines: a task packs what
its documents ask of a shard into one row of bytes, the shard answers from its arrays, and only places of lines that go
come back. Lines that very many documents hold, at most one for each shard by the rule that finds them, form a further index that all
tasks hold, so no shard is asked more than about twice its share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinia.llm.common import LOWER, UPPER, discard, let, materialize, partitions_for

SPACES = " \t\n\x0b\x0c\r"
#: Id of rows without a doc_id: one document, below all others.
NO_ID = -(1 << 63)
#: Lines that a shard is asked for, lines that it indexes, and lines that a task gathers before it sends what it has; memory of tasks follows from these.
ASKED, INDEXED, GATHERED = 1 << 20, 1 << 18, 1 << 20
#: Places of a level for each line that is left; levels after which the rest, a line in a million, is searched in a sorted list.
SPREAD, LEVELS = 2, 24


# ---- minimal perfect hash


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A further 64-bit hash of a line for each level: xor-shift and multiply rounds over the hash and the level's number."""
    with np.errstate(over="ignore"):
        x = h ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Numbers 0..n-1 for n distinct 64-bit keys, without the keys: about three and a half bits for each."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, left = [], [], keys.astype(np.uint64)
        while len(left) and len(sizes) < LEVELS:
            size = -(-SPREAD * len(left) // 64) * 64
            place = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[place]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, "<u8"), np.sort(left))

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number; -1, or that of some other key, for a key that is not in the set."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                return out
            at = self.starts[level] + (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            mine = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[mine]] = (self.ones[at >> 6] + below)[mine]
            open_ = open_[~mine]
        if len(self.rest) and len(open_):
            i = np.minimum(np.searchsorted(self.rest, keys[open_]), len(self.rest) - 1)
            out[open_] = np.where(self.rest[i] == keys[open_], self.ones[-1] + i, -1)
        return out


class LineIndex:
    """A perfect hash and the arrays it indexes."""

    NAMES = ("sizes", "bits", "rest", "prints", "counts", "last")
    TYPES = ("<i8", "<u8", "<u8", "<i8", "<i8", "<i8")

    def __init__(self, *arrays: np.ndarray):
        self.places = PerfectHash(*arrays[:3])
        self.arrays = arrays
        self.prints, self.counts, self.last = arrays[3:]

    @classmethod
    def of(cls, h: np.ndarray, prints: np.ndarray, counts: np.ndarray, last: np.ndarray) -> LineIndex:
        p = PerfectHash.of(h)
        order = np.argsort(p.number(h))
        return cls(p.sizes, p.bits, p.rest, prints[order], counts[order], last[order])

    def row(self) -> list[bytes]:
        return [np.ascontiguousarray(a).astype(t).tobytes() for a, t in zip(self.arrays, self.TYPES, strict=True)]

    @classmethod
    def read(cls, row: list[bytes]) -> LineIndex:
        return cls(*[np.frombuffer(b, t) for b, t in zip(row, cls.TYPES, strict=True)])

    def probe(self, h: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents that hold it, the largest of their ids) of each line; no documents for a line that is not indexed."""
        if not len(self.prints):
            return np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        i = self.places.number(h)
        found = (i >= 0) & (self.prints[i] == prints)
        return np.where(found, self.counts[i], 0), self.last[i]


# ---- lines of documents


def line_key(line: Column) -> Column:
    """What a line is compared by: without blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, version, lines): lines of min_chars and more as (place, h, print); version tells rows of one doc_id apart by their text."""
    keyed = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(i.alias("place"), line_key(x).alias("key")))
    long = F.filter(keyed, lambda x: F.char_length(x["key"]) >= min_chars)
    lines = F.transform(long, lambda x: F.struct(x["place"].alias("place"), F.xxhash64(x["key"]).alias("h"), F.xxhash64(F.lit(1), x["key"]).alias("print")))
    return docs.select(*_ids(), lines.alias("lines")).where(F.size("lines") > 0)


def _ids() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("version")]


def line_counts(hashed: DataFrame) -> DataFrame:
    """(h, print, n_docs, last) of each line that at least two documents hold: the pairs of line and document are made distinct, then counted with partial sums."""
    one = hashed.select("doc", F.explode("lines").alias("l")).select("l.h", "l.print", "doc").distinct()
    return one.groupBy("h", "print").agg(F.count("*").alias("n_docs"), F.max("doc").alias("last")).where("n_docs > 1")


def _shard_rows(key: tuple, table: pa.Table) -> pa.Table:
    col = lambda c: table.column(c).to_numpy()
    row = LineIndex.of(col("h").view(np.uint64), col("print"), col("n_docs"), col("last")).row()
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32())} | {n: pa.array([b], pa.binary()) for n, b in zip(LineIndex.NAMES, row, strict=True)})


def line_index(counts: DataFrame, shards: int) -> DataFrame:
    """One row a shard: its perfect hash and arrays as bytes. Lines are distinct and dealt by hash, so shards are even."""
    dealt = counts.select(F.pmod("h", F.lit(shards)).cast("int").alias("shard"), "h", "print", "n_docs", "last")
    return dealt.groupBy("shard").applyInArrow(_shard_rows, "shard int, " + ", ".join(f"{n} binary" for n in LineIndex.NAMES))


ASK = ("doc", "version", "place", "h", "print")


def _answer(index: LineIndex, asked: dict[str, np.ndarray], min_docs: int) -> pa.RecordBatch:
    n, last = index.probe(asked["h"].view(np.uint64), asked["print"])
    go = (n >= min_docs) & (last != asked["doc"])
    return pa.RecordBatch.from_arrays([pa.array(asked[c][go], pa.int64()) for c in ASK[:3]], names=list(ASK[:3]))


def dropped_places(hashed: DataFrame, index: DataFrame, hot: LineIndex, shards: int, min_docs: int) -> DataFrame:
    """(doc, version, place) of each line that goes."""
    kept_here = hashed.sparkSession.sparkContext.broadcast(hot.row())

    def batch(asked: dict[str, np.ndarray], mine: LineIndex) -> Iterator[pa.RecordBatch]:
        """What the common lines answer at once, and a row of bytes for each shard that is asked."""
        at_once = _answer(mine, asked, min_docs)
        one = at_once.num_rows > 0
        n, _ = mine.probe(asked["h"].view(np.uint64), asked["print"])
        asked = {c: a[n == 0] for c, a in asked.items()}
        shard = asked["h"] % shards
        order = np.argsort(shard, kind="stable")
        ids, starts = np.unique(shard[order], return_index=True)
        cut = {c: np.split(a[order], starts[1:]) for c, a in asked.items()} if len(ids) else {c: [] for c in ASK}
        rows = {"shard": pa.array([-1] * one + ids.tolist(), pa.int32())}
        rows |= {c: pa.array(([at_once.column(c).to_numpy().tobytes()] if one and c in ASK[:3] else [b""] * one) + [x.tobytes() for x in cut[c]], pa.binary()) for c in ASK}
        yield pa.RecordBatch.from_pydict(rows)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = LineIndex.read(kept_here.value)
        held: list[dict[str, np.ndarray]] = []
        joined = lambda: {c: np.concatenate([h[c] for h in held]) for c in ASK}
        for b in batches:
            lines = b.column(2)
            each = np.diff(lines.offsets.to_numpy())
            flat = lines.flatten()
            held.append({"doc": np.repeat(b.column(0).to_numpy(), each), "version": np.repeat(b.column(1).to_numpy(), each)} | {c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ASK[2:]})
            if sum(len(h["h"]) for h in held) >= GATHERED:
                yield from batch(joined(), mine)
                held = []
        if held:
            yield from batch(joined(), mine)

    def probe(key: tuple, asked: pa.Table, shard: pa.Table) -> pa.Table:
        if not shard.num_rows:
            return pa.Table.from_batches([], _OUT)
        mine = LineIndex.read([shard.column(n)[0].as_py() for n in LineIndex.NAMES])
        out = [_answer(mine, {c: np.frombuffer(asked.column(c)[i].as_py(), "<i8") for c in ASK}, min_docs) for i in range(asked.num_rows)]
        return pa.Table.from_batches(out, _OUT)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b.column(c)[i].as_py(), "<i8")) for c in range(3)], names=list(ASK[:3]))

    asked = materialize(hashed.mapInArrow(pack, "shard int, " + ", ".join(f"{c} binary" for c in ASK)), "asked")
    cols = ", ".join(f"{c} long" for c in ASK[:3])
    at_shards = asked.where("shard >= 0").groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(probe, cols)
    return at_shards.unionByName(asked.where("shard < 0").select(*ASK[:3]).mapInArrow(unpack, cols))


_OUT = pa.schema([(c, pa.int64()) for c in ASK[:3]])


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, text without the lines that go, n_lines before and n_dropped, for each row of docs.

    A line whose key (blanks at both ends stripped, A-Z lowered) has min_chars code points and is in min_docs documents goes from all but
    the largest doc_id that holds it, where each of its occurrences stays; other lines stay, joined by line feeds. A null or empty text is one
    empty line. Rows that share a doc_id are one document, as are all rows without one, which comes below all others; each row keeps
    its own text. Other columns are ignored. No documents give no rows. Texts of any length are handled whole."""
    spark = docs.sparkSession
    hashed = materialize(hashed_lines(docs, min_chars), "lines")
    counts = materialize(line_counts(hashed), "counts")
    asked = hashed.agg(F.sum(F.size("lines"))).first()[0] or 0
    shards = max(partitions_for(spark, asked, ASKED), counts.count() // INDEXED + 1)
    # At most `shards` lines can each be held by more than this many documents.
    common = counts.where(F.col("n_docs") > asked // shards).collect()
    as_array = lambda c: np.array([r[c] for r in common], np.int64)
    hot = LineIndex.of(as_array("h").view(np.uint64), *[as_array(c) for c in ("print", "n_docs", "last")])
    index = line_index(counts.where(F.col("n_docs") <= asked // shards), shards)
    gone = dropped_places(hashed, index, hot, shards, min_docs)
    gone = materialize(gone.groupBy("doc", "version").agg(F.collect_set(F.col("place").cast("int")).alias("gone")), "gone")
    discard(spark, hashed, counts)

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), *_ids())
    text = F.col("text")

    def kept(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(stay)).cast("long").alias("n_dropped"), F.array_join(F.transform(stay, lambda i: lines[i]), "\n").alias("text"))

    whole = F.struct(F.size(lines_of(text)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.coalesce(text, F.lit("")).alias("text"))
    # Texts are dealt by document at every size; the small side is hashed, so texts are not sorted.
    done = texts.join(gone.hint("shuffle_hash"), ["doc", "version"], "left").select("doc_id", F.when(F.col("gone").isNull(), whole).otherwise(let(lines_of(text), kept)).alias("r"))
    return done.select("doc_id", "r.text", "r.n_lines", "r.n_dropped")
