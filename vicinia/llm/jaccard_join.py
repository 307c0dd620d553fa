"""N-gram Jaccard join as a blocked sparse product of the document by shingle incidence.

Rows of the incidence matrix are distinct texts, columns are hashed word shingles. With similarity t, two sets of sizes x and y
can only link if t * max(x, y) <= min(x, y) and if they share one of the first x - ceil(t * x) + 1 columns of either in any common
column order, so only those columns are kept; they are ordered from rare to common, and passages that many
documents share fall outside the kept part of nearly every row. A first pass over column blocks finds which rows meet in a column.
Rows that meet are dealt into cells of bounded size, and a cell takes the product of its own rows: for each row the
overlap counts with all others accumulate over its kept columns, and pairs below the bound that follows from both sizes are
discarded. Only rows of pairs that are left are sent to their cell whole, where the overlap over all columns decides exactly. A cell
gives a spanning forest of its links, as components need no more: no pair is ever a row of a table. Rows of one cell that is
too large meet block by block: first each block by itself and with some rows of the whole cell, which joins most copies,
then only blocks that rows of different components hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinia.llm.common import BROADCAST_IDS, discard, materialize, partitions_for, remove, small_batches, words_of
from vicinia.llm.components import connected_components

#: Shingles that a task holds before it passes on what it has: bounds its memory, not the input.
CHUNK = 2_000_000
#: Columns whose counts are sent to all tasks to order the rest: 12 bytes each. Others count as rare, which costs time only.
HOT_COLUMNS = 400_000
#: Words whose hashes a worker keeps.
CACHE = 200_000
#: A column that recurs more often is dealt into parts of about so many rows, so none has to fit in a task.
SPLIT = 200_000
#: Rows and shingles of a block of a cell, and rows of a cell of several blocks that all its blocks get.
BLOCK, WEIGHT, PIVOTS = 1_000, 2_000_000, 64
_M1, _M2, _MUL = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


class WordHash(dict):
    """64-bit hashes of words, kept for words that repeat."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _M1
    h = (h ^ (h >> np.uint64(33))) * _M2
    return h ^ (h >> np.uint64(33))


def shingle_set(words: list[bytes], n: int, hashes: WordHash) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; of the whole sequence if it is shorter; empty without words."""
    k = len(words)
    if not k:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, k)
    span = min(n, k)
    h = np.full(k - span + 1, span, np.uint64)
    for i in range(span):
        h = (h ^ w[i : k - span + 1 + i]) * _MUL
        h ^= h >> np.uint64(29)
    return np.unique(_mixed(h))


def key_of(words: list[bytes]) -> tuple[int, int]:
    """126 bits of a digest of the words."""
    key = xxhash.xxh3_128_intdigest(b" ".join(words))
    return key & (2**63 - 1), key >> 65


def _survey(n: int):
    """Tasks give a row for each text (kind 0: id, its set's size, 128-bit key of its words) and for each shingle that recurs in the task's chunk (kind 1: shingle, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, seen = WordHash(), [], 0, set()

        def recurring():
            h, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            h, c = h[c > 1], c[c > 1]
            return pa.RecordBatch.from_pydict({"kind": pa.array(np.ones(len(h), np.int32)), "id": pa.array(h.view(np.int64)), "size": pa.array(c.astype(np.int64)), "k1": pa.array(np.zeros(len(h), np.int64)), "k2": pa.array(np.zeros(len(h), np.int64))})

        for b in batches:
            sizes, k1, k2 = [], [], []
            for t in b.column(1):
                words = words_of(t.as_py())
                key = a, z = key_of(words)
                s = shingle_set(words, n, hashes)
                sizes.append(len(s))
                k1.append(a)
                k2.append(z)
                if len(s) and key not in seen:
                    seen.add(key)
                    held.append(s)
                    size += len(s)
                if size >= CHUNK:
                    yield recurring()
                    held, size, seen = [], 0, set()
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(len(sizes), np.int32)), "id": b.column(0).cast(pa.int64()), "size": pa.array(sizes, pa.int64()), "k1": pa.array(k1, pa.int64()), "k2": pa.array(k2, pa.int64())})
        yield recurring()

    return run


def _prefix(s: np.ndarray, t_num: int, hot: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The part of a set that a partner must meet: its rarest columns, ties by hash."""
    x = len(s)
    p = x - -(-t_num * x // 100) + 1
    rank = np.zeros(x, np.int64)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        rank = np.where(hot[at] == s, counts[at], 0)
    if not rank.any():
        return s[:p]
    return s[np.lexsort((s, rank))[:p]]


def node_of(doc_id: int, k1: int, k2: int, twice: bool) -> int:
    """A row's node: its doc_id, or a digest of its words where a doc_id comes with several texts."""
    return -1 - (k1 ^ k2) if twice else doc_id


def _columns(n: int, t_num: int, blocks: int, hot_bc):
    """Tasks give the kept part of their rows of the incidence matrix, dealt into column blocks; parts of split columns have negative ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts = hot_bc.value
        often, times = hot[counts > SPLIT], counts[counts > SPLIT]
        hashes, cols, ids, sizes, held, seen = WordHash(), [], [], [], 0, set()

        def dealt():
            c = np.concatenate(cols)
            each = np.array([len(x) for x in cols])
            i, s = np.repeat(np.array(ids, np.int64), each), np.repeat(np.array(sizes, np.int32), each)
            block = (c % np.uint64(blocks)).astype(np.int64)
            if len(often):
                at = np.minimum(np.searchsorted(often, c), len(often) - 1)
                split = often[at] == c
                part = _mixed(i.view(np.uint64)) % (times[at] // SPLIT + 1).astype(np.uint64)
                block = np.where(split, -1 - ((_mixed(c + part)) % np.uint64(blocks)).astype(np.int64), block)
            order = np.argsort(block, kind="stable")
            c, i, s, block = c[order], i[order], s[order], block[order]
            present, at = np.unique(block, return_index=True)
            ends = [*at[1:], len(block)]
            return pa.RecordBatch.from_pydict({"block": pa.array(present), "cols": pa.array([c[x:y].tobytes() for x, y in zip(at, ends, strict=True)], pa.binary()), "ids": pa.array([i[x:y].tobytes() for x, y in zip(at, ends, strict=True)], pa.binary()), "sizes": pa.array([s[x:y].tobytes() for x, y in zip(at, ends, strict=True)], pa.binary())})

        for b in batches:
            for doc_id, t, copies, twice in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = words_of(t.as_py())
                k1, k2 = key_of(words) if copies or twice else (0, 0)
                node = node_of(doc_id, k1, k2, twice)
                if not words or node in seen or copies and k1 in copies:
                    continue
                seen.add(node)
                s = shingle_set(words, n, hashes)
                cols.append(_prefix(s, t_num, hot, counts))
                ids.append(node)
                sizes.append(len(s))
                held += len(cols[-1])
                if held >= CHUNK:
                    yield dealt()
                    cols, ids, sizes, held, seen = [], [], [], 0, set()
        if cols:
            yield dealt()

    return run


def _runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Columns of one block with two rows or more, as (run, node, its size, m): columns of the same rows are one run, m their number.

    Parts of a split column are one run by its hash, whichever rows they have."""
    c = np.concatenate([np.frombuffer(x, np.uint64) for x in pdf["cols"]])
    i = np.concatenate([np.frombuffer(x, np.int64) for x in pdf["ids"]])
    s = np.concatenate([np.frombuffer(x, np.int32) for x in pdf["sizes"]])
    order = np.lexsort((i, c))
    c, i, s = c[order], i[order], s[order]
    once = np.r_[True, (c[1:] != c[:-1]) | (i[1:] != i[:-1])] if len(c) else np.zeros(0, bool)
    c, i, s = c[once], i[once], s[once]
    if pdf["block"].iloc[0] < 0:
        return pd.DataFrame({"run": c.view(np.int64), "node": i, "s": s.astype(np.int64), "m": np.ones(len(c), np.int64)})
    starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    lengths = np.diff(np.r_[starts, len(c)])
    found: dict[bytes, list] = {}
    for a, n in zip(starts[lengths > 1], lengths[lengths > 1], strict=True):
        found.setdefault(i[a : a + n].tobytes(), [s[a : a + n], 0])[1] += 1
    each = np.array([len(k) // 8 for k in found], np.int64)
    name = np.array([xxhash.xxh3_64_intdigest(k) for k in found], np.uint64).view(np.int64)
    nodes = np.frombuffer(b"".join(found), np.int64)
    size = np.concatenate([v for v, _ in found.values()]).astype(np.int64) if found else np.empty(0, np.int64)
    return pd.DataFrame({"run": np.repeat(name, each), "node": nodes, "s": size, "m": np.repeat(np.array([m for _, m in found.values()], np.int64), each)})


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for length[0] numbers, then those of the next."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by part, the first column, as one table for each part of two rows or more."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        part = t.column(0).to_numpy()
        at = np.r_[0, np.flatnonzero(part[1:] != part[:-1]) + 1]
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if y - x > 1:
                yield t.slice(x, y - x)
        held = t.slice(int(at[-1]))
    if held is not None and held.num_rows > 1:
        yield held


def _may_link(h: np.ndarray, x: np.ndarray, y: np.ndarray, t_num: int) -> np.ndarray:
    """Whether sets of sizes x >= y that share h kept columns can link: see _can_link."""
    return (h > 0) & (100 * y >= t_num * x) & ((100 + t_num) * (100 * h + t_num * x) >= 100 * t_num * (x + y))


def accumulated(runs: np.ndarray, length: np.ndarray, m: np.ndarray, cells: np.ndarray, size: np.ndarray, label: np.ndarray, side: np.ndarray, cell: int, t_num: int) -> np.ndarray:
    """Rows of a cell that the bound leaves a partner of another label: overlap counts over runs, each m columns, row by row of the product.

    runs, m and cells have length[0] entries of the first row, then those of the next. Of a pair that meets in several cells only the smallest
    counts. side: if some are 1, rows of side 0 meet those of side 1; else all rows meet each other."""
    n = len(length)
    at = np.cumsum(length) - length
    _, first, col = np.unique(runs, return_index=True, return_inverse=True)
    order = np.argsort(col, kind="stable")
    holders = np.repeat(np.arange(n), length)[order]
    c_at = np.searchsorted(col[order], np.arange(len(first) + 1))
    c_len, c_m, c_cell = np.diff(c_at), m[first].astype(float), cells[first]
    two, left = bool(side.any()), np.zeros(n, bool)
    for a in np.flatnonzero(side == 0):
        mine = col[at[a] : at[a] + length[a]]
        mine = mine[c_len[mine] > 1]
        if not len(mine):
            continue
        who, each = holders[_ranges(c_at[mine], c_len[mine])], c_len[mine]
        h = np.bincount(who, np.repeat(c_m[mine], each), n)
        x, y = np.maximum(size[a], size), np.minimum(size[a], size)
        able = _may_link(h, x, y, t_num) & (label != label[a])
        if two:
            able &= side == 1
        else:
            able[: a + 1] = False
        if able.any():
            least = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(least, who, np.repeat(c_cell[mine], each))
            able &= least == cell
            if able.any():
                left |= able
                left[a] = True
    return left


def _able(t_num: int):
    """Rows (part, cell, side, label, node, s, runs, m, cells) arrive sorted by part; gives those that accumulated() leaves, as (part, side, label, node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _parts(batches):
            lists = [t.column(i).combine_chunks() for i in (6, 7, 8)]
            cell, side, label, size = (t.column(i).to_numpy() for i in (1, 2, 3, 5))
            runs, m, cells = (x.flatten().to_numpy() for x in lists)
            left = accumulated(runs, pc.list_value_length(lists[0]).to_numpy().astype(np.int64), m, cells, size, label, side, cell[0], t_num)
            if left.any():
                yield from t.select([0, 2, 3, 4]).filter(pa.array(left)).combine_chunks().to_batches()

    return run


def product(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray, t_num: int, hot: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, j) between sets of different labels that join them, found row by row of the sparse product.

    side: if some are 1, rows of side 0 meet those of side 1; else all rows meet each other. Labels that a link joins become one,
    and pairs within one label are not looked at any more: the links returned are a spanning forest."""
    n, label = len(sets), label.copy()
    size = np.array([len(s) for s in sets], np.int64)
    kept = [_prefix(s, t_num, hot, counts) for s in sets]
    k_len = np.array([len(k) for k in kept], np.int64)
    k_at = np.cumsum(k_len) - k_len
    _, col = np.unique(np.concatenate(kept), return_inverse=True)
    order = np.argsort(col, kind="stable")
    holders = np.repeat(np.arange(n), k_len)[order]  # the rows of each kept column
    c_at = np.searchsorted(col[order], np.arange(col.max() + 2))
    names, whole = np.unique(np.concatenate(sets), return_inverse=True)
    w_at = np.cumsum(size) - size
    mark = np.zeros(len(names), bool)
    two, links = bool(side.any()), []
    for a in np.flatnonzero(side == 0):
        mine = col[k_at[a] : k_at[a] + k_len[a]]
        h = np.bincount(holders[_ranges(c_at[mine], c_at[mine + 1] - c_at[mine])], minlength=n)
        x, y = np.maximum(size[a], size), np.minimum(size[a], size)
        able = _may_link(h, x, y, t_num) & (label != label[a])
        if two:
            able &= side == 1
        else:
            able[: a + 1] = False
        near = np.flatnonzero(able)
        if not len(near):
            continue
        near = near[np.argsort(-h[near], kind="stable")]
        mark[whole[w_at[a] : w_at[a] + size[a]]] = True
        for k in range(0, len(near), 64):
            b = near[k : k + 64]
            b = b[label[b] != label[a]]
            if not len(b):
                continue
            both = np.add.reduceat(mark[whole[_ranges(w_at[b], size[b])]].astype(np.int64), np.cumsum(size[b]) - size[b])
            for j in b[100 * both >= t_num * (size[a] + size[b] - both)]:
                if label[j] != label[a]:
                    links.append((int(a), int(j)))
                    label[label == label[j]] = label[a]
        mark[whole[w_at[a] : w_at[a] + size[a]]] = False
    return links


def _met(n: int, t_num: int, hot_bc):
    """Rows (part, side, label, node, k1, twice, text) arrive sorted by part; the rows of each part meet in one product."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, part, rows = WordHash(), None, {}

        def met():
            if len(rows) < 2:
                return pa.RecordBatch.from_pydict({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
            nodes = sorted(rows)
            links = product([rows[i][2] for i in nodes], np.array([rows[i][1] for i in nodes], np.int64), np.array([rows[i][0] for i in nodes]), t_num, *hot_bc.value)
            return pa.RecordBatch.from_pydict({"a": pa.array([nodes[i] for i, _ in links], pa.int64()), "b": pa.array([nodes[j] for _, j in links], pa.int64())})

        for b in batches:
            for p, side, label, node, k1, twice, t in zip(*(b.column(i).to_pylist() for i in range(6)), b.column(6), strict=True):
                if p != part:
                    yield met()
                    part, rows = p, {}
                if node in rows:
                    continue
                words = words_of(t.as_py())
                if not twice or key_of(words)[0] == k1:  # a row that only shares its doc_id has another text
                    rows[node] = (side, label, shingle_set(words, n, hashes))
        yield met()

    return run


def _can_link(h: Column | str, x: str, y: Column, t_num: int) -> Column:
    """Whether sets of sizes x and y that share at most h of their kept columns can link.

    Of the set whose kept part ends first in the column order, no kept column lies in the other set outside its kept part. So
    the intersection has at most h columns and the fewer than t * max(x, y) + 1 that are not kept, and must have t / (1 + t) * (x + y)
    of them. In y the bound falls up to x and rises after it: a range of sizes is ruled out if both of its ends are."""
    h = F.col(h) if isinstance(h, str) else h
    return (100 + t_num) * (100 * h + t_num * F.greatest(F.col(x), y)) >= 100 * t_num * (F.col(x) + y)


def _sized(small: DataFrame, rows: int) -> DataFrame:
    """A side of a join: broadcast if it was counted at BROADCAST_IDS rows at most, else both sides are shuffled."""
    return F.broadcast(small) if rows <= BROADCAST_IDS else small.hint("shuffle_merge")


def jaccard_components(docs: DataFrame, n: int = 5, similarity_percent: int = 80, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs, which needs doc_id and text; other columns are ignored.

    Null, empty and blank texts have no shingles and link with nothing. Texts of the same words are one row of the matrix.
    Rows that repeat a doc_id are one document: with the same words they get equal results, with other words each text
    has its own n_shingles and the document has the links of all its texts. A null doc_id is no node; its row gets the
    component of documents with its words, else null. An empty table gives an empty result. Texts of any length are used whole."""
    spark, t = docs.sparkSession, similarity_percent
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    survey = materialize(docs.mapInArrow(_survey(n), "kind int, id long, size long, k1 long, k2 long"), "survey")
    every = survey.where("kind = 0").select(F.col("id").alias("doc_id"), "size", "k1", "k2")
    top = survey.where("kind = 1").groupBy("id").agg(F.sum("size").alias("c")).where("c >= 4").orderBy(F.desc("c"), "id").limit(HOT_COLUMNS).toPandas()
    hot = top["id"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hot)
    hot_bc = spark.sparkContext.broadcast((hot[order], top["c"].to_numpy(np.int64)[order]))

    # A text's row of the matrix is that of its smallest doc_id; marks has the doc_ids whose rows are copies or differ from each other.
    texts = every.where("size > 0 and doc_id is not null").groupBy("doc_id", "k1", "k2").agg(F.max("size").alias("size"))
    texts = texts.join(texts.groupBy("k1", "k2").agg(F.min("doc_id").alias("first")), ["k1", "k2"])
    twice = materialize(texts.groupBy("doc_id").agg((F.count("*") > 1).alias("twice"), F.collect_list(F.when(F.col("first") != F.col("doc_id"), F.col("k1"))).alias("copies")).where("twice or size(copies) > 0"), "marks")
    texts = texts.join(_sized(twice.where("twice").select("doc_id", "twice"), twice.where("twice").count()), "doc_id", "left").withColumn("twice", F.coalesce("twice", F.lit(False)))
    own = F.when(F.col("twice"), -1 - F.col("k1").bitwiseXOR(F.col("k2"))).otherwise(F.col("doc_id"))
    nodes = materialize(texts.where("first = doc_id").select("k1", "k2", "doc_id", "size", "twice", own.alias("node")), "nodes")
    shingles = nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    one = docs.where("doc_id is not null and text is not null").join(_sized(twice, twice.count()), "doc_id", "left").select("doc_id", "text", "copies", F.coalesce("twice", F.lit(False)).alias("twice"))
    blocks = partitions_for(spark, shingles / 5, 500_000)
    kept = one.mapInArrow(_columns(n, t, blocks, hot_bc), "block long, cols binary, ids binary, sizes binary")
    found = kept.groupBy("block").applyInPandas(_runs, "run long, node long, s long, m long")
    runs = materialize(found.groupBy("run", "node", "s").agg(F.sum("m").alias("m")), "runs")
    discard(spark)

    # Rows of a run that by its sizes and all their shared columns can link with some other.
    hits = runs.groupBy("node").agg(F.sum("m").alias("h"))
    ends = runs.groupBy("run").agg(F.min("s").alias("least"), F.max("s").alias("most"))
    low, high = F.greatest(F.col("least"), F.col("s") * t / 100), F.least(F.col("most"), F.col("s") * 100 / t)
    able = runs.join(ends, "run").join(hits, "node").where(_can_link("h", "s", low, t) | _can_link("h", "s", high, t)).select("run", "node", "s", "m")
    able = materialize(able, "able")
    # A cell has the runs that meet the same smallest row, at one remove: so most rows are in one or two, and copies in one.
    heads = able.groupBy("run").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("run", "head")
    lone = able.join(heads, "run")
    hubs = lone.groupBy("node").agg(F.min("head").alias("hub"))
    cells = lone.join(hubs, "node").groupBy("run").agg(F.min("hub").alias("cell"))
    dealt = materialize(able.join(cells, "run").select("cell", "run", "node", "s", "m"), "cells")
    lists = dealt.groupBy("node").agg(F.collect_list(F.struct("run", "m", "cell")).alias("l"))
    lists = lists.select("node", *[F.col(f"l.{c}").alias(f"{c}s") for c in ("run", "m", "cell")])
    rows = dealt.select("cell", "node", "s").distinct()
    per = rows.groupBy("cell").agg(F.count("*").alias("c"), F.ceil(F.greatest(F.count("*") / block, F.sum("s") / WEIGHT)).cast("int").alias("k"))
    per = materialize(per, "per")
    home = F.pmod(F.xxhash64(F.lit(1), "node"), F.col("k")).cast("int")
    shared = (F.col("k") > 1) & (F.pmod(F.xxhash64(F.lit(2), "node"), F.ceil(F.col("c") / PIVOTS)) == 0)
    placed = rows.join(per, "cell").select("node", "s", F.lit(0).alias("side"), F.col("node").alias("label"), "cell", F.explode(F.when(shared, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(home))).alias("i"))
    placed = placed.select("node", "s", "side", "label", "cell", F.xxhash64("cell", "i").alias("part"))

    linked: list[DataFrame] = []

    def met(placed: DataFrame) -> DataFrame:
        asked = placed.join(lists, "node").select("part", "cell", "side", "label", "node", "s", "runs", "ms", "cells")
        asked = asked.repartition(partitions_for(spark, dealt.count(), 100_000), "part").sortWithinPartitions("part", "node")
        left = asked.mapInArrow(_able(t), "part long, side int, label long, node long")
        left = materialize(left.join(nodes.select("node", "doc_id", "k1", "twice", "size"), "node"), "left")
        count, weight = left.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        full = docs.join(_sized(left, count), "doc_id").select("part", "side", "label", "node", "k1", "twice", "text")
        full = full.repartition(partitions_for(spark, weight, 4_000_000), "part").sortWithinPartitions("part", "node")
        out = materialize(full.mapInArrow(_met(n, t, hot_bc), "a long, b long"), "linked")
        discard(spark, left)
        linked.append(out)
        return out

    links = met(placed)
    if not per.where("k > 1").isEmpty():
        # What large cells leave open: rows in runs that still hold several components, in blocks of the most frequent one and of the others.
        label = connected_components(links)
        large = dealt.join(per.where("k > 1").select("cell"), "cell").join(label, "node", "left").withColumn("label", F.coalesce("component", "node"))
        mixed = large.groupBy("run").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("run")
        open_ = materialize(large.join(mixed, "run", "left_semi").select("cell", "node", "s", "label").distinct(), "open")
        main = open_.groupBy("cell", "label").agg(F.count("*").alias("c")).groupBy("cell").agg(F.max_by("label", F.struct("c", "label")).alias("main"))
        sides = open_.join(main, "cell").withColumn("in_main", F.col("label") == F.col("main"))
        parts = lambda at: F.ceil(F.greatest(F.count(F.when(at, 1)) / block, F.coalesce(F.sum(F.when(at, F.col("s"))), F.lit(0)) / WEIGHT)).cast("int")
        grid = sides.groupBy("cell").agg(parts(F.col("in_main")).alias("kl"), parts(~F.col("in_main")).alias("ks"))
        sides = sides.join(grid, "cell").withColumn("i", F.pmod(F.xxhash64(F.lit(3), "node"), F.when(F.col("in_main"), F.col("kl")).otherwise(F.col("ks"))).cast("int"))
        to = F.expr("""if(in_main, transform(sequence(0, ks - 1), j -> named_struct('part', xxhash64(cell, 1, j, i), 'side', 1)),
            concat(transform(sequence(0, kl - 1), j -> named_struct('part', xxhash64(cell, 1, i, j), 'side', 0)),
                transform(sequence(0, ks - 1), j -> named_struct('part', xxhash64(cell, 2, least(i, j), greatest(i, j)), 'side', if(j < i, 1, 0)))))""")
        placed = sides.select("node", "s", "label", "cell", F.explode(to).alias("x")).select("node", "s", F.col("x.side").alias("side"), "label", "cell", F.col("x.part").alias("part"))
        links = links.unionByName(met(placed))

    # Texts under one doc_id are one document.
    several = texts.where("twice").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("doc_id", "node")
    several = several.join(several.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))
    component = connected_components(links.unionByName(several)).join(nodes.select("node", "doc_id"), "node")
    component = component.join(component.groupBy("component").agg(F.min("doc_id").alias("component_id")), "component").select("node", "component_id")
    groups = materialize(nodes.join(component, "node", "left").select("k1", "k2", F.coalesce("component_id", "doc_id").alias("component_id")), "groups")
    out = every.join(groups, ["k1", "k2"], "left").select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = materialize(out, "components")
    remove(spark, survey, twice, nodes, runs, able, dealt, per, groups, *linked)
    return out
