"""Embedding near-dedup by Euclidean p-stable hashing.

Normalised vectors are projected on Gaussian directions; floor((projection + offset) / width) over `k` directions is a bucket
of one of `tables` tables (Datar et al., 2004). Cosine c is distance sqrt(2 - 2c), so the chance that a pair at the
threshold meets in a table is known: k follows the logarithm of the number of vectors, which keeps the rows of a
bucket about constant, and the number of tables follows from k and the recall asked for. Vectors that meet are first compared
by sketches of a byte a component, with a bound on their error that no pair at the threshold can fail; only vectors with such a
partner are sent whole, and those are checked by exact double cosine. Equal vectors are one row with a weight. A bucket
larger than BLOCK is dealt into pairs of blocks, so no task holds more than two blocks of it and none of its pairs is
left out. Vectors of different lengths never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinia.llm.common import discard, materialize, partitions_for
from vicinia.llm.components import connected_components

BLOCK = 512
#: Width of a hash cell in units of distance between unit vectors; near the best exponent for cosine 0.9.
WIDTH = 2.5


def meet(distance: float, width: float = WIDTH) -> float:
    """Chance that two points at a distance share one p-stable cell."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def shape(n: int, cosine: float, recall: float, far: float = math.sqrt(2), fill: int = 16) -> tuple[int, int]:
    """(k, tables): about `fill` unrelated rows in a bucket, and `recall` for pairs just at the threshold."""
    p1, p2 = meet(math.sqrt(2 - 2 * cosine)), meet(far)
    k = max(1, math.ceil(math.log(max(n, fill * 2) / fill) / -math.log(p2)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - p1**k)))


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for v in b.column(1).to_pylist():
            x = np.array([np.nan if y is None else y for y in v], np.float64) if v else np.empty(0)
            # Scaling by the largest component first keeps tiny and huge vectors from losing their norm.
            top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
            out.append((x / top / np.linalg.norm(x / top)).tobytes() if top > 0 else None)
        yield pa.RecordBatch.from_pydict({"vec_id": b.column(0), "unit": pa.array(out, pa.binary())})


def _codes(k: int, tables: int, seed: int):
    """Bucket codes of all tables, and a sketch: components in steps of a 127th of the largest, and the distance that this moves the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        for b in batches:
            units = b.column(1).to_pylist()
            lengths = np.array([len(u) // 8 for u in units])
            for dim in np.unique(lengths).tolist():
                if dim not in planes:
                    rng = np.random.default_rng([seed, dim])
                    planes[dim] = rng.standard_normal((dim, k * tables)), rng.uniform(0, WIDTH, k * tables), rng.integers(1, 2**62, k, dtype=np.int64) | 1
                a, off, mul = planes[dim]
                at = np.flatnonzero(lengths == dim)
                x = np.frombuffer(b"".join(units[i] for i in at), np.float64).reshape(-1, dim)
                cells = np.floor((x @ a + off) / WIDTH).astype(np.int64).reshape(len(x), tables, k)
                code = ((cells * mul).sum(2) >> 8).astype(np.int32)
                step = np.abs(x).max(1) / 127
                q = np.rint(x / step[:, None]).astype(np.int8)
                off_by = np.linalg.norm(x - q * step[:, None], axis=1)
                some = pa.array(at)
                yield pa.RecordBatch.from_pydict({"rep": b.column(0).take(some), "unit": b.column(1).take(some), "weight": b.column(2).take(some), "codes": pa.array([c.tobytes() for c in code], pa.binary()), "sketch": pa.array([c.tobytes() for c in q], pa.binary()), "step": pa.array(step), "off_by": pa.array(off_by)})

    return run


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (cell, dim), the first two columns, as one table for each."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
        cell, dim = t.column(0).to_numpy(), t.column(1).to_numpy()
        at = np.r_[0, np.flatnonzero((cell[1:] != cell[:-1]) | (dim[1:] != dim[:-1])) + 1]
        for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if y - x > 1:
                yield t.slice(x, y - x)
        held = t.slice(int(at[-1]))
    if held is not None and held.num_rows > 1:
        yield held


def _sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows that meet each other: those of side 0 and side 1, or all where they have side 2."""
    one = bool((side == 2).all())
    return (np.arange(len(side)), np.arange(len(side)), True) if one else (np.flatnonzero(side == 0), np.flatnonzero(side == 1), False)


def _maybe(cosine: float):
    """Of rows (cell, dim, t, rep, side, sketch, step, off_by) those that have a partner in their cell by sketch, as (cell, dim, t, rep, side)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _cells(batches):
            dim = c.column(1)[0].as_py()
            ia, ib, one = _sides(c.column(4).to_numpy())
            if not len(ia) or not len(ib):
                continue
            q = np.frombuffer(b"".join(c.column(5).to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
            q *= c.column(6).to_numpy()[:, None].astype(np.float32)
            e = c.column(7).to_numpy()
            near = q[ia] @ q[ib].T + (e[ia][:, None] + e[ib][None, :] + np.outer(e[ia], e[ib])) >= cosine - 1e-4
            if one:
                np.fill_diagonal(near, False)
            has = np.unique(np.r_[ia[near.any(1)], ib[near.any(0)]])
            if len(has):
                yield from c.select(range(5)).take(has).combine_chunks().to_batches()

    return run


def _checked(cosine: float):
    """Rows (cell, dim, t, rep, side, weight, unit, codes) of each cell, compared once. Gives links as counts and a spanning part."""

    def compared(c: pa.Table):
        dim, t = c.column(1)[0].as_py(), c.column(2)[0].as_py()
        rep, weight = c.column(3).to_numpy(), c.column(5).to_numpy()
        ia, ib, one = _sides(c.column(4).to_numpy())
        x = np.frombuffer(b"".join(c.column(6).to_pylist()), np.float64).reshape(-1, dim)
        codes = np.frombuffer(b"".join(c.column(7).to_pylist()), np.int32).reshape(len(x), -1)
        near = x[ia] @ x[ib].T >= cosine
        p, q = np.nonzero(np.triu(near, 1) if one else near)
        p, q = ia[p], ib[q]
        if len(p) and t:
            new = ~(codes[p, :t] == codes[q, :t]).any(1)  # a pair counts in the first table in which it meets
            p, q = p[new], q[new]
        if not len(p):
            return None
        n = np.bincount(p, weight[q], len(rep)) + np.bincount(q, weight[p], len(rep))
        # A spanning forest of the cell's links: components need no more.
        root = np.arange(len(rep))
        tree = []

        def top(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, j in zip(p.tolist(), q.tolist(), strict=True):
            a, b = top(i), top(j)
            if a != b:
                root[b] = a
                tree.append((i, j))
        has = np.flatnonzero(n)
        return (
            np.r_[rep[has], rep[[i for i, _ in tree]]],
            np.r_[n[has].astype(np.int64), np.zeros(len(tree), np.int64)],
            np.r_[np.zeros(len(has), bool), np.ones(len(tree), bool)],
            np.r_[np.zeros(len(has), np.int64), rep[[j for _, j in tree]]],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _cells(batches):
            if (x := compared(c)) is not None:
                yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in zip(("a", "n", "link", "b"), x, strict=True)})

    return run


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.98, seed: int = 17) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors, which needs vec_id and embedding; other columns are ignored.

    A vector that is null, zero, or has null or non-finite components links with nothing; vectors of different lengths do not link.
    Rows of equal direction link with each other. Null ids are passed on without links; rows that repeat a vec_id with
    another vector each have that vector's result. No rows give no rows. Recall is that for pairs just at the threshold; nearer pairs are found more often. Never gives a pair below it."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    units = materialize(rows.mapInArrow(_units, "vec_id long, unit binary"), "units")
    good = units.where("unit is not null and vec_id is not null")
    reps = good.groupBy("unit").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")).withColumn("rep", F.monotonically_increasing_id())
    reps = materialize(reps.select("rep", "unit", "weight", "first"), "vectors")  # written, so the numbers stay
    n = reps.count()
    k, tables = shape(n, cosine, recall)
    codes = materialize(reps.mapInArrow(_codes(k, tables, seed), "rep long, unit binary, weight long, codes binary, sketch binary, step double, off_by double"), "codes")
    coded = codes.withColumn("dim", (F.octet_length("unit") / 8).cast("int"))

    slots = F.expr(f"transform(sequence(0, {tables - 1}), t -> named_struct('t', t, 'code', substring(codes, t * 4 + 1, 4)))")
    dealt = coded.select("rep", "dim", F.explode(slots).alias("s")).select("rep", "dim", F.col("s.t").alias("t"), F.col("s.code").alias("code"))
    sizes = dealt.groupBy("dim", "t", "code").agg(F.count("*").alias("c")).where("c > 1")
    big = F.ceil(F.col("c") / BLOCK).cast("int")
    # Buckets of more than a block: row in block i takes part in (i, i), (i, j > i) on the left and (h < i, i) on the right.
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    cells = F.expr("transform(sequence(0, blocks - 1), j -> named_struct('lo', least(j, mine), 'hi', greatest(j, mine), 'side', case when j = mine then 2 when j < mine then 1 else 0 end))")
    placed = dealt.join(sizes, ["dim", "t", "code"]).withColumn("blocks", big).withColumn("mine", mine).select("rep", "dim", "t", F.xxhash64("t", "code").alias("h"), F.explode(cells).alias("x"))
    placed = placed.select("rep", F.xxhash64("h", "x.lo", "x.hi").alias("cell"), "dim", "t", F.col("x.side").alias("side"))
    parts = partitions_for(spark, n * tables, 100_000)

    def met(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "cell").sortWithinPartitions("cell", "dim", "side", "rep")

    sketched = placed.join(coded.select("rep", "dim", "sketch", "step", "off_by"), ["rep", "dim"]).select("cell", "dim", "t", "rep", "side", "sketch", "step", "off_by")
    maybe = materialize(met(sketched).mapInArrow(_maybe(cosine), "cell long, dim int, t int, rep long, side int"), "maybe")
    discard(spark)
    full = maybe.join(coded.select("rep", "dim", "weight", "unit", "codes"), ["rep", "dim"]).select("cell", "dim", "t", "rep", "side", "weight", "unit", "codes")
    found = materialize(met(full).mapInArrow(_checked(cosine), "a long, n long, link boolean, b long"), "links")
    discard(spark, maybe)

    links = found.where("not link").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    comp = reps.select("rep", "first").join(connected_components(found.where("link")).withColumnRenamed("node", "rep"), "rep")
    comp = comp.join(comp.groupBy("component").agg(F.min("first").alias("c")), "component").select("rep", "c")
    per = reps.join(links, "rep", "left").join(comp, "rep", "left")
    per = per.select("unit", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("c", "first").alias("c"))
    out = units.join(per, "unit", "left").select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id")).alias("component_id"))
    out = materialize(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))), "result")
    discard(spark, units, reps, codes, found)
    return out
