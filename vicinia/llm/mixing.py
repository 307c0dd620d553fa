"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree; DataFrame operations only.

Each source gets its share of all words by weight, at most `most` times its own size, what is over being shared again by
weight. A keyed hash permutes a source's documents into blocks. A source that must repeat takes all its blocks whole times first;
the rest is an exact quota of blocks. A tree deals all blocks taken, whole passes and rest, out to output shards: a node is a group
of sources with the number of its blocks in each shard, and its smaller groups, down to single sources, draw theirs from it by halving the
shards again and again, without replacement. So each source's counts are a multivariate-hypergeometric draw, quotas hold exactly at
every level, and no row holds all sources. A shard then takes its number of blocks of each source, disjoint from any
other's because it takes the next ones of the permutation (each pass has its own), and orders its documents by a local hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinia.llm.common import WORD, let, materialize, remove

#: Blocks of a source; a block is what is drawn or left as a whole, so a source meets its quota to 1/BLOCKS of its size.
BLOCKS = 1024

#: Children of a node of the splitting tree: sources, or groups of them, that one row deals out.
FAN = 16


def word_count(text: Column) -> Column:
    """Runs of anything but space and \\t..\\r; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row a source, so windows over all of them are small.

    The level at which capped shares use up all words: sources in the order of cap by weight reach their caps first."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ratio = Window.orderBy("r", F.col("source").asc_nulls_last())
    before, after = ratio.rowsBetween(Window.unboundedPreceding, -1), ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", turn.cast("double")).withColumn("cap", most * F.col("source_size")).withColumn("r", F.col("cap") / F.col("w"))
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double"))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    # The first whose cap is not reached sets the level for it and all after it.
    s = s.withColumn("nth", F.row_number().over(ratio)).withColumn("at", F.min_by("level", F.when(F.col("level") <= F.col("r"), F.col("nth"))).over(every))
    return s.select("source", "source_size", F.coalesce(F.least("cap", F.col("at") * F.col("w")), "cap").alias("target"))


def hypergeometric(good: Column, bad: Column, n: Column, u: Column) -> Column:
    """How many of n draws without replacement from good + bad are good: the distribution's inverse at u in [0, 1).

    Chances are added up from the likeliest count on, upwards and then downwards, each from the one before it, so nothing
    overflows; beyond 12 standard deviations and 40 they are too small for u to tell. A draw costs some 24 deviations of steps."""

    def reach(p: Column) -> Column:
        total = p["k"] + p["b"]
        lo, hi = F.greatest(F.lit(0.0), p["n"] - p["b"]), F.least(p["n"], p["k"])
        mode = F.least(hi, F.greatest(lo, F.floor((p["n"] + 1) * (p["k"] + 1) / (total + 2)).cast("double")))
        far = F.lit(12) * F.sqrt(p["n"] * p["k"] * p["b"] * (total - p["n"]) / F.greatest(total - 1, F.lit(1.0))) / F.greatest(total, F.lit(1.0)) + 40
        ends = {"lo": F.greatest(lo, mode - F.ceil(far)), "mode": mode, "hi": F.least(hi, mode + F.ceil(far))}
        return F.struct(*(p[f].alias(f) for f in "kbnu"), *(v.cast("long").alias(f) for f, v in ends.items()))

    def walk(p: Column) -> Column:
        down = F.when(p["mode"] > p["lo"], F.sequence(p["mode"] - 1, p["lo"], F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        steps = F.concat(F.sequence(p["mode"], p["hi"]), down)

        def chance(w: Column, x: Column) -> Column:
            y, less = x.cast("double"), p["b"] - p["n"]
            below = F.when(x == p["mode"] - 1, F.lit(1.0)).otherwise(w) * (y + 1) * (less + y + 1) / ((p["k"] - y) * (p["n"] - y))
            return F.when(x == p["mode"], F.lit(1.0)).when(x > p["mode"], w * (p["k"] - y + 1) * (p["n"] - y + 1) / (y * (less + y))).otherwise(below)

        def add(s: Column, x: Column) -> Column:
            return let(chance(s["w"], x), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum")))

        def find(s: Column, x: Column) -> Column:
            return let(chance(s["w"], x), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"), s["at"].alias("at"), F.when(s["x"].isNull() & (s["sum"] + w > s["at"]), x).otherwise(s["x"]).alias("x")))

        none = [F.lit(0.0).alias("w"), F.lit(0.0).alias("sum")]
        at = F.aggregate(steps, F.struct(*none), add)["sum"] * p["u"]
        found = F.aggregate(steps, F.struct(*none, at.alias("at"), F.lit(None).cast("long").alias("x")), find)["x"]
        return F.coalesce(found, p["mode"])

    given = F.struct(*(c.cast("double").alias(f) for f, c in (("k", good), ("b", bad), ("n", n), ("u", u))))
    return let(let(given, reach), walk)


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, c: a + c)


def _halved(parts: Column, room: Column, half: int, key: list[Column]) -> Column:
    """Each part, the blocks that some shards get together, as one part for the first `half` of these shards and one for the others."""

    def cut(n: Column, i: Column) -> Column:
        u = F.pmod(F.xxhash64(*key, F.lit(half), i), F.lit(1 << 40)) / F.lit(float(1 << 40))
        left, right = (_total(F.slice(room, 2 * half * i + 1 + at, F.lit(half))) for at in (0, half))
        return let(hypergeometric(left, right, n, u), lambda x: F.array(x, n - x))

    return F.flatten(F.transform(parts, cut))


def _dealt(quota: Column, room: Column, shards: int, key: list[Column]) -> Column:
    """A quota of blocks dealt out to shards with `room` for so many each: halves of the shards, halves of these, down to one."""
    parts = F.array(quota)
    while shards > 1:
        shards //= 2
        parts = _halved(parts, room, shards, key)
    return parts


def _next_child(shards: int, key: list[Column]):
    """Step of a node over its children: a child's blocks are dealt out, and what they leave is the room of the next one."""

    def step(s: Column, c: Column) -> Column:
        one = lambda g: F.array(F.struct(c["child"].alias("node"), g.alias("room")))
        return let(_dealt(c["blocks"], s["room"], shards, [*key, c["child"]]), lambda g: F.struct(F.zip_with(s["room"], g, lambda a, b: a - b).alias("room"), F.concat(s["out"], one(g)).alias("out")))

    return step


def shard_counts(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(sk, counts): how many blocks of each source each shard gets, out of (sk, blocks); shards are rounded up to a power of two.

    A node of the tree is a group of sources with what each shard takes of it. Its FAN children, groups of sources or single
    ones, draw their quotas from that one after another, each by halving the shards; what is left is the next one's room. So a row is
    as wide as the shards and FAN, whatever the number of sources, and each level is one job over its nodes. Shards hold equal
    numbers of blocks to within one a halving."""
    spark = quotas.sparkSession
    width = 1 << max(0, math.ceil(math.log2(shards)))
    # One row a source, numbered like those of source_targets.
    ranked = materialize(quotas.select("sk", "blocks", (F.row_number().over(Window.orderBy("sk")) - 1).cast("long").alias("node")), "quotas")
    n, levels = ranked.count(), 1
    while FAN**levels < n:
        levels += 1
    room = F.array("total")
    for _ in range(width.bit_length() - 1):
        room = F.flatten(F.transform(room, lambda c: let(F.floor(c / 2).cast("long"), lambda h: F.array(h, c - h))))
    tree = ranked.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("total")).select(F.lit(0).cast("long").alias("node"), room.alias("room"))
    written = []
    for level in range(1, levels + 1):
        group = F.floor(F.col("node") / FAN ** (levels - level)).cast("long")
        children = ranked.groupBy(group.alias("child")).agg(F.sum("blocks").alias("blocks")).groupBy(F.floor(F.col("child") / FAN).cast("long").alias("node")).agg(F.array_sort(F.collect_list(F.struct("child", "blocks"))).alias("children"))

        begin = F.struct(F.col("room"), F.array().cast("array<struct<node:bigint,room:array<bigint>>>").alias("out"))
        # A written level keeps each draw from being worked out again for each level below it.
        tree = materialize(tree.join(children, "node").select(F.explode(F.aggregate("children", begin, _next_child(width, [F.lit(seed), F.lit(level)]), lambda s: s["out"])).alias("c")).select("c.node", "c.room"), "split")
        remove(spark, *written)
        written = [tree]
    out = materialize(ranked.join(tree, "node").select("sk", F.col("room").alias("counts")), "counts")
    remove(spark, ranked, tree)
    return out


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, sk, first, blocks): how many blocks taken of each source a shard gets, and from which on, out of (sk, blocks)."""
    each = shard_counts(quotas, shards, seed).select("sk", "counts", F.posexplode("counts").alias("shard", "blocks"))
    return each.select(F.col("shard").cast("long").alias("shard"), "sk", _total(F.slice("counts", F.lit(1), F.col("shard"))).alias("first"), "blocks")


def drawn_blocks(blocks: Column, rest: Column, tries: int = 16) -> Column:
    """Greedy fill of `rest` words by (block, bsize) in order, from `tries` places of the permutation; that which ends nearest to the
    quota counts, the first of equals. Null for a source without words."""
    nothing = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, b: Column) -> Column:
        fits = s["sum"] + b["bsize"] <= rest
        return F.struct((s["sum"] + F.when(fits, b["bsize"]).otherwise(0)).alias("sum"), F.when(fits, F.concat(s["out"], F.array(b["block"]))).otherwise(s["out"]).alias("out"))

    def nearer(s: Column) -> Column:
        """One block more, the one that ends nearest to the quota, if that is nearer than without it."""
        left = rest - s["sum"]
        out = F.filter(blocks, lambda b: ~F.array_contains(s["out"], b["block"]))
        best = F.array_min(F.transform(out, lambda b: F.struct(F.abs(left - b["bsize"]).alias("off"), b["block"].alias("block"))))
        return let(best, lambda b: F.when(b["off"] < left, F.struct(b["off"].alias("off"), F.concat(s["out"], F.array(b["block"])).alias("out"))).otherwise(F.struct(left.alias("off"), s["out"].alias("out"))))

    def one(r: Column) -> Column:
        at = (F.size(blocks) * r / tries).cast("int")
        turned = F.concat(F.slice(blocks, at + 1, F.size(blocks)), F.slice(blocks, F.lit(1), at))
        return let(F.aggregate(turned, nothing, step, nearer), lambda e: F.struct(e["off"].alias("off"), r.alias("r"), e["out"].alias("out")))

    return F.array_min(F.transform(F.array(*map(F.lit, range(tries))), one))["out"]


def mix(docs: DataFrame, most: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), shards: int = 16, blocks: int = BLOCKS, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) for each row of docs (doc_id, text, source).

    Null texts have size 0. A null source is a source, the last. taken is size times the whole passes over the source, plus
    size if the document's block is among those drawn. copies has a (shard, position) for each copy taken, whole passes
    first and the drawn one last; it is empty for documents that are not taken and for those without words. Rows that
    repeat are separate documents unless they are equal in id, text and source: those share a block. An empty table gives no rows."""
    rows = docs.select("doc_id", word_count(F.col("text")).alias("size"), "source")
    sk = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    rows = materialize(rows.withColumn("sk", sk).withColumn("h", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "size")), "sizes")
    # Blocks of the permutation: equal ranges of the keyed hash. Their exact sizes decide which are drawn, so hash chance adds no error.
    rows = rows.withColumn("block", F.shiftrightunsigned(F.col("h"), 40).cast("int") % blocks)
    per = rows.groupBy("sk", F.col("source"), "block").agg(F.sum("size").alias("bsize"), F.max("size").alias("largest"))
    per = materialize(per, "blocks")
    sizes = per.groupBy("source").agg(F.sum("bsize").alias("source_size"))
    target = source_targets(sizes, most, weights).withColumn("sk", sk)
    target = target.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-12))).otherwise(0).cast("long"))
    target = materialize(target.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))), "targets")

    # In the order of the permutation a block is drawn if it still fits, and one more if that ends nearer, so a source
    # misses its quota by half its smallest block left out at most. A source has `blocks` of them at most, so its list is bounded however many documents it has.
    lists = per.where("bsize > 0").groupBy("sk").agg(F.array_sort(F.collect_list(F.struct("block", "bsize"))).alias("list")).join(target.select("sk", "passes", "rest"), "sk")
    chosen = drawn_blocks(F.col("list"), F.col("rest"))
    last = F.transform(F.coalesce(chosen, F.array().cast("array<int>")), lambda b: F.struct(F.col("passes").alias("pass"), b.alias("block")))
    passes = F.when(F.col("passes") > 0, F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).otherwise(F.array().cast("array<bigint>"))
    whole = F.flatten(F.transform(passes, lambda p: F.transform(F.col("list"), lambda b: F.struct(p.alias("pass"), b["block"].alias("block")))))
    # One order for each pass, by a keyed hash; the shards take the next ones of it.
    keyed = F.transform(F.concat(whole, last), lambda x: F.struct(x["pass"].alias("pass"), F.xxhash64(F.lit(seed + 2), "sk", x["pass"], x["block"]).alias("turn"), x["block"].alias("block")))
    taken = materialize(lists.select("sk", F.posexplode(F.array_sort(keyed)).alias("nth", "b")).select("sk", "nth", "b.pass", "b.block"), "taken")
    quotas = taken.groupBy("sk").agg(F.count("*").alias("blocks"))
    counts = shard_counts(quotas, shards, seed)
    ends = F.transform(F.sequence(F.lit(1), F.size("counts")), lambda i: _total(F.slice("counts", F.lit(1), i)))
    shard = F.size(F.filter("ends", lambda e: e <= F.col("nth")))
    dealt = taken.join(counts.select("sk", ends.alias("ends")), "sk").select("sk", "block", "pass", shard.alias("shard"))
    placed = materialize(dealt.groupBy("sk", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("at")), "placed")
    remove(docs.sparkSession, per, taken, counts)
    out = rows.join(target.select("sk", "source_size", "target"), "sk").join(placed, ["sk", "block"], "left")
    at = F.when(F.col("size") > 0, F.col("at"))
    copies = F.transform(at, lambda p: F.struct(p["shard"].alias("shard"), F.xxhash64(F.lit(seed + 1), p["shard"], "h", p["pass"]).alias("position")))
    copies = F.coalesce(copies, F.array().cast("array<struct<shard:int,position:bigint>>"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size(copies)).alias("taken"), copies.alias("copies"))
