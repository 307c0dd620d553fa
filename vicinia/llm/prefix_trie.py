"""Prefix trie of conversations that start with turns of their family's base conversation, merged family first.

Turns travel as digests and lengths, never as texts. A family (the conversations whose id has the same base) is cogrouped with its
base conversation's turns, each conversation is rebuilt, and the family's own trie is made; a node is named by a digest of its path.
Only these nodes are shuffled, one row for each node of a family however many of its conversations share it, and merged by
name with partial sums.

Sums over subtrees follow from chains. A node's smallest member is the smallest member, too, of each node below it on that
conversation's path, so the nodes of one conversation are an unbroken chain that hangs from a node of a smaller conversation, and
(conv_id, depth) names a node. Chain totals are summed up the tree of chains by pointer doubling, in log2 of the nesting of chains
rounds over one narrow row a conversation; inside a chain a window adds what hangs below each node.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vicinia.llm.common import discard, materialize

FAMILY, HEADS = 100, 6
ROOT = bytes(16)
#: Families whose members that end at one node are joined into one text before the digest: ids of 100 000 conversations, a megabyte or so.
BLOCK = 1_000
_NODES = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int32()), ("chars", pa.int64()), ("base", pa.int64()), ("conv_id", pa.int64()), ("n_convs", pa.int64()), ("ends", pa.string())])
_COLUMNS = "key binary, parent binary, depth int, chars long, base long, conv_id long, n_convs long, ends string"


def crc_heads(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % HEADS


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, base, turn, digest, chars) of each row that has a conv_id."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    id_ = F.col("conv_id").cast("long")
    # Lengths go first, so that no two pairs of role and text give the same bytes.
    name = F.concat_ws(":", F.char_length(text("role")), text("role"), text("text"))
    rows = conversations.where("conv_id is not null")
    return rows.select(id_.alias("conv_id"), (id_ - id_ % FAMILY).alias("base"), F.col("turn").alias("turn"), F.unhex(F.md5(name)).alias("digest"), F.char_length(text("text")).cast("long").alias("chars"))


def _in_order(t: pa.Table) -> pa.Table:
    return t.sort_by([("conv_id", "ascending"), ("turn_known", "ascending"), ("turn", "ascending"), ("digest", "ascending")])


def _family_trie(heads: Callable[[int], int]) -> Callable:
    def trie(key: tuple, own: pa.Table, base: pa.Table) -> pa.Table:
        row = lambda t: list(zip(t.column("digest").to_pylist(), t.column("chars").to_pylist(), strict=True))
        first = row(_in_order(base))
        own = _in_order(own)
        turns, ids = row(own), own.column("conv_id").to_pylist()
        nodes: dict[bytes, list] = {ROOT: [None, 0, 0, None, 0, []]}
        at = 0
        while at < len(ids):  # conversations in order of id, so that the first at a node is its smallest
            end = at
            while end < len(ids) and ids[end] == ids[at]:
                end += 1
            h = heads(ids[at])
            here = ROOT
            for depth, turn in enumerate([None, *first[:h], *turns[at + h : end]]):
                if turn is not None:
                    below = hashlib.blake2b(here + turn[0], digest_size=16).digest()
                    node = nodes.setdefault(below, [here, depth, turn[1], None, 0, []])
                    here = below
                else:
                    node = nodes[ROOT]
                if node[3] is None:
                    node[3] = ids[at]
                node[4] += 1
            nodes[here][5].append(ids[at])
            at = end
        base_id = key[0].as_py()
        made = [(k, p, d, c, base_id, m, n, ",".join(map(str, e)) or None) for k, (p, d, c, m, n, e) in nodes.items()]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made, strict=True), _NODES, strict=True)], schema=_NODES)

    return trie


def family_nodes(conversations: DataFrame, heads: Callable[[int], int] = crc_heads) -> DataFrame:
    """The nodes of each family's trie: name, parent's name, depth, code points of the last text, smallest member, members, and the ids that end there in order."""
    turns = turns_of(conversations).withColumn("turn_known", F.col("turn").isNotNull())
    own = turns.select("base", "conv_id", "turn_known", "turn", "digest", "chars")
    return own.groupBy("base").cogroup(own.where("conv_id = base").groupBy("base")).applyInArrow(_family_trie(heads), _COLUMNS)


def end_digests(nodes: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes at which conversations end.

    Families are ranges of ids, so a node's list is that of its families one after another. Blocks of families are joined first; the digest then
    runs over a node's blocks in order as a stream that holds one block at a time. SHA-256 cannot be split, so one task reads a node's blocks."""
    blocks = nodes.where("ends is not null").withColumn("block", F.expr(f"base div {FAMILY * BLOCK}"))
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("base", "ends"))), lambda x: x["ends"]), ",")
    blocks = blocks.groupBy("key", "block").agg(one.alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        done: list[tuple[bytes, str]] = []
        for b in batches:
            for key, ends in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key != now:
                    if now is not None:
                        done.append((now, digest.hexdigest()))
                    now, digest = key, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
            yield _pairs(done)
            done = []
        yield _pairs(done + ([(now, digest.hexdigest())] if now is not None else []))

    return blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ends").mapInArrow(run, "key binary, ends_sha256 string")


def _pairs(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([d for _, d in rows], pa.string())], names=["key", "ends_sha256"])


def chain_totals(chains: DataFrame, root: int) -> DataFrame:
    """chains (conv_id, up, up_depth, leaves, saved), up being the conversation whose chain it hangs from: leaves and saved with all that hangs below added.

    After round r a chain has the sums of all chains less than 2^r hops below it, and a pointer 2^r hops up. Sums go up with partial aggregation;
    pointers are looked up by key, one narrow row a chain."""
    spark = chains.sparkSession
    now = materialize(chains.withColumn("p", F.col("up")), "chains")
    while not now.where("p is not null").isEmpty():
        climbing = now.where("p is not null")
        add = climbing.groupBy(F.col("p").alias("conv_id")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
        # The root's chain ends each climb: what points there, often most chains, has no further pointer and is not looked up.
        jump = climbing.where(F.col("p") != root).select("conv_id", "p").join(climbing.select(F.col("conv_id").alias("p"), F.col("p").alias("pp")), "p").select("conv_id", "pp")
        more = now.join(add, "conv_id", "left").join(jump, "conv_id", "left")
        more = more.select("conv_id", "up", "up_depth", (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), F.col("pp").alias("p"))
        last, now = now, materialize(more, "chains")
        discard(spark, last)
    return now.drop("p")


def prefix_trie(conversations: DataFrame, heads: Callable[[int], int] = crc_heads) -> DataFrame:
    """One row for each distinct sequence of first turns of the rebuilt conversations, from the root: conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns go by number, null first, those of one number by the digest of role and text; repeated rows are turns of their own. A null role or text is empty.
    Rows without a conv_id belong to no conversation. A conversation that keeps no turns is a member of the root alone. Other columns are ignored.
    An empty table gives no rows. A family is one group of digests: 100 conversations, 40 bytes a turn."""
    spark = conversations.sparkSession
    parts = materialize(family_nodes(conversations, heads), "families")
    merged = parts.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"))
    merged = materialize(merged, "nodes")
    children = merged.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = merged.join(children, "key", "left").join(end_digests(parts), "key", "left")
    nodes = nodes.select("key", "parent", "conv_id", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    nodes = materialize(nodes, "nodes")

    chains = nodes.groupBy("conv_id").agg(F.min_by("parent", "depth").alias("parent"), F.min("depth").alias("head"), F.sum("leaf").alias("leaves"), F.sum("saved").alias("saved"))
    # Chains that hang from the root, which may be most of them, need no lookup: the root's conversation is the smallest.
    root = (nodes.where("depth = 0").first() or {"conv_id": 0})["conv_id"]
    top = chains.where("head <= 1").select("conv_id", F.when(F.col("head") == 1, F.lit(root).cast("long")).alias("up"), (F.col("head") - 1).alias("up_depth"), "leaves", "saved")
    lower = chains.where("head > 1").join(nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("up")), "parent")
    chains = top.unionByName(lower.select("conv_id", "up", (F.col("head") - 1).alias("up_depth"), "leaves", "saved"))
    chains = chain_totals(chains, root)

    hung = chains.where("up is not null").groupBy(F.col("up").alias("conv_id"), F.col("up_depth").alias("depth")).agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    over = lambda own, more: F.sum(F.col(own) + F.coalesce(F.col(more), F.lit(0))).over(below)
    parent = F.when(F.col("depth") > 0, F.coalesce(F.when(F.col("depth") == F.col("up_depth") + 1, F.col("up")), F.col("conv_id")))
    out = nodes.join(hung, ["conv_id", "depth"], "left").withColumn("n_leaves", over("leaf", "l")).withColumn("saved_tokens", over("saved", "s"))
    out = out.join(chains.select("conv_id", "up", "up_depth"), "conv_id")
    out = out.select("conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    discard(spark, parts, merged)
    return out
