"""Prefix trie, importance resampling and line deduplication against plain versions, SQL and odd input."""

import glob
import hashlib
import math
import os
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from vicinia.llm import importance, line_dedup, prefix_trie, queries
from vicinia.llm.common import load

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, place int, h long, gone string, score string"
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "One line of twenty code points\n" * 3), (5, "\tone LINE of twenty code points  \nshort"), (5, "one line of twenty code points"), (6, "é " * 60_000 + "\n" + "one line of twenty code points"), (7, "\n\n"), (7, "\n\n"), (None, "one line of twenty code points\r\nno id"), (None, "other"), (8, "20 points: ÀÉÎÕÜÀÉÎÕÜ"), (9, "20 points: ÀÉÎÕÜÀÉÎÕÜ"), (10, "20 points: àÉÎÕÜÀÉÎÕÜ")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2, "y", "z") for i, t in ODD], DOCS)


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_importance", "op13_line_dedup"])
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    rel = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, SF)
    assert sorted(rel.columns) == sorted(df.columns)
    want = [tuple(r) for r in rel.select(*[duckdb.ColumnExpression(c) for c in df.columns]).fetchall()]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())


# ---- lines


def plain_lines(rows, min_chars=20, min_docs=3):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = [x for x in lines if not (len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != (-1 if i is None else i))]
        out.append((i, "\n".join(keep), len(lines), len(lines) - len(keep)))
    return out


def got_lines(df):
    return Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect())


def test_lines_of_odd_rows(odd):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped"]
    assert got_lines(out) == Counter(plain_lines(ODD))
    assert line_dedup.dedup_lines(odd.limit(0)).collect() == []


def test_lines_with_other_thresholds_and_many_shards(spark, monkeypatch):
    """A line that nearly all documents hold, short shards and small packets; the common line is answered by the index that all tasks hold."""
    r = random.Random(5)
    pool = [f"line number {i} of a pool" for i in range(300)]
    rows = [(i, "\n".join(["the line that all of them hold"] * (r.random() < 0.9) + r.choices(pool, k=r.randint(0, 6)))) for i in range(400)]
    monkeypatch.setattr(line_dedup, "ASKED", 64)
    monkeypatch.setattr(line_dedup, "GATHERED", 100)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chars, docs in ((20, 2), (5, 5), (200, 3)):
        assert got_lines(line_dedup.dedup_lines(df, chars, docs)) == Counter(plain_lines(rows, chars, docs))


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5_000, 100_000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 63), 1 << 63, n + n // 10, dtype=np.int64))[:n].view(np.uint64)
    p = line_dedup.PerfectHash.of(keys)
    assert sorted(p.number(keys).tolist()) == list(range(len(keys)))
    assert n < 5_000 or (p.bits.nbytes * 8 + 64 * len(p.rest)) / n < 5


def test_perfect_hash_keeps_the_rest_of_its_levels(monkeypatch):
    monkeypatch.setattr(line_dedup, "LEVELS", 1)
    keys = np.arange(1, 2_000, dtype=np.uint64)
    p = line_dedup.PerfectHash.of(keys)
    assert len(p.rest) > 0 and sorted(p.number(keys).tolist()) == list(range(len(keys)))


def test_line_index_tells_other_lines_apart():
    r = np.random.default_rng(1)
    h, prints = r.integers(0, 1 << 62, 3_000), r.integers(0, 1 << 62, 3_000)
    index = line_dedup.LineIndex.read(line_dedup.LineIndex.of(h.view(np.uint64), prints, np.arange(3_000) + 2, np.arange(3_000) * 7).row())
    n, last = index.probe(h.view(np.uint64), prints)
    assert (n == np.arange(3_000) + 2).all() and (last == np.arange(3_000) * 7).all()
    assert not index.probe(r.integers(0, 1 << 62, 9_000).view(np.uint64), r.integers(0, 1 << 62, 9_000))[0].any()
    assert not index.probe(h.view(np.uint64), prints + 1)[0].any()


# ---- importance


def plain_buckets(text, n, buckets):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words, run = [], ""
    for c in low + " ":
        if c.isascii() and not ("0" <= c <= "9" or "a" <= c <= "z"):
            words += [run] if run else []
            run = ""
        else:
            run += c
    return len(words), Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(words) - k + 1))


def plain_importance(docs, target, n, buckets, min_words, share):
    feats = [plain_buckets(t, n, buckets) for _, t in docs]
    s, t = sum((f for _, f in feats), Counter()), sum((plain_buckets(x, n, buckets)[1] for x in target), Counter())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for (i, _), (w, f) in zip(docs, feats, strict=True):
        weight = sum(gain(b) * c for b, c in f.items()) // f.total() if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, f.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), w >= min_words, None])
    ok = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0], r[1], r[2]))
    for rank, r in enumerate(ok[: share * len(ok) // 100]):
        r[5] = rank + 1
    return Counter((*r[:4], r[5]) for r in rows)


@pytest.mark.parametrize("n,buckets,min_words,share", [(1, 10_000, 20, 10), (3, 500, 1, 50), (2, 70_000, 2, 100), (1, 10, 1, 0)])
def test_importance_of_odd_rows(spark, odd, n, buckets, min_words, share):
    docs = [*ODD, (20, "the quick brown fox " * 9), (21, "the quick brown fox " * 9), (22, "Some 3 other-words, and œuvre"), (23, "x")]
    target = ["quick brown foxes and œuvre", None, "", "words THE 3"]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, n_words int")
    aims = spark.createDataFrame([(t, 5) for t in target], "text string, bucket int")
    got = importance.importance_resample(df, aims, n, buckets, min_words, share)
    assert Counter(tuple(r) for r in got.collect()) == plain_importance(docs, target, n, buckets, min_words, share)


def test_importance_of_empty_tables(spark, odd):
    none = odd.limit(0)
    assert importance.importance_resample(none, odd).collect() == []
    assert importance.importance_resample(odd, none).count() == len(ODD)


def test_ring_gives_the_runs(spark):
    words = [b"a", b"bc", b"\xc3\xa9", b"d9"]
    runs = [b" ".join(words[i - k : i]) for i in range(1, 5) for k in range(1, min(i, 3) + 1)]
    assert importance.ring_states(words, 3) == [zlib.crc32(x) for x in runs]


# ---- trie


def plain_trie(rows, heads=prefix_trie.crc_heads):
    by = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            name = f"{len(role or '')}:{role or ''}:{text or ''}"
            by[c].append((turn is not None, turn or 0, hashlib.md5(name.encode()).digest(), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(t)] for c, t in by.items()}
    base = lambda c: int(math.fmod(c, 100))
    built = {c: own.get(c - base(c), [])[: heads(c)] + own[c][heads(c) :] for c in own}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
        ends[tuple(built[c])].append(c)
    leaves, saved, kids = Counter(), Counter(), Counter()
    for p in members:
        kids[p[:-1]] += bool(p)
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
    return Counter((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


CONV = "conv_id long, turn long, role string, text string, base long, depth int, key string"
COLS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def got_trie(df):
    return Counter(tuple(r[c] for c in COLS) for r in df.collect())


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k") for r in rows], CONV)


def random_conversations(seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 30), *range(90, 130), 250, 400, 401, -5, -100, -130, 5_000_000, 5_000_001]:
        n = r.choice([0, 1, 2, 6, 7, 9])
        rows += [(c, r.choice([t, t, None, 1]), r.choice(["user", "assistant", None]), r.choice(["a", "bb", "", None, "čé"])) for t in range(n)]
    return rows + [(None, 1, "user", "no id"), rows[3], rows[3]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie_of_random_conversations(spark, seed):
    rows = random_conversations(seed)
    assert got_trie(prefix_trie.prefix_trie(conversations(spark, rows))) == plain_trie(rows)


def test_trie_of_nested_chains_and_copies(spark):
    """Each conversation follows the one before one turn further, so that chains hang from chains eleven deep; then copies over two families."""
    rows = [(c, t, "user", str(t) if t < c else f"own{c}") for c in range(1, 12) for t in range(c + 1)]
    rows += [(c, t, "user", f"same{t}") for c in (*range(300, 320), *range(700, 720)) for t in range(4)]
    none = lambda c: 0
    assert got_trie(prefix_trie.prefix_trie(conversations(spark, rows), none)) == plain_trie(rows, none)
    assert got_trie(prefix_trie.prefix_trie(conversations(spark, rows))) == plain_trie(rows)


def test_ends_are_joined_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 2)
    rows = [(c, 0, "user", "same") for c in range(-1_000, 1_500, 7)]
    assert got_trie(prefix_trie.prefix_trie(conversations(spark, rows), lambda c: 0)) == plain_trie(rows, lambda c: 0)


def test_trie_of_an_empty_table(spark):
    assert prefix_trie.prefix_trie(load(spark, SF, "conversations").limit(0)).collect() == []
