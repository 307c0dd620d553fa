"""Class-based n-gram language model with Brown classes found by exchange, trained on all rows of the training part.

p(word | history) = p(class | class before) * p(word | class). Classes come from distributed exchange clustering
(Uszkoreit and Brants, 2008): the words are dealt into buckets, and in a round each bucket moves each of its words to the class
in which the corpus is likeliest, all class counts being those of the round's start. Rounds go on until the likelihood of
the classes rises by less than GAIN a word, ROUNDS times at most; a round that lowers it is undone. Nothing of the size of
the vocabulary is sent to a driver or to all tasks: the corpus becomes chunks of integer words with a small vocabulary
each, and per round the chunks ask the buckets for the classes of their words and send back counts of word and neighbouring class.

Words are told apart by 64-bit hashes: 3 million words collide with a chance of 2e-7.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinia.llm.common import discard, materialize, partitions_for, words_of

#: Classes, the first of them that of the end of a text alone; at most ROUNDS of exchange after the seeding one, the
#: last of them one that raises log p by less than GAIN a word: by a hundredth, so that perplexity falls by less than 1 %.
CLASSES, ROUNDS, GAIN = 64, 3, 0.01
#: A chunk closes at so many distinct words or words.
CHUNK_TYPES, CHUNK_WORDS = 60_000, 800_000
#: Pseudo-counts by which transitions lean on the share of classes.
ALPHA = 20.0
END = xxhash.xxh64_intdigest(b"")

_CHUNK = "chunk string, doc_ids array<long>, lens binary, held binary, tokens binary, asks array<struct<b:int,start:int,hashes:binary,counts:binary>>"


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def _encoded(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lid: dict[bytes, int] = {}
        tokens, ids, lens, held, size = [], [], [], [], 0

        def closed():
            t = np.concatenate(tokens)
            hashes = np.array([xxhash.xxh64_intdigest(w) for w in lid], np.uint64)
            b = (hashes % np.uint64(buckets)).astype(np.int64)
            # Local numbers follow the bucket, so a bucket's words are a range and answers need no numbers.
            order = np.lexsort((hashes, b))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            t, hashes, b = rank[t], hashes[order], b[order]
            train = np.repeat(~np.array(held, bool), lens)
            counts = np.bincount(t[train], minlength=len(hashes)).astype(np.uint32)
            cut = np.r_[0, np.flatnonzero(np.diff(b)) + 1, len(b)]
            asks = [{"b": int(b[x]), "start": int(x), "hashes": hashes[x:y].tobytes(), "counts": counts[x:y].tobytes()} for x, y in zip(cut[:-1], cut[1:], strict=True)]
            small = np.uint16 if len(hashes) <= 65536 else np.uint32
            row = {"chunk": [uuid.uuid4().hex[:16]], "doc_ids": [list(ids)], "lens": [np.array(lens, np.int64).tobytes()], "held": [np.array(held, np.uint8).tobytes()], "tokens": [t.astype(small).tobytes()], "asks": [asks]}
            out = pa.RecordBatch.from_pydict(row, schema=schema)
            lid.clear()
            for x in (tokens, ids, lens, held):
                x.clear()
            return out

        binary = pa.binary()
        schema = pa.schema([("chunk", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("lens", binary), ("held", binary), ("tokens", binary), ("asks", pa.list_(pa.struct([("b", pa.int32()), ("start", pa.int32()), ("hashes", binary), ("counts", binary)])))])
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(t.as_py())
                words.append(b"")  # the end
                n = len(lid)
                for w in words:
                    if w not in lid:
                        lid[w] = n
                        n += 1
                tokens.append(np.fromiter(map(lid.__getitem__, words), np.uint32, len(words)))
                ids.append(i)
                lens.append(len(words))
                held.append(is_held_out(i))
                size += len(words)
                if n >= CHUNK_TYPES or size >= CHUNK_WORDS:
                    size = 0
                    yield closed()
        if ids:
            yield closed()

    return run


def _cat(cells, kind) -> np.ndarray:
    cells = list(cells)
    return np.frombuffer(b"".join(cells), kind) if cells else np.empty(0, kind)


#: Of each bucket one row of kind 0 (hashes of its training words in order, counts, classes) and, for each chunk that has words of the
#: bucket, one of kind 1: their places among those hashes, NOWHERE for a word that training has not seen.
_LEXICON = "b int, kind int, chunk string, start int, words binary, counts binary, classes binary, total long, types long"
NOWHERE = np.uint32(0xFFFFFFFF)


def _state_row(b: int, u: np.ndarray, n: np.ndarray, c: np.ndarray) -> tuple:
    return b, 0, "", 0, u.tobytes(), n.tobytes(), c.tobytes(), int(n.sum()), len(u)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["b", "kind", "chunk", "start", "words", "counts", "classes", "total", "types"])


def _vocabulary(pdf: pd.DataFrame) -> pd.DataFrame:
    """Training counts of the words of one bucket, and where each chunk's words are among them."""
    h, c = _cat(pdf["hashes"], np.uint64), _cat(pdf["counts"], np.uint32)
    u, inv = np.unique(h, return_inverse=True)
    n = np.bincount(inv, c, len(u)).astype(np.int64)
    place = np.where(n > 0, np.cumsum(n > 0) - 1, NOWHERE).astype(np.uint32)
    b = int(pdf["b"].iloc[0])
    rows, at, places = [], 0, place[inv]
    for chunk, start, x in zip(pdf["chunk"], pdf["start"], pdf["hashes"], strict=True):
        k = len(x) // 8
        rows.append((b, 1, chunk, start, places[at : at + k].tobytes(), b"", b"", 0, 0))
        at += k
    return _frame([_state_row(b, u[n > 0], n[n > 0], np.zeros(int((n > 0).sum()), np.uint8)), *rows])


def _parts(lexicon: pd.DataFrame):
    s = lexicon[lexicon["kind"] == 0]
    return _cat(s["words"], np.uint64), _cat(s["counts"], np.int64), _cat(s["classes"], np.uint8), lexicon[lexicon["kind"] == 1]


def _answers(counts: bool):
    """Classes, and counts where asked for, of the words that chunks have in one bucket; CLASSES stands for a word that training has not seen."""

    def run(lexicon: pd.DataFrame) -> pd.DataFrame:
        _, n, c, asks = _parts(lexicon)
        c, n = np.r_[c, np.uint8(CLASSES)], np.r_[n, 0]
        out = []
        for b, chunk, start, words in zip(asks["b"], asks["chunk"], asks["start"], asks["words"], strict=True):
            at = np.minimum(np.frombuffer(words, np.uint32), len(c) - 1)
            out.append((chunk, b, start, c[at].tobytes(), n[at].tobytes() if counts else b""))
        return pd.DataFrame(out, columns=["chunk", "b", "start", "classes", "counts"])

    return run


_ANSWERS = "chunk string, b int, start int, classes binary, counts binary"


def _laid(row, answers: pd.DataFrame):
    """Tokens of a chunk with the class and count of each local word."""
    lens, held = np.frombuffer(row.lens, np.int64), np.frombuffer(row.held, np.uint8).astype(bool)
    t = np.frombuffer(row.tokens, np.uint16 if len(row.tokens) == 2 * lens.sum() else np.uint32).astype(np.int64)
    answers = answers.sort_values("start")
    return t, lens, held, _cat(answers["classes"], np.uint8).astype(np.int64), _cat(answers["counts"], np.int64)


def _before(c: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The class before each token; that of the end before a text's first."""
    p = np.r_[0, c[:-1]]
    p[np.cumsum(lens) - lens] = 0
    return p


def _contexts(words: bool):
    """Counts of (word, class before) and (word, class after) by bucket, and of class pairs (bucket -1), over training texts."""
    k = CLASSES + 1

    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in chunk.itertuples():
            t, lens, held, cls, _ = _laid(row, answers)
            train = np.repeat(~held, lens)
            c = cls[t]
            p = _before(c, lens)
            pairs = np.bincount(p[train] * k + c[train], minlength=k * k).astype(np.int64)
            out.append((-1, "", b"", b"", pairs.tobytes(), b""))
            if not words:
                continue
            after = np.r_[c[1:], 0]
            after[np.cumsum(lens) - 1] = CLASSES  # nothing follows an end
            live = np.flatnonzero(train)
            both = np.concatenate([t[live] * (2 * k) + p[live], t[live] * (2 * k) + k + after[live]])
            cell, n = np.unique(both, return_counts=True)
            word, ctx = cell // (2 * k), (cell % (2 * k)).astype(np.uint8)
            first = np.searchsorted(word, np.arange(len(cls) + 1))
            small = np.minimum(n, 255).astype(np.uint8)  # most counts are 1; from 255 on they follow apart
            for b, start, classes in zip(answers["b"], answers["start"], answers["classes"], strict=True):
                x, y = first[start], first[start + len(classes)]
                each = np.diff(first[start : start + len(classes) + 1]).astype(np.uint8)
                out.append((b, row.chunk, each.tobytes(), ctx[x:y].tobytes(), small[x:y].tobytes(), n[x:y][n[x:y] >= 255].astype(np.uint32).tobytes()))
        return pd.DataFrame(out, columns=["b", "chunk", "each", "ctx", "n", "large"])

    return run


_CONTEXTS = "b int, chunk string, each binary, ctx binary, n binary, large binary"


def _moved(pairs_bc, seeds_bc):
    """Exchange of one bucket's words against the class counts of the round's start."""
    k = CLASSES + 1

    def run(ctx: pd.DataFrame, lexicon: pd.DataFrame) -> pd.DataFrame:
        u, n, old, asks = _parts(lexicon)
        if not len(u):
            return _frame([_state_row(int(lexicon["b"].iloc[0]), u, n, old)] if len(lexicon) else [])
        pairs, seeds = pairs_bc.value + 0.5, seeds_bc.value
        row, col = pairs.sum(1, keepdims=True), pairs.sum(0, keepdims=True)
        after = np.log(pairs / row)  # [class, next class]
        before = np.log(pairs / row / col)  # [previous class, class]; over the class's own count, as p(word | class) is
        gain = np.concatenate([before, after.T])[:, :CLASSES].astype(np.float32)
        new = np.empty(len(u), np.uint8)
        places = dict(zip(asks["chunk"], asks["words"], strict=True))
        at = _cat([places[x] for x in ctx["chunk"]], np.uint32).astype(np.int64)
        c = _cat(ctx["ctx"], np.uint8)
        owner = np.repeat(np.minimum(at, len(u)), _cat(ctx["each"], np.uint8))  # words that only held-out texts hold come last
        cnt = []
        for x, more in zip(ctx["n"], ctx["large"], strict=True):
            x = np.frombuffer(x, np.uint8).astype(np.int64)
            x[x == 255] = np.frombuffer(more, np.uint32)
            cnt.append(x)
        cnt = np.concatenate(cnt) if cnt else np.empty(0, np.int64)
        order = np.argsort(owner, kind="stable")
        owner, c, cnt = owner[order], c[order], cnt[order]
        for lo in range(0, len(u), 20_000):
            hi = min(len(u), lo + 20_000)
            x, y = np.searchsorted(owner, [lo, hi])
            m = np.bincount((owner[x:y] - lo) * (2 * k) + c[x:y], cnt[x:y], (hi - lo) * 2 * k).reshape(hi - lo, 2 * k).astype(np.float32)
            m[:, 2 * k - 1] = 0
            s = m @ gain
            s[:, 0] = -np.inf  # the end's class is its own
            new[lo:hi] = s.argmax(1)
        fixed = np.isin(u, seeds)
        new[fixed] = old[fixed]
        new[u == np.uint64(END)] = 0
        return _frame([_state_row(int(lexicon["b"].iloc[0]), u, n, new)])

    return run


def _seeded(seeds_bc):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for h in pdf["words"]:
                u = np.frombuffer(h, np.uint64)
                c = np.full(len(u), CLASSES, np.uint8)  # no class yet
                for i, s in enumerate(seeds_bc.value):
                    c[u == s] = i
                out.append(c.tobytes())
            yield pdf.assign(classes=out)

    return run


def _tops(n: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for h, c in zip(pdf["words"], pdf["counts"], strict=True):
                u, k = np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)
                best = np.lexsort((u, -k))[: n + 1]
                yield pd.DataFrame({"h": u[best].view(np.int64), "n": k[best]})

    return run


def _by_class(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for c, n in zip(pdf["classes"], pdf["counts"], strict=True):
            c, n = np.frombuffer(c, np.uint8), np.frombuffer(n, np.int64)
            yield pd.DataFrame({"c": np.arange(CLASSES), "n": np.bincount(c, n, CLASSES)[:CLASSES].astype(np.int64), "once": np.bincount(c[n == 1], minlength=CLASSES)[:CLASSES].astype(np.int64)})


def _scored(total: int, types: int, model_bc):
    def run(chunk: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        m = model_bc.value
        out = []
        for row in chunk.itertuples():
            t, lens, held, cls, cnt = _laid(row, answers)
            known = cnt > 0
            base = np.log10((cnt + 1) / (total + types + 1))
            word = np.where(known, np.log10(np.maximum(cnt, 1)) + m["emit"][np.minimum(cls, CLASSES - 1)], 0.0)
            seen = known[t]
            c = cls[t]
            p = _before(c, lens)
            # A word that training has not seen has no class: any may emit it, and the likeliest one stands for it afterwards.
            for i in np.flatnonzero(p == CLASSES):
                p[i] = m["guess"][p[i - 1]] if p[i - 1] < CLASSES else 0
            logp = np.where(seen, m["step"][p, np.minimum(c, CLASSES - 1)] + word[t], m["unseen"][p])
            at = np.cumsum(lens) - lens
            out.append(pd.DataFrame({"doc_id": pd.array([None if x is None or x != x else int(x) for x in row.doc_ids], "Int64"), "held_out": held, "n_tokens": lens, "n_known": np.add.reduceat(seen.astype(np.int64), at), "train_tokens": np.full(len(lens), total), "base_score": np.add.reduceat(base[t], at), "score": np.add.reduceat(logp, at)}))
        return pd.concat(out)

    return run


def model_of(pairs: np.ndarray, per_class: np.ndarray, once: np.ndarray) -> dict[str, np.ndarray]:
    """log10 tables: step[c, d] = p(d | c); emit[c] is added to log10 of a word's count; unseen[c] = p(a word not seen | c).

    In each class the share of words seen once is kept for the unseen one (Good-Turing), so p over all words and it sums to 1."""
    k = CLASSES
    pairs, per_class = pairs[:k, :k].astype(float), per_class.astype(float)
    share = (per_class + 1e-3) / (per_class + 1e-3).sum()
    step = (pairs + ALPHA * share) / (pairs.sum(1, keepdims=True) + ALPHA)
    # At least half a word's worth, so the unseen word always has some chance; all of it where a class has no words.
    left = np.where(per_class > 0, (once + 0.5) / (per_class + 1.0), 1.0)
    left[0] = 0.0 if per_class[0] > 0 else 1.0  # the end's class holds one known word
    if not left[step.sum(0) > 0].any():
        left[:] = 0.5
    emit = np.log10(np.maximum(1 - left, 1e-300)) - np.log10(np.maximum(per_class, 1.0))
    return {"step": np.log10(step), "emit": emit, "unseen": np.log10(np.maximum(step @ left, 1e-300)), "guess": (step * left).argmax(1)}


def likelihood(pairs: np.ndarray) -> float:
    """Natural log of the corpus by class pairs, but for the part that no classes change (Brown et al., 1992)."""
    part = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    x = pairs[:CLASSES, :CLASSES].astype(float)
    return part(x) - part(x.sum(0)) - part(x.sum(1))


def class_model_scores(docs: DataFrame, rounds: int = ROUNDS, gain: float = GAIN, trace: list[float] | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row of docs (doc_id, text).

    perplexity is that of the text, its end included. trace gets the likelihood of each round's classes.
    held_out rows (crc32 of doc_id mod 7 is 2) are scored, not learnt from; a null doc_id is not held out. Null, empty and blank
    texts are their end alone. Repeated rows count and are scored each. Texts of any length are used whole, in one chunk. With
    no training words every word is unseen. An empty table gives no rows. Other columns are ignored."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = partitions_for(spark, docs.count() * 12, 100_000)
    chunks = materialize(docs.mapInArrow(_encoded(buckets), _CHUNK), "chunks")
    corpus = chunks.drop("asks")
    lexicon = materialize(chunks.select("chunk", F.inline("asks")).groupBy("b").applyInPandas(_vocabulary, _LEXICON), "lexicon")
    places, state = lexicon.where("kind = 1"), lexicon.where("kind = 0")
    total, types = (int(x or 0) for x in state.agg(F.sum("total"), F.sum("types")).first())

    end = np.array([END], np.uint64)
    top = state.mapInPandas(_tops(CLASSES), "h long, n long").where(F.col("h") != int(end.view(np.int64)[0])).orderBy(F.desc("n"), "h").limit(CLASSES - 1).collect()
    seeds = np.r_[end, np.array([r["h"] for r in top], np.int64).view(np.uint64)]
    seeds_bc = spark.sparkContext.broadcast(seeds)
    none_bc = spark.sparkContext.broadcast(np.empty(0, np.uint64))
    state = materialize(state.mapInPandas(_seeded(seeds_bc), _LEXICON), "words")
    discard(spark)

    def whole():
        return places.unionByName(state).groupBy("b")

    def pairs_of(counted: DataFrame) -> np.ndarray:
        cells = counted.where("b = -1").select("n").mapInArrow(_summed, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
        out = np.zeros((CLASSES + 1) ** 2, np.int64)
        for c in cells:
            out[c["cell"]] = c["n"]
        return out.reshape(CLASSES + 1, CLASSES + 1)

    best: tuple[DataFrame, np.ndarray, float] | None = None
    for r in range(rounds + 1):
        counted = materialize(corpus.groupBy("chunk").cogroup(whole().applyInPandas(_answers(False), _ANSWERS).groupBy("chunk")).applyInPandas(_contexts(True), _CONTEXTS), "contexts")
        discard(spark)
        pairs = pairs_of(counted)
        now = likelihood(pairs)
        # Classes count from the first that all words have, after the seeding round.
        last, rise = best, now - best[2] if best else math.inf
        if r and rise > 0:
            best = state, pairs, now
            if trace is not None:
                trace.append(now)
        if rise < gain * max(1, total):
            discard(spark, counted)
            break
        pairs_bc = spark.sparkContext.broadcast(pairs)
        moved = materialize(counted.where("b >= 0").groupBy("b").cogroup(whole()).applyInPandas(_moved(pairs_bc, none_bc if r else seeds_bc), _LEXICON), "words")
        old, state = state, moved
        discard(spark, counted, *([old] if not r else [last[0]] if last else []))
    else:
        answers = whole().applyInPandas(_answers(False), _ANSWERS)
        pairs = pairs_of(corpus.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(_contexts(False), _CONTEXTS))
        if best is None or likelihood(pairs) > best[2]:
            best = state, pairs, likelihood(pairs)
            if trace is not None:
                trace.append(best[2])
    state, pairs, _ = best
    answered = materialize(whole().applyInPandas(_answers(True), _ANSWERS), "answers")
    per = state.mapInPandas(_by_class, "c int, n long, once long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).collect()
    n, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for x in per:
        n[x["c"]], once[x["c"]] = x["n"], x["once"]
    model_bc = spark.sparkContext.broadcast(model_of(pairs, n, once))
    del best
    discard(spark, state)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = corpus.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInPandas(_scored(total, types, model_bc), schema)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class pairs of a task's chunks, as a row for each cell that is not 0."""
    s = np.zeros((CLASSES + 1) ** 2, np.int64)
    for b in batches:
        for x in b.column(0).to_pylist():
            s += np.frombuffer(x, np.int64)
    at = np.flatnonzero(s)
    yield pa.RecordBatch.from_pydict({"cell": pa.array(at.astype(np.int32)), "n": pa.array(s[at])})
