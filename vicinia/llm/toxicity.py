"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Each word enters as its own hashed embedding beside the mean embedding of its character n-grams. Windows of WINDOW words that
overlap by WINDOW - STRIDE run through a GRU in both directions; attention weighs the states into one vector and
that gives the window's log-odds. A text is as toxic as its worst window. Labels are by text, so training is multiple-instance:
the windows that score highest stand for their text. The first input channels start from shrunken label statistics of
words and n-grams in the training rows, and all of them are trained.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinia.llm.common import remainder, small_batches, words_of

#: Labelled rows that training may use at most, by hash of doc_id.
SAMPLE = 8_000
#: Of the harmless windows of those rows an epoch trains on the highest of so many texts and on SPREAD others for each text, and looks
#: anew at the scores of so many. None takes all of them. They bound the work of the task that trains; scoring has no bounds.
HARMLESS, SPREAD, RESCORED = 4_000, 0.25, 6_000
#: Windows of one training step.
STEP = 64
WINDOW, STRIDE = 48, 32
WORD_ROWS, GRAM_ROWS = 1 << 17, 1 << 15
DW, DC, H = 8, 8, 8
#: Words whose input a scoring worker keeps.
KEPT = 150_000
#: Words that are scored at a time.
BATCH = 60_000


def grams(word: bytes) -> list[int]:
    """Hashes of the 4-grams of bytes with marked ends, and of the ends themselves."""
    w = b"<" + word + b">"
    return [zlib.crc32(w[i : i + 4]) % GRAM_ROWS for i in range(max(1, len(w) - 3))] + [zlib.crc32(b"^" + w[:6]) % GRAM_ROWS, zlib.crc32(b"$" + w[-4:]) % GRAM_ROWS]


def word_row(word: bytes) -> int:
    return zlib.crc32(word) % WORD_ROWS


def starts(n: int) -> range:
    """Window starts over n words; one window, of what there is, if they fit."""
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters by name; forward and backward over a batch of windows, time first."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        d = DW + DC
        u = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"word": (0.02 * r.standard_normal((WORD_ROWS, DW))).astype(np.float32), "gram": (0.02 * r.standard_normal((GRAM_ROWS, DC))).astype(np.float32), "att": u(2 * H, H), "attv": u(H), "out": u(2 * H), "bias": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"x{k}": u(d, 3 * H), f"h{k}": u(H, 3 * H), f"c{k}": np.zeros(3 * H, np.float32)}

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Input vectors of distinct words."""
        each = [grams(w) for w in words]
        n = np.array([len(g) for g in each], np.int64)
        flat = np.fromiter((x for g in each for x in g), np.int64, int(n.sum()))
        return self.vectors(np.array([word_row(w) for w in words], np.int64), flat, n)

    def vectors(self, rows: np.ndarray, flat: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Word embeddings beside the means of n rows each of the n-gram embeddings."""
        sums = np.add.reduceat(self.p["gram"][flat], np.cumsum(n) - n)
        return np.concatenate([self.p["word"][rows], sums / n[:, None].astype(np.float32)], 1)

    def states(self, gates: np.ndarray, live: np.ndarray, k: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, batch, H); gates are the inputs' share, live marks words against padding."""
        t, n, _ = gates.shape
        h, wh = np.zeros((n, H), np.float32), self.p[f"h{k}"]
        out = np.empty((t, n, H), np.float32)
        for i in range(t) if k == "f" else range(t - 1, -1, -1):
            g, a = gates[i], h @ wh
            zr = _sigmoid(g[:, : 2 * H] + a[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            c = np.tanh(g[:, 2 * H :] + r * a[:, 2 * H :])
            new = h + live[i][:, None] * (1 - z) * (c - h)
            if keep is not None:
                keep.append((i, h, z, r, c, a[:, 2 * H :]))
            out[i] = h = new
        return out

    def pooled(self, s: np.ndarray, live: np.ndarray):
        a = np.tanh(s @ self.p["att"])
        e = a @ self.p["attv"]
        e = np.exp(e - e.max(0)) * live
        w = e / np.maximum(e.sum(0), 1e-9)
        v = (w[:, :, None] * s).sum(0)
        return a, w, v, v @ self.p["out"] + self.p["bias"][0]

    def logits(self, gates_f: np.ndarray, gates_b: np.ndarray, live: np.ndarray) -> np.ndarray:
        s = np.concatenate([self.states(gates_f, live, "f"), self.states(gates_b, live, "b")], 2)
        return self.pooled(s, live)[3]

    def gradients(self, x: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray):
        """Loss, gradients of the dense parameters, and of the inputs."""
        p, kept, s = self.p, {"f": [], "b": []}, []
        for k in "fb":
            s.append(self.states(x @ p[f"x{k}"] + p[f"c{k}"], live, k, kept[k]))
        s = np.concatenate(s, 2)
        a, w, v, z = self.pooled(s, live)
        q = _sigmoid(z)
        loss = -(weight * (y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7))).sum() / weight.sum()
        dz = (weight * (q - y) / weight.sum()).astype(np.float32)
        g = {"bias": np.array([dz.sum()], np.float32), "out": v.T @ dz}
        dv = dz[:, None] * p["out"]
        dw = (s * dv).sum(2)
        ds = w[:, :, None] * dv
        de = w * (dw - (w * dw).sum(0))
        g["attv"] = np.einsum("tnh,tn->h", a, de)
        da = de[:, :, None] * p["attv"] * (1 - a * a)
        g["att"] = np.einsum("tnd,tnh->dh", s, da)
        ds = ds + da @ p["att"].T
        dx = np.zeros_like(x)
        for k, part in (("f", slice(0, H)), ("b", slice(H, 2 * H))):
            wh, dh = p[f"h{k}"], np.zeros((x.shape[1], H), np.float32)
            gw, gh, gc = np.zeros_like(p[f"x{k}"]), np.zeros_like(wh), np.zeros_like(p[f"c{k}"])
            for i, h, zg, r, c, ac in reversed(kept[k]):
                dn = dh + ds[i][:, part]
                m = live[i][:, None]
                dc = dn * m * (1 - zg) * (1 - c * c)
                dzg = -dn * m * (c - h) * zg * (1 - zg)
                dr = dc * ac * r * (1 - r)
                gate = np.concatenate([dzg, dr, dc], 1)
                inner = np.concatenate([dzg, dr, dc * r], 1)
                dh = dn * (1 - m * (1 - zg)) + inner @ wh.T
                gw += x[i].T @ gate
                gh += h.T @ inner
                gc += gate.sum(0)
                dx[i] += gate @ p[f"x{k}"].T
            g |= {f"x{k}": gw, f"h{k}": gh, f"c{k}": gc}
        return loss, g, dx


def _shrunk(pos: np.ndarray, all_: np.ndarray, n_pos: int, n: int) -> np.ndarray:
    """How far a feature's share of toxic texts lies from the base rate, in standard deviations over 3, within 2; rare ones near 0."""
    rate = n_pos / max(1, n)
    e = all_ * rate
    return np.clip((pos - e) / np.sqrt(e * (1 - rate) + 2) / 3, -2, 2).astype(np.float32)


def train(rows: list[tuple[str | None, int]], epochs: int = 5, seed: int = 5, harmless: int | None = HARMLESS, spread: float | None = SPREAD, rescored: int | None = RESCORED) -> Network:
    """A network from (text, 0 or 1) rows. Without rows of both kinds it says the base rate for every text.

    With harmless, spread and rescored None, every epoch trains on every window and none is drawn."""
    net, r = Network(seed), np.random.default_rng(seed)
    y = np.array([int(t) for _, t in rows], np.float32)
    n_pos, n = int(y.sum()), len(y)
    net.p["bias"][0] = np.log((n_pos + 0.5) / (n - n_pos + 0.5))
    if not n_pos or n_pos == n:
        net.p["out"][:] = 0
        return net
    vocab: dict[bytes, int] = {}
    docs = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(t)], np.int32) for t, _ in rows]
    names = list(vocab)
    wrow = np.array([word_row(w) for w in names], np.int64) if names else np.zeros(0, np.int64)
    glist = [grams(w) for w in names]
    glen = np.array([len(g) for g in glist], np.int64)
    gflat = np.fromiter((x for g in glist for x in g), np.int32, int(glen.sum()))
    gstart = np.r_[0, np.cumsum(glen)]
    del glist

    def flat_of(ids: np.ndarray) -> np.ndarray:
        n = glen[ids]
        return gflat[np.repeat(gstart[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    pos_w, all_w, pos_g, all_g = np.zeros(WORD_ROWS), np.zeros(WORD_ROWS), np.zeros(GRAM_ROWS), np.zeros(GRAM_ROWS)
    for d, t in zip(docs, y, strict=True):
        u = np.unique(d)
        ws, gs = np.unique(wrow[u]), np.unique(flat_of(u))
        all_w[ws] += 1
        all_g[gs] += 1
        pos_w[ws] += t
        pos_g[gs] += t
    net.p["word"][:, 0] = _shrunk(pos_w, all_w, n_pos, n)
    net.p["gram"][:, 0] = _shrunk(pos_g, all_g, n_pos, n)

    def vectors(ids: np.ndarray) -> np.ndarray:
        return net.vectors(wrow[ids], flat_of(ids), glen[ids])

    # Windows of every training text; toxic texts outweigh others as if there were a third as many of them.
    owner = np.array([i for i, d in enumerate(docs) if len(d) for _ in starts(len(d))], np.int64)
    at = np.array([s for d in docs if len(d) for s in starts(len(d))], np.int64)
    if not len(owner):
        return net
    signal = net.p["word"][wrow, 0].clip(0)
    base = np.array([signal[docs[i][s : s + WINDOW]].sum() for i, s in zip(owner, at, strict=True)], np.float32)
    first = np.r_[True, owner[1:] != owner[:-1]]
    group = np.flatnonzero(first)
    score = base + 1e-3 * r.random(len(base))
    dense = [k for k in net.p if k not in ("word", "gram")]
    m, v2, step = {k: np.zeros_like(net.p[k]) for k in dense}, {k: np.zeros_like(net.p[k]) for k in dense}, 0
    acc = {k: np.full(len(net.p[k]), 1e-2, np.float32) for k in ("word", "gram")}

    whole = np.concatenate(docs)
    lengths = np.array([len(d) for d in docs], np.int64)
    offset = np.cumsum(lengths) - lengths
    t_axis = np.arange(WINDOW)[:, None]

    def pack(which: np.ndarray):
        n = np.minimum(WINDOW, lengths[owner[which]] - at[which])
        return whole[np.minimum(offset[owner[which]] + at[which] + t_axis, len(whole) - 1)].astype(np.int64), (t_axis < n).astype(np.float32)

    def scored(which: np.ndarray) -> np.ndarray:
        out = np.empty(len(which), np.float32)
        for k in range(0, len(which), 1024):
            ids, live = pack(which[k : k + 1024])
            u, inv = np.unique(ids, return_inverse=True)
            x = vectors(u)[inv.reshape(ids.shape)]
            out[k : k + 1024] = net.logits(x @ net.p["xf"] + net.p["cf"], x @ net.p["xb"] + net.p["cb"], live)
        return out

    for epoch in range(epochs):
        # For each text its highest window, and some of the others for texts that are not toxic.
        top = np.array([g + np.argmax(score[g:e]) for g, e in zip(group, np.r_[group[1:], len(owner)], strict=True)])
        clean, rest = top[y[owner[top]] == 0], np.setdiff1d(np.flatnonzero(y[owner] == 0), top)
        if harmless is not None:
            clean = r.permutation(clean)[:harmless]
        if spread is not None:
            rest = r.permutation(rest)[: max(1, int(spread * len(top)))]
        pool = np.concatenate([top[y[owner[top]] == 1], clean, rest])
        r.shuffle(pool)
        for b in range(0, len(pool), STEP):
            which = pool[b : b + STEP]
            ids, live = pack(which)
            u, inv = np.unique(ids, return_inverse=True)
            inv = inv.reshape(ids.shape)
            x = vectors(u)[inv] * (r.random((*ids.shape, 1)) > 0.1).astype(np.float32)
            yy = y[owner[which]]
            _, g, dx = net.gradients(x, live, yy, np.ones(len(which), np.float32))
            step += 1
            rate = 0.02 * min(1.0, step / 20) * (1 - epoch / (epochs + 1))
            for k in dense:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v2[k] = 0.99 * v2[k] + 0.01 * g[k] ** 2
                net.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-6)
            du = np.zeros((len(u), DW + DC), np.float32)
            np.add.at(du, inv.ravel(), (dx * live[:, :, None]).reshape(-1, DW + DC))
            for k, rows_, d in (("word", wrow[u], du[:, :DW]), ("gram", flat_of(u), np.repeat(du[:, DW:] / glen[u][:, None], glen[u], 0))):
                at_, back = np.unique(rows_, return_inverse=True)
                s = np.zeros((len(at_), d.shape[1]), np.float32)
                np.add.at(s, back, d)
                acc[k][at_] += (s * s).mean(1)
                net.p[k][at_] -= 0.02 * s / np.sqrt(acc[k][at_])[:, None]
        if epoch < epochs - 1:
            often = np.flatnonzero(y[owner] == 1)
            score[often] = scored(often)
            others = np.flatnonzero(y[owner] == 0)
            others = others if rescored is None else r.permutation(others)[:rescored]
            score[others] = scored(others)
    return net


class Scorer:
    """Scores texts; input gates of words that repeat are kept."""

    def __init__(self, net: Network):
        self.net = net
        self.w = np.concatenate([net.p["xf"], net.p["xb"]], 1)
        self.c = np.concatenate([net.p["cf"], net.p["cb"]])
        self.reset()

    def reset(self) -> None:
        self.index: dict[bytes, int] = {}
        self.gates, self.used = np.empty((1024, 6 * H), np.float32), 0

    def ids(self, words: list[bytes]) -> np.ndarray:
        new = [w for w in dict.fromkeys(words) if w not in self.index]
        if new:
            g = self.net.inputs(new) @ self.w + self.c
            while self.used + len(new) > len(self.gates):
                self.gates = np.concatenate([self.gates, np.empty_like(self.gates)])
            self.gates[self.used : self.used + len(new)] = g
            for w in new:
                self.index[w] = self.used
                self.used += 1
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def windows(self, seq: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.float32)
        for k in range(0, len(start), 1024):
            s, n = start[k : k + 1024], length[k : k + 1024]
            t = np.arange(WINDOW)[:, None]
            live = (t < n).astype(np.float32)
            g = self.gates[seq[np.minimum(s + t, len(seq) - 1)]]
            out[k : k + 1024] = self.net.logits(g[:, :, : 3 * H], g[:, :, 3 * H :], live)
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities; a text without words has that of no evidence."""
        out = np.full(len(texts), self.net.p["bias"][0], np.float32)
        i = 0
        while i < len(texts):
            seq, start, length, owner, total = [], [], [], [], 0
            while i < len(texts) and total < BATCH:
                words = words_of(texts[i])
                # A long text goes through in pieces that share windows' worth of words, so memory does not follow its length.
                for a in range(0, max(1, len(words) - WINDOW + STRIDE), 1000 * STRIDE):
                    part = words[a : a + 999 * STRIDE + WINDOW]
                    if not part:
                        continue
                    if self.used > KEPT:
                        if seq:
                            out = self._worst(out, seq, start, length, owner)
                            seq, start, length, owner, total = [], [], [], [], 0
                        self.reset()
                    seq.append(self.ids(part))
                    for s in starts(len(part)):
                        start.append(total + s)
                        length.append(min(WINDOW, len(part) - s))
                        owner.append(i)
                    total += len(part)
                    if total >= BATCH:
                        out = self._worst(out, seq, start, length, owner)
                        seq, start, length, owner, total = [], [], [], [], 0
                i += 1
            if seq:
                out = self._worst(out, seq, start, length, owner)
        return _sigmoid(out.astype(np.float64))

    def _worst(self, out, seq, start, length, owner):
        z = self.windows(np.concatenate(seq), np.array(start), np.array(length))
        owner = np.array(owner)
        best = np.full(len(out), -np.inf, np.float32)
        np.maximum.at(best, owner, z)
        touched = np.unique(owner)
        # The first piece of a text replaces the value for no evidence.
        fresh = ~self._seen(touched, len(out))
        out[touched] = np.where(fresh, best[touched], np.maximum(out[touched], best[touched]))
        return out

    def _seen(self, touched: np.ndarray, n: int) -> np.ndarray:
        if getattr(self, "_marks", None) is None or len(self._marks) != n:
            self._marks = np.zeros(n, bool)
        seen = self._marks[touched].copy()
        self._marks[touched] = True
        return seen

    def batch(self, texts: list[str | None]) -> np.ndarray:
        self._marks = None
        return self.scores(texts)


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = 5, harmless: int | None = HARMLESS, spread: float | None = SPREAD, rescored: int | None = RESCORED) -> dict[str, np.ndarray]:
    """Parameters from at most `sample` labelled rows by hash of doc_id, out of those whose crc32(doc_id) mod 5 is not 0.

    harmless, spread and rescored bound what an epoch takes of the sample's harmless windows, as HARMLESS, SPREAD and RESCORED say; None
    takes all. Rows that repeat a doc_id count once, with the greatest text. The sample is bounded, so one task trains; only the parameters come to the driver, in pieces of a megabyte."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").where(remainder(F.col("doc_id"), 5) != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ids = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).select("doc_id", "text", "toxic")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        got.sort(key=lambda x: (x[0], x[1] or ""))
        blob = pickle.dumps(train([(t, y) for _, t, y in got], epochs, harmless=harmless, spread=spread, rescored=rescored).p)
        for i in range(0, len(blob), 1 << 20):
            yield pa.RecordBatch.from_pydict({"i": pa.array([i], pa.int64()), "part": pa.array([blob[i : i + (1 << 20)]], pa.binary())})

    parts = rows.repartition(1).mapInArrow(fit, "i long, part binary").collect()
    return pickle.loads(b"".join(bytes(r["part"]) for r in sorted(parts, key=lambda r: r["i"]))) if parts else train([]).p


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = 5) -> DataFrame:
    """docs with held_out (false without a doc_id), score and predicted added (columns of those names are replaced); rows that repeat are each scored.

    Scores every overlapping window of every whole text; null, empty and blank texts get the probability of no evidence.
    labels needs doc_id and toxic; where a doc_id is labelled both ways it counts as toxic, labels outside 0 and 1 are void. Without
    labels of both kinds each text gets the base rate. An empty table gives no rows. No column but text enters a score."""
    spark = docs.sparkSession
    small_batches(spark)
    net_bc = spark.sparkContext.broadcast(trained(docs, labels, sample, epochs))
    docs = docs.drop("held_out", "score", "predicted")
    schema = docs.schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network.__new__(Network)
        net.p = net_bc.value
        scorer = Scorer(net)
        for b in batches:
            s = scorer.batch(b.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, "score"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "score double"])
    out = docs.mapInArrow(run, ddl)
    return out.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
