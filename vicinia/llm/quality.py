"""Quality by ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text features is shared by all grades; ordered thresholds cut its line into grades:
p(grade <= k) = sigmoid(threshold[k] - w.x). It gives the expected grade and the chance of at least a grade, by which texts are selected.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinia.llm.common import remainder

#: Labelled rows that training may use at most, by hash of doc_id; the only bounded sample here.
SAMPLE = 8_000
ROWS = 1 << 17
GRADES = 3
#: Words whose features a worker keeps.
KEPT = 300_000
_CLASSES = ((re.compile(rb"[a-z\x80-\xff]+"), b"a"), (re.compile(rb"[A-Z]+"), b"A"), (re.compile(rb"[0-9]+"), b"0"))


class Features(dict):
    """Hashed rows of a word: itself in lower case, and its shape (runs of one kind of character as one)."""

    def __missing__(self, w: bytes) -> tuple[int, int]:
        if len(self) >= KEPT:
            self.clear()
        s = w
        for kind, mark in _CLASSES:
            s = kind.sub(mark, s)
        self[w] = x = (zlib.crc32(w.lower()) % ROWS, zlib.crc32(b"\x00" + s) % ROWS)
        return x


def rows_of(text: str | None, features: Features) -> np.ndarray:
    """Feature rows of a whole text: two a word, and one for the order of magnitude of its length."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    out = np.fromiter((r for w in words for r in features[w]), np.int64, 2 * len(words))
    return np.r_[out, zlib.crc32(b"\x01%d" % len(words).bit_length()) % ROWS]


#: Each text's features weigh SCALE together, however many words it has.
SCALE = 20.0


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * np.asarray(x, np.float64)) + 1)


class Ordinal:
    """w and ordered thresholds; thresholds[k] parts grades up to k from those above."""

    def __init__(self, w: np.ndarray, first: float, steps: np.ndarray):
        self.w, self.first, self.steps = w, first, steps

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.r_[0.0, np.cumsum(np.exp(self.steps))]

    def line(self, rows: list[np.ndarray]) -> np.ndarray:
        n = np.array([len(r) for r in rows])
        return SCALE * np.add.reduceat(self.w[np.concatenate(rows)].astype(np.float64), np.cumsum(n) - n) / n if len(rows) else np.zeros(0)

    def tails(self, line: np.ndarray) -> np.ndarray:
        """p(grade >= 1), p(grade >= 2), ... by column."""
        return _sigmoid(line[:, None] - self.thresholds[None, :])


def train(rows: list[np.ndarray], grades: np.ndarray, epochs: int = 6, seed: int = 3) -> Ordinal:
    """Stochastic gradient with a step for each weight. Grades that training lacks stay possible by their thresholds alone."""
    r = np.random.default_rng(seed)
    k = GRADES - 1
    share = (np.bincount(grades, minlength=GRADES) + 0.5) / (len(grades) + 0.5 * GRADES)
    upto = np.cumsum(share)[:k]
    cut = np.log(upto / (1 - upto))
    m = Ordinal(np.zeros(ROWS, np.float32), float(cut[0]), np.log(np.maximum(np.diff(cut), 0.05)))
    acc, acc_t = np.full(ROWS, 1e-4), np.full(k, 1.0)
    for _ in range(epochs if len(rows) else 0):
        order = r.permutation(len(rows))
        for b in range(0, len(order), 32):
            pick = order[b : b + 32]
            x = [rows[i] for i in pick]
            n = np.array([len(i) for i in x])
            s, y = m.line(x), grades[pick]
            th = m.thresholds
            edge = np.concatenate([np.full((len(s), 1), -np.inf), th[None, :] - s[:, None], np.full((len(s), 1), np.inf)], 1)
            cdf = _sigmoid(np.clip(edge, -60, 60))
            dens = cdf * (1 - cdf)
            at = np.arange(len(s))
            p = np.maximum(cdf[at, y + 1] - cdf[at, y], 1e-9)
            up, low = dens[at, y + 1] / p, dens[at, y] / p
            ds = (up - low) / len(s)  # of the loss -log p
            dth = np.zeros(k)
            for j in range(k):
                dth[j] = (-(up * (y == j)) + low * (y == j + 1)).sum() / len(s)
            flat = np.concatenate(x)
            at_, inv = np.unique(flat, return_inverse=True)
            g = np.bincount(inv, np.repeat(SCALE * ds / n, n), len(at_))
            acc[at_] += g * g
            m.w[at_] -= (0.3 * g / np.sqrt(acc[at_])).astype(np.float32)
            dfirst, dsteps = dth.sum(), np.array([dth[j + 1 :].sum() * np.exp(m.steps[j]) for j in range(k - 1)])
            gt = np.r_[dfirst, dsteps]
            acc_t += gt * gt
            move = 0.1 * gt / np.sqrt(acc_t)
            m.first -= move[0]
            m.steps = m.steps - move[1:]
    return m


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): 0 for low quality, 1 for good but toxic, 2 for good. Rows that contradict each other count as the lowest grade."""
    ok = labels.where("doc_id is not null and quality in (0, 1)")
    return ok.select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2).alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))


def quality(docs: DataFrame, grades: DataFrame, keep_from: int = 1, keep_above: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """docs with held_out (false without a doc_id), expected_grade, p_keep, predicted_grade and keep added; columns of those names are replaced.

    Learns from at most `sample` rows of grades (doc_id, grade 0..2) whose crc32(doc_id) mod 5 is not 0; keep says that the chance of
    grade keep_from or more is keep_above at least. Each row of docs is scored over its whole text, repeated rows alike; null,
    empty and blank texts by their length alone. Without grades each text gets even odds of all grades. No rows give none."""
    spark = docs.sparkSession
    ids = grades.where(remainder(F.col("doc_id"), 5) != 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    rows = rows.groupBy("doc_id", "grade").agg(F.max("text").alias("text")).select("doc_id", "text", "grade")  # rows that repeat a doc_id count once

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        got = [(i, g, rows_of(t, f)) for b in batches for i, t, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        got.sort(key=lambda x: (x[0], x[1], x[2].tobytes()))
        m = train([x for _, _, x in got], np.array([g for _, g, _ in got], np.int64))
        yield pa.RecordBatch.from_pydict({"w": pa.array([m.w.tobytes()], pa.binary()), "first": pa.array([m.first]), "steps": pa.array([[float(x) for x in m.steps]])})

    # The sample is bounded, so one task trains; the weights come to the driver.
    fitted = rows.repartition(1).mapInArrow(fit, "w binary, first double, steps array<double>").collect()
    m = Ordinal(np.frombuffer(fitted[0]["w"], np.float32), fitted[0]["first"], np.array(fitted[0]["steps"])) if fitted else train([], np.zeros(0, np.int64))
    model_bc = spark.sparkContext.broadcast((m.w, m.first, m.steps))
    docs = docs.drop("held_out", "expected_grade", "p_keep", "predicted_grade", "keep")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, features = Ordinal(*model_bc.value), Features()
        for b in batches:
            if not b.num_rows:
                continue
            line = np.array([model.line([rows_of(t.as_py(), features)])[0] for t in b.column(at)])
            tails = model.tails(line)
            pmf = -np.diff(np.concatenate([np.ones((len(line), 1)), tails, np.zeros((len(line), 1))], 1), axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tails.sum(1)), pa.array(tails[:, keep_from - 1]), pa.array(pmf.argmax(1).astype(np.int32))], [*b.schema.names, "expected_grade", "p_keep", "predicted_grade"])

    ddl = ", ".join([*(f"`{c.name}` {c.dataType.simpleString()}" for c in docs.schema), "expected_grade double", "p_keep double", "predicted_grade int"])
    out = docs.mapInArrow(run, ddl)
    return out.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))).withColumn("keep", F.col("p_keep") >= keep_above)
