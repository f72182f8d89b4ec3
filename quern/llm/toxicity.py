"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs with one word between them (letters and
digits, lower-cased), present or absent. FTRL-proximal keeps a learning rate per coordinate and soft-thresholds
its weights, so that only a few thousand are not zero; those are broadcast as two arrays. The whole text counts:
a feature that has no weight costs one table look-up.

Labels are learned from a bounded sample of MAX_TOXIC and MAX_CLEAN rows of the training fold. A fit to four
fifths of it scores the other fifth, which fixes the map from margins to probabilities, in the proportion that the
classes have among all labels; the model is fitted to all. FTRL is an online method: each fit is one task that reads
the sample EPOCHS times as a stream in seeded order (Spark sorts it) and holds the state alone, 16 MB; only
weights that are not zero reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import sampling
from quern.llm import textkernel as tk
from quern.session import cut, spread

DIM_BITS = 20
MAX_TOXIC = 6000
MAX_CLEAN = 6000
THRESHOLD = 0.7
ALPHA, BETA, L1, L2 = 1.0, 1.0, 3.0, 0.05
EPOCHS = 3
_PAIR = np.uint64(0xD6E8FEB86659FD93)
_SKIP = np.uint64(0xA0761D6478BD642F)


def _indices(h: np.ndarray, wo: np.ndarray):
    """Hashed features and the word index where each starts."""
    shift = np.uint64(64 - DIM_BITS)
    out, at = [h >> shift], [np.arange(len(h))]
    row = np.repeat(np.arange(len(wo) - 1), np.diff(wo))
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            ok = np.flatnonzero(row[:-gap] == row[gap:])
            out.append(tk.mix(h[ok] * salt + h[ok + gap]) >> shift)
            at.append(ok)
    return np.concatenate(out).astype(np.int64), np.concatenate(at), row


def features(texts: pa.Array) -> list[np.ndarray]:
    """The distinct feature indices of each text."""
    out = []
    for _, _, data, off in tk.pieces(texts):
        low = tk.LOWER[data]
        s, e, wo = tk.spans(low, off, tk.ALNUM)
        f, at, row = _indices(tk.word_hashes(low, s, e), wo)
        owner = row[at] if len(at) else at
        code = np.unique(owner * (1 << DIM_BITS) + f)
        cut = np.searchsorted(code, np.arange(len(off)) * (1 << DIM_BITS))
        code &= (1 << DIM_BITS) - 1
        out += [code[a:b].astype(np.int32) for a, b in zip(cut[:-1], cut[1:])]
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    index: np.ndarray
    weight: np.ndarray
    bias: float
    a: float
    b: float

    def __post_init__(self):
        self.table = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"} | {"table": None}

    def margins(self, texts: pa.Array) -> np.ndarray:
        if self.table is None:
            self.table = np.zeros(1 << DIM_BITS, np.float32)
            self.table[self.index] = self.weight
        out = np.zeros(len(texts))
        for i, j, data, off in tk.pieces(texts):
            low = tk.LOWER[data]
            s, e, wo = tk.spans(low, off, tk.ALNUM)
            f, at, row = _indices(tk.word_hashes(low, s, e), wo)
            hit = np.flatnonzero(self.table[f])
            if len(hit):
                code = np.unique(row[at[hit]] * (1 << DIM_BITS) + f[hit])
                out[i:j] = np.bincount(code >> DIM_BITS, self.table[code & ((1 << DIM_BITS) - 1)], minlength=j - i)
        return out + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        return _sigmoid(self.a * self.margins(texts) + self.b)


class Ftrl:
    """FTRL-proximal state: two sums per coordinate; the bias is a coordinate without L1."""

    def __init__(self):
        self.z, self.n = np.zeros(1 << DIM_BITS), np.zeros(1 << DIM_BITS)
        self.zb = self.nb = 0.0

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def bias(self) -> float:
        return -self.zb / ((BETA + np.sqrt(self.nb)) / ALPHA + L2)

    def learn(self, x: np.ndarray, y: int) -> None:
        """One row: its distinct feature indices and its label."""
        w, n, bias = self.weights(x), self.n[x], self.bias()
        g = float(_sigmoid(w.sum() + bias)) - y
        self.z[x] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[x] = n + g * g
        self.zb += g - (np.sqrt(self.nb + g * g) - np.sqrt(self.nb)) / ALPHA * bias
        self.nb += g * g

    def model(self) -> Model:
        index = np.flatnonzero(np.abs(self.z) > L1)
        return Model(index.astype(np.int64), self.weights(index).astype(np.float32), float(self.bias()), 1.0, 0.0)


FULL, PART = 0, 1


def _fits(rows: DataFrame, epochs: int, seed: int) -> dict[int, Model]:
    """The models of all rows (doc_id, y, x, back) and of those that are not kept back."""
    passes = rows.select("doc_id", "y", "x", "back", F.explode(F.array(F.lit(FULL), F.lit(PART))).alias("fit")).filter(f"fit = {FULL} OR NOT back")
    passes = passes.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))
    order = F.xxhash64(F.lit(seed), "epoch", "doc_id", "y")
    stream = passes.repartition(2, "fit").sortWithinPartitions("fit", "epoch", order, "doc_id", "y").select("fit", "y", "x")

    def run(batches):
        state, now = Ftrl(), None

        def done():
            m = state.model()
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([m.index.tobytes()]), pa.array([m.weight.tobytes()]), pa.array([m.bias])], names=["fit", "at", "w", "bias"])

        for b in batches:
            for fit, y, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if fit != now:
                    if now is not None:
                        yield done()
                    state, now = Ftrl(), fit
                state.learn(np.frombuffer(x.as_buffer(), np.int32), y)
        if now is not None:
            yield done()

    got = stream.mapInArrow(run, "fit int, at binary, w binary, bias double").collect()
    return {r[0]: Model(np.frombuffer(r[1], np.int64), np.frombuffer(r[2], np.float32), r[3], 1.0, 0.0) for r in got}


def train(docs: DataFrame, labels: DataFrame, in_training: Column, max_toxic=MAX_TOXIC, max_clean=MAX_CLEAN, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit on bounded samples of labelled rows of the training fold. Texts are scanned once."""
    spark = docs.sparkSession
    picked, true = [], {}
    for value, most in ((1, max_toxic), (0, max_clean)):
        ids = sampling.labelled(docs, labels, "toxic", value, in_training)
        true[value] = ids.count()
        picked += [(r[0], value) for r in sampling.bounded(ids, most, seed=23).collect()]
    if not picked:
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0, 1.0, 0.0)
    texts = spread(cut(sampling.one_text(docs, spark.createDataFrame(picked, "doc_id long, y int")), "toxicity-sample"))

    def featured(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in features(b.column(2))], pa.binary())], names=["doc_id", "y", "x"])

    rows = texts.select("doc_id", "y", "text").mapInArrow(featured, "doc_id long, y int, x binary")
    rows = cut(rows.withColumn("back", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(5)) == 4), "toxicity-features")
    models = _fits(rows, epochs, seed)
    model, part = models[FULL], models.get(PART)
    if part is None:
        return model
    shared = spark.sparkContext.broadcast(part)

    def margins(batches):
        table = np.zeros(1 << DIM_BITS)
        table[shared.value.index] = shared.value.weight
        for b in batches:
            m = [table[np.frombuffer(x.as_buffer(), np.int32)].sum() + shared.value.bias for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(m, pa.float64())], names=["doc_id", "y", "m"])

    got = sorted(tuple(r) for r in rows.filter("back").select("doc_id", "y", "x").mapInArrow(margins, "doc_id long, y int, m double").collect())
    y, m = np.array([r[1] for r in got], int), np.array([r[2] for r in got])
    if len(got) and y.min() != y.max():
        weight = np.where(y == 1, true[1] / max(1, (y == 1).sum()), true[0] / max(1, (y == 0).sum()))
        model.a, model.b = sampling.platt(m, y, weight * len(y) / weight.sum())
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row. A text without words gets the score of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted. Learns only from rows outside the held-out fold. Without usable labels every
    score is one half; repeated rows get equal scores; an empty table gives no rows. Other columns are ignored."""
    model = train(docs, labels, sampling.fold(folds) != held)
    s = score(docs, model)
    return s.select("doc_id", (sampling.fold(folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
