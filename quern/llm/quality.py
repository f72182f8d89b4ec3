"""Quality by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled good; the unlabelled set is a sample of all training documents, good and
bad. The class prior (share of good texts in the unlabelled set) is estimated first: a positive-against-unlabelled
classifier is fitted, and the prior is the smallest ratio of unlabelled to positive rows above a score on
rows not used in the fit, but not more than the share of good labels in the training fold. Then a linear scorer
minimises the non-negative unbiased risk
    prior * R_p(+1) + max(0, R_u(-1) - prior * R_p(-1))
by Adam; where the second term is negative, the step goes against it, so that the flexible scorer cannot
profit from calling positives unlabelled. A prior above the truth ruins that risk and one a little below it does
not, so a scorer is fitted for the estimate and for each of PRIOR_STEPS below it; labelled training rows that no
fit has seen choose among them by their log loss, and fix the monotone logistic map to the probability scale, in
the proportion that the classes have among all labels.

Inputs of a score are byte statistics of the whole text: shares of character kinds, word lengths, repetition of
words and lines, and hashed 4-grams of character kinds. The model (a few hundred numbers) is broadcast.
The samples are bounded by MAX_POSITIVE, MAX_UNLABELLED and MAX_CALIBRATION rows of each class; everything else covers
all rows. Samples are chosen by seeded hashes and sorted before the fit, so the model does not depend on partitions.
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

MAX_POSITIVE = 3000
MAX_UNLABELLED = 5000
MAX_CALIBRATION = 3000
PRIOR_STEPS = (0.0, 0.05, 0.1, 0.2)
HASHED_SCALE = 0.05  # against the dense statistics: many hashed shares must not outvote them in a small sample
KIND_BITS = 11
KINDS = 1 << KIND_BITS
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint32)
_KIND[0x41:0x5B] = 1
_KIND[0x30:0x3A] = 2
_KIND[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 3
_KIND[0x0A] = 4
_PUNCT = [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]
_KIND[_PUNCT] = np.arange(5, 5 + len(_PUNCT))
_KIND[:9] = 63
_ISPUNCT = np.zeros(256, bool)
_ISPUNCT[_PUNCT] = True
N_DENSE = 16


def _sums(x: np.ndarray, off: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(x, dtype=np.float64)))
    return c[off[1:]] - c[off[:-1]]


def _piece(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Dense statistics of each text, and the hashed kind 4-gram that starts at each byte."""
    n = np.maximum(off[1:] - off[:-1], 1).astype(np.float64)
    s, e, wo = tk.spans(data, off, tk.NOT_SPACE)
    h = tk.word_hashes(tk.LOWER[data], s, e)
    w = np.maximum(wo[1:] - wo[:-1], 1).astype(np.float64)
    kind = _KIND[data]
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    inner = wo[(wo > 0) & (wo < len(h))]
    same[inner] = False
    unique = np.array([len(np.unique(h[a:b])) for a, b in zip(wo[:-1], wo[1:])], np.float64)
    ends = data[e - 1] if len(e) else np.zeros(0, np.uint8)
    line_s, line_e, lo = tk.spans(data, off, _NOT_NEWLINE)
    lh = tk.word_hashes(data, line_s, line_e)
    lines = np.maximum(lo[1:] - lo[:-1], 1).astype(np.float64)
    distinct_lines = np.array([len(np.unique(lh[a:b])) for a, b in zip(lo[:-1], lo[1:])], np.float64)
    real = (wo[1:] - wo[:-1]).astype(np.float64)
    d = np.stack(
        [
            np.log1p(real), _sums(kind == 1, off) / n, _sums(kind == 2, off) / n, _sums(_ISPUNCT[data], off) / n, _sums(data >= 128, off) / n,
            _sums(e - s, wo) / w, np.sqrt(_sums((e - s).astype(np.float64) ** 2, wo) / w), unique / w, np.minimum(unique, 50) / np.minimum(w, 50),
            _sums(same, wo) / w, _sums(_ISPUNCT[ends], wo) / w, _sums((e - s) == 1, wo) / w, np.log1p(w / lines), distinct_lines / lines, _sums(kind == 4, off) / n * 50, (real == 0).astype(np.float64),
        ],
        axis=1,
    )
    if len(data) >= 4:
        g = (kind[:-3] << 18) | (kind[1:-2] << 12) | (kind[2:-1] << 6) | kind[3:]
        g = (g * np.uint32(0x9E3779B1)) >> np.uint32(32 - KIND_BITS)
    else:
        g = np.zeros(0, np.uint32)
    return d, g


_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[0x0A] = False


def features(texts: pa.Array) -> np.ndarray:
    """Rows of N_DENSE + KINDS float32, for fitting."""
    out = np.zeros((len(texts), N_DENSE + KINDS), np.float32)
    for i, j, data, off in tk.pieces(texts):
        d, g = _piece(data, off)
        out[i:j, :N_DENSE] = d
        for k in range(j - i):
            x = g[off[k] : max(off[k], off[k + 1] - 3)]
            if len(x):
                out[i + k, N_DENSE:] = np.sqrt(np.bincount(x, minlength=KINDS) / len(x))
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    a: float
    b: float
    prior: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) * self.scale).clip(-8, 8) @ self.weight + self.bias

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        step = 2048  # bounds the feature rows held at once
        for i in range(0, len(texts), step):
            out[i : i + step] = self.margins(features(texts[i : i + step]))
        return _sigmoid(self.a * out + self.b)


def _adam(x: np.ndarray, grad, epochs: int, rate: float, l2: float, index: np.ndarray, seed: int):
    """Minimise over the rows of x in index, by minibatches: grad(margins, rows of a batch) gives the gradient in the margins."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(x.shape[1], np.float64), 0.0
    m, v, t = np.zeros(len(w) + 1), np.zeros(len(w) + 1), 0
    for epoch in range(epochs):
        order = rng.permutation(index)
        step = rate * (1 - epoch / epochs) + rate * 0.05
        for i in range(0, len(order), 512):
            at = order[i : i + 512]
            part = x[at]
            gm = grad(part @ w.astype(np.float32) + b, at)
            g = np.append(gm.astype(np.float32) @ part + l2 * w, gm.sum())
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            d = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - d[:-1], b - d[-1]
    return w, b


def estimate_prior(x: np.ndarray, pos: np.ndarray, seed: int = 3) -> float:
    """The share of positives in the unlabelled rows of x, from the trusted positives (pos): fit one against the other on
    two thirds, then take the smallest ratio of tail shares on the rest, each share widened by its sampling error."""
    kept = np.random.default_rng(seed).random(len(x)) < 1 / 3
    k = np.where(pos, 0.5 / max(1, (pos & ~kept).sum()), 0.5 / max(1, (~pos & ~kept).sum()))
    index = np.flatnonzero(~kept)
    w, b = _adam(x, lambda z, at: (_sigmoid(z) - pos[at]) * k[at] * len(index) / len(at), 15, 0.01, 1e-3, index, seed)
    z = x @ w.astype(np.float32) + b
    sp, su = np.sort(z[kept & pos]), np.sort(z[kept & ~pos])
    if len(sp) < 5 or len(su) < 5:
        return 0.5
    best = 1.0
    for t in np.quantile(sp, np.linspace(0.02, 0.9, 45)):
        fp, fu = 1 - np.searchsorted(sp, t) / len(sp), 1 - np.searchsorted(su, t) / len(su)
        if fp > 0.1:
            best = min(best, (fu + np.sqrt(0.25 / len(su))) / fp)
    return float(np.clip(best, 0.05, 0.98))


def _risk(pos: np.ndarray, prior: float):
    """The gradient of the non-negative risk in the margins z of the rows `at`; pos marks the trusted positives."""

    def grad(z, at):
        i = pos[at]
        s, n_p, n_u = _sigmoid(z), max(1, i.sum()), max(1, (~i).sum())
        loss_neg = np.logaddexp(0, z)  # of calling a row positive
        rest = loss_neg[~i].sum() / n_u - prior * loss_neg[i].sum() / n_p
        g = np.zeros(len(z))
        sign = 1.0 if rest >= 0 else -1.0
        g[~i] += sign * s[~i] / n_u
        g[i] -= sign * prior * s[i] / n_p
        if rest >= 0:
            g[i] += prior * (s[i] - 1) / n_p
        return g

    return grad


def fit(x: np.ndarray, pos: np.ndarray, share: float = 1.0, prior: float | None = None, epochs: int = 40, seed: int = 3) -> list[Model]:
    """Uncalibrated models, one for each prior tried. x: features of trusted positives (pos) and of unlabelled rows,
    standardised in place; share: of good labels, an upper bound of the estimated prior; prior: instead of the estimate."""
    if not pos.any() or pos.all():
        return [Model(np.zeros(N_DENSE + KINDS, np.float32), np.zeros(N_DENSE + KINDS, np.float32), np.zeros(N_DENSE + KINDS), 0.0, 1.0, 0.0, 0.5)]
    mean, sd = x.mean(0), x.std(0)
    scale = np.where(sd > 1e-6, 1 / np.maximum(sd, 1e-6), 0).astype(np.float32)
    scale[N_DENSE:] *= HASHED_SCALE
    x -= mean
    x *= scale
    np.clip(x, -8, 8, out=x)
    if prior is None:
        prior = min(estimate_prior(x, pos, seed), share)
    models = []
    for down in PRIOR_STEPS:
        at = max(prior - down, 0.02)
        w, b = _adam(x, _risk(pos, at), epochs, 0.01, 1e-3, np.arange(len(x)), seed)
        models.append(Model(mean, scale, w, b, 1.0, 0.0, at))
    return models


def calibrate(models: list[Model], z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Model:
    """The model of the smallest log loss on labelled rows, with its probability map. z: a column of margins for each model."""
    if not len(y) or y.min() == y.max():
        return models[0]
    best = None
    for k, m in enumerate(models):
        m.a, m.b = sampling.platt(z[:, k], y, weight)
        s = m.a * z[:, k] + m.b
        loss = (weight * (np.logaddexp(0, s) - y * s)).sum()
        if best is None or loss < best[0]:
            best = loss, m
    return best[1]


def _sampled(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and roles of a bounded set of rows (doc_id, role, text), by role and doc_id. Hashed shares travel as half floats."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                x = features(part.column(2))
                packed = [d.tobytes() + h.tobytes() for d, h in zip(x[:, :N_DENSE], x[:, N_DENSE:].astype(np.float16))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed, pa.binary())], names=["doc_id", "role", "x"])

    got = rows.select("doc_id", "role", "text").mapInArrow(run, "doc_id long, role int, x binary").collect()
    got.sort(key=lambda r: (r[1], r[0]))
    out = np.zeros((len(got), N_DENSE + KINDS), np.float32)
    for i, r in enumerate(got):
        out[i, :N_DENSE] = np.frombuffer(r[2], np.float32, N_DENSE)
        out[i, N_DENSE:] = np.frombuffer(r[2], np.float16, KINDS, 4 * N_DENSE)
    return out, np.array([r[1] for r in got], np.int32)


def _margins(rows: DataFrame, models: list[Model]) -> np.ndarray:
    """doc_id, label and the margin under each model of a bounded set of labelled rows; their features stay on the executors."""
    shared, n = rows.sparkSession.sparkContext.broadcast(models), len(models)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 2048):
                part = b.slice(i, 2048)
                x = features(part.column(2))
                z = np.stack([m.margins(x) for m in shared.value], axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(z), pa.list_(pa.float64()))], names=["doc_id", "role", "z"])

    got = rows.select("doc_id", "role", "text").mapInArrow(run, "doc_id long, role int, z array<double>").collect()
    got.sort(key=lambda r: (r[0], r[1]))
    return np.array([[r[1], *r[2]] for r in got]).reshape(len(got), 1 + n)


TRUSTED, UNLABELLED, GOOD, BAD = 2, 3, 1, 0


def train(docs: DataFrame, labels: DataFrame, in_training: Column, max_positive=MAX_POSITIVE, max_unlabelled=MAX_UNLABELLED, max_calibration=MAX_CALIBRATION, prior: float | None = None) -> Model:
    """Fit on bounded samples of rows of the training fold; see the module's text. Texts are scanned once for all samples.
    A doc_id that repeats is one row of a sample, with one of its texts."""
    good = sampling.labelled(docs, labels, "quality", 1, in_training)
    bad = sampling.labelled(docs, labels, "quality", 0, in_training)
    n_good, n_bad = good.count(), bad.count()
    good_ids = [r[0] for r in sampling.bounded(good, max_positive + max_calibration).collect()]
    bad_ids = [r[0] for r in sampling.bounded(bad, max_calibration).collect()]
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").filter(in_training).distinct()
    back = min(len(good_ids) // 2, max_calibration)
    roles = [(i, GOOD) for i in good_ids[:back]] + [(i, BAD) for i in bad_ids]
    roles += [(i, TRUSTED) for i in good_ids[back:][:max_positive]]
    roles += [(r[0], UNLABELLED) for r in sampling.bounded(every, max_unlabelled, seed=11).collect()]
    picked = docs.sparkSession.createDataFrame(roles, "doc_id long, role int")
    rows = spread(cut(sampling.one_text(docs, picked), "quality-sample"))
    share = n_good / (n_good + n_bad) if n_bad else 1.0
    x, role = _sampled(rows.filter(F.col("role") > GOOD))
    models = fit(x, role == TRUSTED, share, prior)
    del x
    got = _margins(rows.filter(F.col("role") <= GOOD), models)
    y = got[:, 0]
    weight = np.where(y == 1, n_good / max(1, (y == 1).sum()), n_bad / max(1, (y == 0).sum()))
    return calibrate(models, got[:, 1:], y, weight * len(y) / max(1.0, weight.sum()))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) of every row. Null texts are scored as empty ones."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.scores(b.column(1)), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted. Learns only from rows outside the held-out fold. Without usable labels every
    score is the same; repeated rows get equal scores; an empty table gives no rows. Other columns are ignored."""
    model = train(docs, labels, sampling.fold(folds) != held)
    s = score(docs, model)
    return s.select("doc_id", (sampling.fold(folds) == held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score is threshold or more. Null texts are scored as empty ones."""
    shared, where = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for b in batches:
            keep = shared.value.scores(b.column(where)) >= threshold
            yield b if keep.all() else b.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
