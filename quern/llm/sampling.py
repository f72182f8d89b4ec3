"""Folds and bounded, reproducible samples of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(folds: int, key: str = "doc_id") -> Column:
    """crc32 of the key as text, modulo folds; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def bounded(rows: DataFrame, n: int, key: str = "doc_id", seed: int = 5) -> DataFrame:
    """At most n rows: those with the smallest seeded hash of the key. `rows` should be narrow (keys and labels)."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), key).limit(n)


def labelled(docs: DataFrame, labels: DataFrame, column: str, value: int, train: Column) -> DataFrame:
    """doc_id of the training rows of docs whose label column has the value (labels without a document don't count)."""
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").filter(train)
    marked = labels.filter(F.col(column) == value).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    return keys.join(marked, "doc_id", "left_semi").distinct()


def one_text(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """picked (few rows: doc_id and what it is picked for) with one text each, that of the smallest text hash where a doc_id
    repeats, so that a rerun or another partition layout reads the same text. One scan of docs; null texts count as empty."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = keyed.join(F.broadcast(picked), "doc_id").groupBy(picked.columns)
    return rows.agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))


MIN_SLOPE = 1e-3


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Platt's map sigmoid(a z + c), a > 0, with his smoothed targets, by Newton steps that are halved until the loss
    falls. `weight` brings a capped class back to its true count. Where the best slope is not above MIN_SLOPE (of
    standardised margins), the slope stays there and the offset is fitted to it."""
    weight = np.ones(len(z)) if weight is None else np.asarray(weight, float)
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    sd = max(z.std(), 1e-9)
    zz = (z - z.mean()) / sd

    def loss(a, c):
        s = a * zz + c
        return (weight * (np.logaddexp(0, s) - t * s)).sum() + 5e-4 * a * a

    a, c = 1.0, float(np.log((pos + 1) / (neg + 1)))
    now = loss(a, c)
    for _ in range(200):
        q = 1 / (1 + np.exp(-np.clip(a * zz + c, -40, 40)))
        r, h = weight * (q - t), weight * q * (1 - q) + 1e-9
        g = np.array([(r * zz).sum() + 1e-3 * a, r.sum()])
        hess = np.array([[(h * zz * zz).sum() + 1e-3, (h * zz).sum()], [(h * zz).sum(), h.sum()]])
        d = np.linalg.solve(hess, g)
        step = 1.0
        while step > 1e-10 and loss(a - step * d[0], c - step * d[1]) > now - 1e-4 * step * (g @ d):
            step /= 2
        if step <= 1e-10:
            break
        a, c = a - step * d[0], c - step * d[1]
        now = loss(a, c)
        if abs(d).max() < 1e-9:
            break
    if a < MIN_SLOPE:
        a, low, high = MIN_SLOPE, -60.0, 60.0
        for _ in range(100):
            c = (low + high) / 2
            q = 1 / (1 + np.exp(-np.clip(a * zz + c, -60, 60)))
            low, high = (c, high) if (weight * (q - t)).sum() < 0 else (low, c)
    return a / sd, c - a * z.mean() / sd
