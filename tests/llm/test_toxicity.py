"""FTRL-proximal against a plain version with dictionaries, and the streamed fit against one in order."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import sampling, toxicity


def plain(rows, labels):
    """McMahan's per-coordinate update, one coordinate at a time; the bias has no L1."""
    z, n = {}, {}
    for x, y in zip(rows, labels):
        w = {}
        for i in [*x, "bias"]:
            zi, l1 = z.get(i, 0.0), 0.0 if i == "bias" else toxicity.L1
            w[i] = 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2)
        p = 1 / (1 + math.exp(-sum(w.values())))
        g = p - y
        for i in w:
            sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
            z[i] = z.get(i, 0.0) + g - sigma * w[i]
            n[i] = n.get(i, 0.0) + g * g
    out = {}
    for i, zi in z.items():
        l1 = 0.0 if i == "bias" else toxicity.L1
        out[i] = 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_updates_match_the_plain_ones(seed):
    rng = np.random.default_rng(seed)
    rows = [np.unique(rng.integers(0, 40, rng.integers(0, 12))) for _ in range(300)]
    labels = [int(len(set(x.tolist()) & {1, 2, 3}) > 0) for x in rows]
    state = toxicity.Ftrl()
    for x, y in zip(rows, labels):
        state.learn(x, y)
    m, want = state.model(), plain([x.tolist() for x in rows], labels)
    assert m.bias == pytest.approx(want.pop("bias"), abs=1e-9)
    assert dict(zip(m.index.tolist(), m.weight.tolist())) == pytest.approx({i: w for i, w in want.items() if w}, abs=1e-5)
    assert 0 < len(m.index) < 40  # L1 leaves the rest at zero


def table(spark, n=240):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["one", "two", "three", "four", "vile", "mean"][: 4 + 2 * (i % 3 == 0)], 30)), i % 3 == 0) for i in range(n)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], int(r[2])) for r in rows], "doc_id long, toxic int")
    return docs, labels


def test_fit_does_not_depend_on_the_partitions(spark):
    docs, labels = table(spark)
    one, two = (toxicity.train(d, labels, sampling.fold(3) != 1) for d in (docs, docs.repartition(13)))
    assert np.array_equal(one.index, two.index) and np.array_equal(one.weight, two.weight)
    assert (one.bias, one.a, one.b) == pytest.approx((two.bias, two.a, two.b))


def test_both_classes_of_the_held_out_fold_are_told_apart(spark):
    docs, labels = table(spark)
    got = toxicity.classify(docs, labels).join(labels, "doc_id").filter("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    by = {r.toxic: r.p for r in got}
    assert by[1] > 0.9 and by[0] < 0.1


def test_a_capped_class_keeps_its_true_share(spark):
    docs, labels = table(spark)
    full = toxicity.train(docs, labels, F.lit(True))
    few = toxicity.train(docs, labels, F.lit(True), max_clean=40)
    scores = [np.mean([r.score for r in toxicity.score(docs, m).collect()]) for m in (full, few)]
    assert abs(scores[0] - 1 / 3) < 0.05 and abs(scores[1] - 1 / 3) < 0.08
