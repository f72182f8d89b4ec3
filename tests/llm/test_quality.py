"""Quality: the risk against plain sums, the probability map on hard margins, kept shares for priors that are off."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import quality, sampling
from quern.session import table

SF = "/root/testdata"


def plain_risk(z, pos, prior):
    pos_z, un_z = [v for v, p in zip(z, pos) if p], [v for v, p in zip(z, pos) if not p]
    loss = lambda v, sign: np.log1p(np.exp(-sign * v))
    positive = prior * sum(loss(v, 1) for v in pos_z) / len(pos_z)
    negative = sum(loss(v, -1) for v in un_z) / len(un_z) - prior * sum(loss(v, -1) for v in pos_z) / len(pos_z)
    return positive, negative


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.9])
@pytest.mark.parametrize("shift", [0.0, 3.0])
def test_gradient_is_that_of_the_non_negative_risk(prior, shift):
    rng = np.random.default_rng(4)
    pos = rng.random(60) < 0.4
    z = rng.normal(size=60) + shift * np.where(pos, 1, -1)
    got = quality._risk(pos, prior)(z, np.arange(60))
    positive, negative = plain_risk(z, pos, prior)
    for k in range(60):
        up, down = z.copy(), z.copy()
        up[k] += 1e-5
        down[k] -= 1e-5
        a, b = plain_risk(up, pos, prior), plain_risk(down, pos, prior)
        # below zero the step goes against the negative part alone
        want = (a[0] + a[1] - b[0] - b[1]) if negative >= 0 else -(a[1] - b[1])
        assert got[k] == pytest.approx(want / 2e-5, abs=1e-7)


@pytest.mark.parametrize("case", ["skewed", "separated", "reversed", "constant", "tails"])
def test_probability_map_reaches_the_optimum(case):
    rng = np.random.default_rng(8)
    y = (rng.random(3000) < 0.86).astype(int)
    z = {
        "skewed": -np.exp(rng.normal(size=3000) * 2) + 3 * y,
        "separated": 50.0 * y - 900 + rng.random(3000),
        "reversed": rng.normal(size=3000) - 2 * y,
        "constant": np.full(3000, 7.0),
        "tails": rng.standard_cauchy(3000) * 30 + y,
    }[case]
    weight = np.where(y == 1, 4.0, 1.0)
    a, c = sampling.platt(z, y, weight)
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    q = 1 / (1 + np.exp(-np.clip(a * z + c, -60, 60)))
    assert a > 0
    assert abs((weight * (q - t)).sum()) < 1e-2  # the offset fits, also to a slope at its bound
    sd = max(z.std(), 1e-9)
    if a * sd > sampling.MIN_SLOPE * 1.01:
        assert abs((weight * (q - t) * (z - z.mean()) / sd).sum() + 1e-3 * a * sd) < 1e-2


def shares(spark, sf, prior=None):
    docs, labels = table(spark, f"{SF}/{sf}", "documents"), table(spark, f"{SF}/{sf}", "labels")
    model = quality.train(docs, labels, sampling.fold(5) != 0, prior=prior)
    s = quality.score(docs, model).join(labels.filter("quality IS NOT NULL"), "doc_id").withColumn("held", sampling.fold(5) == 0)
    got = s.groupBy("quality", "held").agg(F.avg((F.col("score") >= quality.THRESHOLD).cast("int")).alias("kept"), F.count("*").alias("n")).collect()
    return {(r.quality, r.held): (r.kept, r.n) for r in got}


@pytest.mark.parametrize("prior", [None, 0.807, 0.907])
def test_kept_shares_for_priors_off_the_truth(spark, prior):
    got = shares(spark, "sf0.1", prior)
    assert got[1, True][0] >= 0.98 and got[1, False][0] >= 0.98
    assert got[0, True][0] <= 0.05 and got[0, False][0] <= 0.05


def test_kept_shares_of_a_small_table(spark):
    got = shares(spark, "sf0.01")
    every = {q: sum(k * n for (v, _), (k, n) in got.items() if v == q) / sum(n for (v, _), (_, n) in got.items() if v == q) for q in (0, 1)}
    assert every[1] >= 0.98 and every[0] <= 0.3  # some 135 trusted positives and 45 bad labels are all there is to learn from


def test_scores_do_not_depend_on_the_partitions(spark):
    docs, labels = table(spark, f"{SF}/sf0.01", "documents"), table(spark, f"{SF}/sf0.01", "labels")
    seen = []
    old = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    try:
        for parts, adaptive in ((4, "true"), (37, "false")):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            model = quality.train(docs.repartition(parts), labels, sampling.fold(5) != 0)
            seen.append({r.doc_id: r.score for r in quality.score(docs, model).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])
    assert all(abs(seen[1][k] - v) < 1e-4 for k, v in seen[0].items())
