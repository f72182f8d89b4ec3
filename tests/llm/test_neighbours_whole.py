"""Queries that few rows meet, and vectors of very different length."""

import numpy as np
import pytest

from quern.llm import crosspolytope


def found(spark, x, k):
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for r in crosspolytope.neighbours(t, k).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    return got


@pytest.mark.parametrize("dim", [64, 300])
def test_few_candidates_are_all_found(spark, dim):
    x = np.random.default_rng(1).normal(size=(21, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = found(spark, x, 20)
    assert got == {q: set(range(21)) - {q} for q in (0, 20)}


def test_one_long_vector_leaves_the_others_findable(spark):
    x = np.random.default_rng(2).normal(size=(600, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] *= 10
    got = found(spark, x, 10)
    hits = []
    for q in range(0, 600, 20):
        s = x @ x[q]
        s[q] = -99
        hits.append(len(got.get(q, set()) & set(np.argsort(-s)[:10].tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_vectors_whose_squares_leave_the_range_of_doubles(spark):
    x = np.random.default_rng(3).normal(size=(60, 8))
    x[1] *= 1e200
    x[2] *= 1e-200
    got = found(spark, x, 20)
    for q in (0, 20, 40):
        with np.errstate(over="ignore"):
            s = x @ x[q]
        s[q] = -np.inf
        assert len(got[q]) == 20 and len(got[q] & set(np.argsort(-s, kind="stable")[:20].tolist())) >= 15
        assert (1 in got[q]) == (s[1] > 0)


@pytest.mark.parametrize("n", [200, 2000, 10_000])
def test_recall_on_evenly_spread_vectors(spark, n):
    x = np.random.default_rng(4).normal(size=(n, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for r in crosspolytope.neighbours(t).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = []
    y = x.astype(np.float64)
    for q in range(0, n, 20):
        s = y @ y[q]
        s[q] = -9
        best = np.argsort(-s)[:20]
        rows = sorted(got[q])
        assert [r for r, _, _ in rows] == list(range(1, 21)) and all(abs(s[v] - w) < 1e-12 for _, v, w in rows)
        hits.append(len({v for _, v, _ in rows} & set(best.tolist())) / 20)
    assert np.mean(hits) >= 0.9
    print(n, np.mean(hits))
