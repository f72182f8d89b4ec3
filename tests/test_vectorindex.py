"""The inverted-file index against the exact scan, at two sizes, on clustered and on evenly spread vectors."""

import re

import numpy as np
import pytest

from quern.operators import vectorindex
from quern.operators.retrieval import dense


def vectors(spark, n, clustered, tenants=2, dim=16, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    if clustered:
        x = rng.normal(size=(max(4, n // 60), dim))[rng.integers(max(4, n // 60), size=n)] * 3 + x * 0.5
    rows = [(f"t{i % tenants}", i, v) for i, v in enumerate(x.tolist())]
    return spark.createDataFrame(rows, "tenant string, id long, embedding array<double>").repartition(4)


@pytest.mark.parametrize("n, clustered", [(600, True), (6000, True), (1500, False)])
def test_recall_and_files_read(spark, tmp_path, n, clustered):
    v = vectors(spark, n, clustered)
    index = vectorindex.build(v, str(tmp_path / "index"))
    assert index.vectors().count() == n
    asked = v.withColumnRenamed("id", "query_id")
    p = vectorindex.probes_for(index, asked.filter("query_id % 13 = 0"), 10)
    q = asked.filter("query_id % 17 = 0")
    got = {(r.query_id, r.id) for r in vectorindex.search(index, q, 10, p).collect()}
    want = set()
    for t in ("t0", "t1"):
        want |= {(r.query_id, r.id) for r in dense(v.filter(f"tenant = '{t}'"), q.filter(f"tenant = '{t}'"), 10, ("id",)).collect()}
    assert len(got & want) >= 0.9 * len(want)
    if clustered:
        cells = index.centroids.count()
        assert p <= max(3, cells // 6)
        one = asked.filter("query_id = 17")
        read, every = vectorindex.folders_read(index, one, p).first()
        assert read <= p < every
        plan = vectorindex.search(index, one, 10, p)._jdf.queryExecution().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*cell", plan)


def test_all_cells_give_the_exact_answer_within_the_tenant(spark, tmp_path):
    v = vectors(spark, 300, False, tenants=3)
    index = vectorindex.build(v, str(tmp_path / "index"))
    q = v.withColumnRenamed("id", "query_id").filter("query_id % 10 = 0")
    got = sorted((r.query_id, r["rank"], r.id) for r in vectorindex.search(index, q, 5, 1000, digits=9).collect())
    want = []
    for t in ("t0", "t1", "t2"):
        want += [(r.query_id, r.dense_rank, r.id) for r in dense(v.filter(f"tenant = '{t}'"), q.filter(f"tenant = '{t}'"), 5, ("id",), digits=9).collect()]
    assert got == sorted(want)


def test_odd_rows(spark, tmp_path):
    rows = [("a", 1, [1.0, 0.0]), ("a", 1, [1.0, 0.0]), ("a", 2, None), ("a", 3, [0.0, 0.0]), ("b", 4, [0.0, 2.0]), ("a", 5, [])]
    v = spark.createDataFrame(rows, "tenant string, id long, embedding array<double>")
    index = vectorindex.build(v, str(tmp_path / "index"))
    assert sorted(r.id for r in index.vectors().collect()) == [1, 1, 4]
    q = spark.createDataFrame([(9, "a", [1.0, 1.0]), (8, "c", [1.0, 1.0]), (7, "b", None)], "query_id long, tenant string, embedding array<double>")
    assert [(r.query_id, r.id, r["rank"]) for r in vectorindex.search(index, q, 3, 2).collect()] == [(9, 1, 1), (9, 1, 2)]
    none = vectorindex.build(v.filter("false"), str(tmp_path / "none"))
    assert none.centroids.count() == 0
