"""Search requests with filters: outcomes in order, and filters before candidates are cut."""

import numpy as np
from pyspark.sql import functions as F

from quern.operators import retrieval, scoped


def test_each_request_has_the_first_outcome_that_holds(spark):
    docs = spark.createDataFrame([("a", "s", ""), ("a", "t", "v1"), ("old", "s", "")], "project string, source string, version string")
    projects = spark.createDataFrame([("a", "m"), ("old", "n"), ("bare", "m"), ("none", None)], "project string, model string")
    cases = [
        ("gone", None, None, None, "project_gone", None), (None, None, None, None, "project_gone", None), ("bare", "x", None, None, "not_indexed", None), ("old", "x", None, None, "model_mismatch", None),
        ("a", "x", "v9", "../u", "unknown_source", ["s", "t"]), ("a", "s", "v9", "../u", "unknown_version", ["", "v1"]), ("a", "s", "v1", "../u", "invalid_path_prefix", None), ("a", None, None, "a//b", "invalid_path_prefix", None),
        ("a", "s", "", "./x/y/", "ok", None), ("a", None, None, None, "ok", None),
    ]
    rows = [(i, *c[:4]) for i, c in enumerate(cases)]
    requests = spark.createDataFrame(rows, "query_id long, project string, source string, version string, path_prefix string")
    got = {r.query_id: r for r in scoped.outcomes(requests, projects, docs, "m").collect()}
    assert [(got[i].status, got[i].available) for i in range(len(cases))] == [c[4:] for c in cases]
    assert got[8].relative_path == "x/y"
    assert scoped.outcomes(requests, projects, docs.filter("false"), "m").filter("status = 'not_indexed'").count() == 8


def test_a_narrow_filter_still_finds_as_many_as_there_are(spark):
    rng = np.random.default_rng(3)
    rows = [(i, f"s{i % 3}", f"s{i % 3}/{i % 50}/f{i}", rng.normal(size=4).tolist()) for i in range(600)]
    chunks = spark.createDataFrame(rows, "id long, source string, relative_path string, embedding array<double>").repartition(5)
    asked = [(0, None, None), (1, "s1", None), (2, None, "s2/5"), (3, "s0", "s0/3"), (4, "s0", "s1"), (5, None, "s2/5/f5"), (6, None, "s2/")]
    questions = spark.createDataFrame([(*a, rng.normal(size=4).tolist()) for a in asked], "query_id long, source string, relative_path string, embedding array<double>")
    vectors = {r.query_id: np.array(r.embedding) for r in questions.collect()}
    got = {}
    for r in retrieval.dense(chunks, questions, 5, ("id",), match={"source": "equal", "relative_path": "prefix"}).orderBy("dense_rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    for q, source, prefix in asked:
        own = [(i, np.array(v)) for i, s, p, v in rows if source in (None, s) and (prefix is None or p == prefix or p.startswith(prefix + "/"))]
        unit = lambda v: v / np.linalg.norm(v)
        assert got.get(q, []) == [i for i, _ in sorted(own, key=lambda x: (-(unit(x[1]) @ unit(vectors[q])), x[0]))][:5]
    assert len(got[2]) >= 4 and 4 not in got
