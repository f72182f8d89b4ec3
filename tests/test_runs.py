"""Golden sets, audit, timers, storage figures and synthetic vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import runs


def test_golden_set_is_replaced_as_a_whole_or_refused(spark):
    now = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y")], "project string, key string, question string")
    new = spark.createDataFrame([("2", "n"), ("3", "m")], "key string, question string")
    got = sorted(tuple(r) for r in runs.replace_golden(now, new, "a").collect())
    assert got == [("a", "2", "n"), ("a", "3", "m"), ("b", "1", "y")]
    assert [tuple(r) for r in runs.replace_golden(now, new.filter("false"), "a").collect()] == [("b", "1", "y")]
    with pytest.raises(Exception, match="repeated key"):
        runs.replace_golden(now, new.union(new), "a").collect()
    with pytest.raises(Exception, match="too many"):
        runs.replace_golden(now, new, "a", most=1).collect()


def test_audit_never_stops_the_action(spark, tmp_path):
    row = spark.createDataFrame([("login",)], "action string")
    assert runs.append_audit(row, str(tmp_path / "audit")) and runs.append_audit(row, str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 2
    (tmp_path / "file").write_text("not a folder")
    assert not runs.append_audit(row, str(tmp_path / "file" / "audit"))


def test_first_due_is_inside_the_interval_and_repeatable(spark):
    s = spark.createDataFrame([(f"s{i}", 100) for i in range(200)], "source string, seconds int")
    now = F.timestamp_seconds(F.lit(1000))
    got = [r[0] for r in runs.first_due(s, "seconds", now).select(F.unix_micros("first_due") / 1e6).collect()]
    assert all(1000 <= x < 1100 for x in got) and len({int(x) // 10 for x in got}) == 10
    assert got == [r[0] for r in runs.first_due(s, "seconds", now).select(F.unix_micros("first_due") / 1e6).collect()]


def test_batches_are_bounded_and_in_order(spark):
    seen = runs.drain_batches(spark.range(0, 47, 1, 2), "id", lambda f: f.head(1).assign(n=len(f)), "id long, n long", size=10).collect()
    assert sum(r.n for r in seen) == 47 and max(r.n for r in seen) == 10 and min(r.n for r in seen) >= 3


def test_directory_bytes_count_in_every_directory_above(spark, tmp_path):
    for name, n in (("a/x.md", 3), ("a/b/y.md", 5), ("z.md", 7), ("node_modules/w", 11), ("a/.git/v", 13)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"." * n)
    got = {r.dir: (r.bytes, r.files) for r in runs.directory_bytes(spark, str(tmp_path), ["node_modules", ".git"]).collect()}
    assert got == {"": (15, 3), "a": (8, 2), "a/b": (5, 1)}


def test_vectors_lie_at_the_exact_cosine(spark):
    a = np.ones(8) / np.sqrt(8)
    x = np.array([r.embedding for r in runs.synthetic_vectors(spark, 20, 8, 3, a.tolist(), 0.25).collect()])
    assert np.allclose(x @ a, 0.25) and np.allclose((x * x).sum(1), 1) and len(np.unique(x.round(6), axis=0)) == 20


def test_one_project_in_both_lanes_runs_once(spark):
    t = spark.createDataFrame([("p", "k", "scheduled", 1), ("p", "k", "interactive", 9), ("p", "l", "scheduled", 2)], "project string, key string, lane string, asked_at int")
    got = sorted(tuple(r) for r in runs.queue_order(t).collect())
    assert got == [("p", "k", "interactive", 1), ("p", "l", "scheduled", 2)]


def test_prompts(spark):
    assert spark.range(1).select(runs.prompt("explore", F.lit("x"))).first()[0].endswith("Topic: x")


def test_ranks_without_a_whole_sort(spark):
    from quern.operators import ranks

    rows = [(i, None if i % 9 == 0 else (i * 37 % 23) / 7 if i % 2 else 1e6) for i in range(200)]
    t = spark.createDataFrame(rows, "id long, v double")
    for down in (False, True):
        got = {r.id: r.r for r in ranks.rank(t, "v", "r", down).collect()}
        key = lambda v: (v is None, -(v or 0)) if down else (v is not None, v or 0)
        assert got == {i: 1 + sum(key(w) < key(v) for _, w in rows) for i, v in rows}
    assert ranks.rank(t.filter("false"), "v", "r").count() == 0
    same = ranks.rank(t.select("id", F.lit(2.0).alias("v")), "v", "r")
    assert {r.r for r in same.collect()} == {1}


def test_ranks_of_skewed_and_many_values(spark):
    from quern.operators import ranks

    rows = [(i, 5.0 if i % 2 else 1.0 + i * 1e-9, None if i % 11 == 0 else float(i % 5)) for i in range(400)]  # half share a value, the others lie close
    t = spark.createDataFrame(rows, "id long, a double, b double").repartition(4)
    want = {i: (1 + sum(x > a for _, x, _ in rows), 1 + sum((y is not None, y or 0) < (b is not None, b or 0) for _, _, y in rows)) for i, a, b in rows}
    for bounded in (ranks.BOUNDED, 250, 10):  # rows as they are, a short list of values, range partitions
        got = ranks.ranks(t, {"ra": ("a", True), "rb": ("b", False)}, bounded)
        assert {r.id: (r.ra, r.rb) for r in got.collect()} == want
    plan = ranks.ranks(t, {"ra": ("a", True), "rb": ("b", False)})._jdf.queryExecution().toString()
    assert "BroadcastNestedLoopJoin" not in plan


def test_quantiles_against_sorted_lists(spark):
    import math
    import random

    from quern.operators import ranks

    rng = random.Random(5)
    groups = {"one": [3.0], "ties": [1.0] * 50 + [2.0] * 7, "many": [rng.random() for _ in range(301)]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("ties", None), ("none", None)]
    t = spark.createDataFrame(rows, "g string, v double").repartition(4)
    ps = (0.0, 0.05, 0.5, 0.99, 1.0)
    wanted = {f"{rule}{int(p * 100)}": (p, rule) for p in ps for rule in ("linear", "nearest")}
    got = {r.g: r.asDict() for r in ranks.quantiles(t, "g", "v", wanted).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        s = sorted(vs)
        for p in ps:
            at = (len(s) - 1) * p
            lo, hi = s[math.floor(at)], s[math.ceil(at)]
            assert abs(got[g][f"linear{int(p * 100)}"] - (lo + (hi - lo) * (at - math.floor(at)))) < 1e-9
            assert got[g][f"nearest{int(p * 100)}"] == s[max(0, math.ceil(p * len(s)) - 1)]
    assert ranks.quantiles(t.filter("false"), "g", "v", wanted).count() == 0
