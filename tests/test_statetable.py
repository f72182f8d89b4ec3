"""Compacted state, the two-table log and late rows: replays, crashes, and what a batch reads."""

import random

import pytest
from pyspark.sql import functions as F

from quern.streaming import jobs, statetable
from quern.streaming.commits import Commits

SCHEMA = "source string, relative_path string, content_hash string, deleted boolean"


def state(spark, path):
    return sorted((r.source, r.relative_path, r.content_hash) for r in statetable.current(spark, path).collect())


def test_twenty_batches_against_a_plain_state(spark, tmp_path):
    rng, path, plain, journal = random.Random(1), str(tmp_path), {}, []
    for n in range(20):
        rows = [(rng.choice("st"), f"p{rng.randrange(12)}", str(rng.randrange(3)), rng.random() < 0.3) for _ in range(5)]
        batch = {}
        for s, p, h, d in rows:
            old = batch.get((s, p), ("", True))
            batch[s, p] = (max(old[0], h), old[1] and d)
        for key, (h, d) in batch.items():
            if d and key in plain:
                journal.append((n, *key, "removed"))
                del plain[key]
            elif not d and plain.get(key) != h:
                journal.append((n, *key, "modified" if key in plain else "added"))
                plain[key] = h
        statetable.apply_batch(spark.createDataFrame(rows, SCHEMA), n, path, compact_every=4)
        commits = Commits(spark, path)
        assert len(statetable.folders(commits, commits.before(n + 1))) <= 5
        if n == 11:
            statetable.vacuum(spark, path)
    assert state(spark, path) == sorted((*k, h) for k, h in plain.items())
    got = sorted((r.batch, r.source, r.relative_path, r.change) for r in spark.read.parquet(f"{path}/journal").collect())
    assert got == sorted(journal)


def test_a_replay_writes_the_same_again_or_nothing(spark, tmp_path):
    path = str(tmp_path)
    batches = [[("s", f"p{i}", str(n), False) for i in range(n, n + 3)] for n in range(6)]
    for n, rows in enumerate(batches):
        statetable.apply_batch(spark.createDataFrame(rows, SCHEMA), n, path, compact_every=3)
    want, commits = state(spark, path), Commits(spark, path)
    # the marker of the last batch is lost with its driver, its folders (and a snapshot) stay
    (tmp_path / "commits" / "-".join(["000000000005", str(commits.all()[-1][1])])).unlink()
    assert state(spark, path) != want
    statetable.apply_batch(spark.createDataFrame(batches[5], SCHEMA), 5, path, compact_every=3)
    assert state(spark, path) == want
    statetable.apply_batch(spark.createDataFrame([("s", "other", "x", False)], SCHEMA), 5, path, compact_every=3)
    assert state(spark, path) == want


def test_a_complete_listing_removes_what_it_lacks_in_its_own_sources(spark, tmp_path):
    path = str(tmp_path)
    statetable.apply_batch(spark.createDataFrame([("a", "x", "1", False), ("a", "y", "1", False), ("b", "x", "1", False)], SCHEMA), 0, path, complete=True)
    statetable.apply_batch(spark.createDataFrame([("a", "x", "2", False)], SCHEMA), 1, path, complete=True)
    assert state(spark, path) == [("a", "x", "2"), ("b", "x", "1")]
    got = sorted((r.batch, r.source, r.relative_path, r.change) for r in spark.read.parquet(f"{path}/journal").collect() if r.batch)
    assert got == [(1, "a", "x", "modified"), (1, "a", "y", "removed")]


def test_a_batch_reads_only_the_buckets_it_names(spark, tmp_path):
    path = str(tmp_path)
    statetable.apply_batch(spark.range(3000).select(F.lit("s").alias("source"), F.concat(F.lit("p"), "id").alias("relative_path"), F.lit("1").alias("content_hash")), 0, path)
    commits = Commits(spark, path)
    plan = statetable.state_at(commits, commits.before(1)).filter(F.col("pb").isin(3) & F.col("sb").isin(5))._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "pb" in plan.split("PartitionFilters: [")[1].split("]")[0]


def searches(spark, tmp_path, name, rows):
    df = spark.createDataFrame([(q, f"2024-01-01 00:00:{q:02d}", [(1, 0.5), (2, 0.25)][: q % 3]) for q in rows], "query_id long, created_at string, hits array<struct<rank:int,score:double>>")
    df.coalesce(1).write.parquet(str(tmp_path / "in" / name))
    return spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))


def test_headers_and_hits_are_seen_together_or_not_at_all(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    path, cp = str(tmp_path / "log"), str(tmp_path / "cp")
    jobs.append_searches(searches(spark, tmp_path, "1", range(5)), path, cp).awaitTermination()
    schemas = ("query_id long, created_at string", "query_id long, rank int, score double")
    seen = lambda: tuple(sorted(tuple(r) for r in t.collect()) for t in jobs.read_searches(spark, path, *schemas))
    first = seen()
    assert len(first[0]) == 5 and len(first[1]) == sum(q % 3 for q in range(5))
    stream, add = searches(spark, tmp_path, "2", range(5, 12)), Commits.add
    monkeypatch.setattr(Commits, "add", lambda self, *a: (_ for _ in ()).throw(RuntimeError("lost between the writes")))
    with pytest.raises(Exception, match="lost between"):
        jobs.append_searches(stream, path, cp).awaitTermination()
    assert seen() == first
    monkeypatch.setattr(Commits, "add", add)
    jobs.append_searches(searches(spark, tmp_path, "3", []), path, cp).awaitTermination()
    headers, hits = seen()
    assert [r[0] for r in headers] == list(range(12)) and len(hits) == sum(q % 3 for q in range(12))
    assert jobs.search_counts(spark, path) == (12, 0)


def test_a_full_buffer_counts_what_it_drops(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path = str(tmp_path / "log")
    jobs.append_searches(searches(spark, tmp_path, "1", range(9)), path, str(tmp_path / "cp"), capacity=4).awaitTermination()
    headers, _ = jobs.read_searches(spark, path, "query_id long, created_at string", "query_id long, rank int, score double")
    assert sorted(r.query_id for r in headers.collect()) == [0, 1, 2, 3] and jobs.search_counts(spark, path) == (4, 5)


def test_late_rows_are_kept_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    path, cp, every = str(tmp_path / "out"), str(tmp_path / "cp"), []
    for name, times in (("1", [100, 200, None]), ("2", [150, 185, 300]), ("3", [10, 289, 291])):
        every += times
        df = spark.createDataFrame([(t,) for t in times], "s long").select(F.timestamp_seconds("s").alias("ts"), "s")
        df.coalesce(1).write.parquet(str(tmp_path / "in" / name))
        stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        jobs.split_late(stream, path, cp, delay=10.0).awaitTermination()
    got = {k: sorted((r.s for r in spark.read.parquet(f"{path}/{k}").collect()), key=str) for k in ("on_time", "late")}
    assert got["late"] == sorted([None, 150, 185, 10, 289], key=str)
    assert sorted(got["late"] + got["on_time"], key=str) == sorted(every, key=str)
