"""The user-facing compositions and incremental operators on fixtures."""

from pyspark.sql import functions as F

from quern.operators import ingest, retrieval, service, web
from quern.streaming import jobs


def test_embed_and_search(spark):
    c = spark.createDataFrame([(1, "red apple pie"), (2, "blue sky"), (3, None)], "chunk_id long, text string")
    q = spark.createDataFrame([(9, "apple pie")], "query_id long, text string")
    provider = service.bag_of_words(64)
    hits = retrieval.dense(service.embed(c, F.col("text"), provider), service.embed(q, F.col("text"), provider), 5).orderBy("dense_rank").collect()
    assert [(r.query_id, r.chunk_id) for r in hits] == [(9, 1), (9, 2)] and hits[0].cosine > 0.8
    scored = service.external_scores(spark.createDataFrame([("a", "aa"), ("a", "b")], "question string, passage string"), lambda q, p: [float(y.count(x)) for x, y in zip(q, p)])
    assert sorted(r.external for r in scored.collect()) == [0.0, 2.0]


def test_dense_in_blocks_is_exact(spark, monkeypatch):
    rows = [(i, [float(i % 7), float(i % 5), 1.0]) for i in range(50)]
    c = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(3)
    q = c.filter("chunk_id < 10").withColumnRenamed("chunk_id", "query_id")
    one = sorted(map(tuple, retrieval.dense(c, q, 5, digits=9).collect()))
    monkeypatch.setattr(retrieval, "QUESTION_BLOCK", 3)
    assert sorted(map(tuple, retrieval.dense(c, q, 5, digits=9).collect())) == one and len(one) == 50


def test_topics_and_reading(spark):
    ch = spark.createDataFrame([("a/x.md", 0, "T", "one\ntwo"), ("a/x.md", 1, "T > S", "two\nthree"), ("b/x.md", 0, "T", "other"), ("b/y.md", 0, "T", "y" * 100)], "relative_path string, chunk_index int, heading_path string, content string")
    want = spark.createDataFrame([("a/x.md", None), ("x.md", None), ("y.md", None), ("a/x.md", "s")], "path string, heading string")
    got = {(r.path, r.heading): (r.content, r.next_index) for r in service.read_documents(ch, want, 10).collect()}
    assert got[("a/x.md", None)] == ("one\ntwo\nthree", None) and got[("a/x.md", "s")][0] == "two\nthree"
    assert ("x.md", None) not in got and got[("y.md", None)][0].startswith("yyy")
    d = spark.createDataFrame([(f"p{i}", "s") for i in range(5)], "relative_path string, source string")
    page = service.list_topics(d, "p0", 2).collect()
    assert [r.relative_path for r in page] == ["p1", "p2"] and page[0].has_more and page[0].documents == 5


def test_journal_rules(spark):
    rows = [(1, "a", "added", "2024-01-05"), (2, "a", "removed", "2024-01-06"), (3, "b", "added", "2024-01-05"), (4, "b", "modified", "2024-01-06"), (5, "c", "modified", "2024-01-07"), (6, "d", "removed", "2024-01-02")]
    c = spark.createDataFrame(rows, "seq long, relative_path string, change string, t string").withColumn("changed_at", F.to_timestamp("t")).drop("t")
    got = service.whats_new(c, F.to_timestamp(F.lit("2024-01-02")), F.to_timestamp(F.lit("2024-01-01")), 1).collect()
    assert [(r.relative_path, r.reads_as, r.truncated, r.complete) for r in got] == [("c", "modified", True, True)]
    every = ingest.classify(ingest.journal(c), F.to_timestamp(F.lit("2024-01-02"))).collect()
    assert {r.relative_path: r.reads_as for r in every} == {"b": "added", "c": "modified"}


def test_reports_are_limited(spark):
    rows = [(i, "r", f"q{i}", " " if i == 1 else " n", f"2024-01-01 00:{i * 15 % 60:02d}:0{i // 4}") for i in range(4)] + [(4, "r", "q4", None, "2024-01-01 01:00:00"), (5, "r", "q5", None, "2024-01-01 01:00:01")]
    r = spark.createDataFrame(rows, "report_id long, reporter string, query string, note string, created_at string").withColumn("created_at", F.to_timestamp("created_at"))
    # q3 (00:45) is refused and counts for nothing; q0 is an hour old at 01:00 and makes room for q4 alone
    assert {x["query"]: x.note for x in service.accepted_reports(r, 3).collect()} == {"q0": "n", "q1": None, "q2": "n", "q4": None}


def test_verdicts(spark):
    q = spark.createDataFrame([(1, "plain words"), (2, "my_function"), (3, "nothing")], "query_id long, text string")
    h = spark.createDataFrame([(1, 1, 0.5, 3), (2, 1, 0.5, 3), (2, 2, 0.4, None)], "query_id long, position int, cosine double, lexical_rank int")
    got = {r.query_id: r.outcome for r in retrieval.verdict(h, q, F.lit(0.8)).collect()}
    assert got == {1: "below_floor", 2: "results", 3: "no_match"}


def test_robots_and_resolution(spark):
    rules = spark.createDataFrame([("b", False, "/x"), ("b", True, "/x/ok"), ("b", False, "/*.pdf$")], "agent string, allow boolean, pattern string")
    urls = spark.createDataFrame([(f"http://h{p}", "b") for p in ("/x/no", "/x/ok/1", "/f.pdf", "/f.pdf?x", "")], "url string, agent string")
    got = {r.url: r.allowed for r in web.robots_allowed(urls, rules).collect()}
    assert got == {"http://h/x/no": False, "http://h/x/ok/1": True, "http://h/f.pdf": False, "http://h/f.pdf?x": True, "http://h": True}
    refs = spark.createDataFrame([("https://o/x",), ("/a#f",), ("b.html",), ("//c/d",), ("mailto:x",), ("",)], "r string")
    out = [r[0] for r in refs.select(web.resolve(F.lit("http://h/p/q.html?z#t"), F.col("r"))).collect()]
    assert out == ["https://o/x", "http://h/a", "http://h/p/b.html", "http://c/d", None, "http://h/p/q.html?z"]


def test_change_capture_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def feed(name, rows):
        spark.createDataFrame(rows, "relative_path string, content_hash string").coalesce(1).write.parquet(str(src / name))

    schema = "relative_path string, content_hash string"
    for name, rows in (("1", [("a", "1"), ("b", "1")]), ("2", [("a", "2"), ("b", "1"), ("c", "1")])):
        feed(name, rows)
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src))
        jobs.capture_changes(stream, out, str(tmp_path / "cp")).awaitTermination()
    got = sorted((r.batch, r.relative_path, r.change) for r in spark.read.parquet(f"{out}/journal").collect())
    assert got == [(0, "a", "added"), (0, "b", "added"), (1, "a", "modified"), (1, "c", "added")]
    # the last batch again, as after a lost driver: its commit is taken away, its folders stay
    (tmp_path / "cp" / "commits" / "1").unlink()
    for crc in (tmp_path / "cp" / "commits").glob(".1*"):
        crc.unlink()
    jobs.capture_changes(spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(src)), out, str(tmp_path / "cp")).awaitTermination()
    assert got == sorted((r.batch, r.relative_path, r.change) for r in spark.read.parquet(f"{out}/journal").collect())


def _fed(spark, path, rows):
    import datetime as dt

    at = lambda s: dt.datetime.fromtimestamp(s, dt.timezone.utc)
    spark.createDataFrame([(k, at(t)) for k, t in rows], "user_id long, ts timestamp").repartition(3).write.parquet(str(path))
    return spark.readStream.schema("user_id long, ts timestamp").parquet(str(path))


def test_limiter_matches_a_plain_one(spark, tmp_path):
    import random

    from quern.streaming import jobs

    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.randrange(400)) for _ in range(300)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a key comes in several parts
        got = sorted((r.token, r.at, r.admitted, round(r.wait, 6)) for r in jobs.drain(jobs.sliding_limiter(_fed(spark, tmp_path / "in", rows), 3, 20.0), "test").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want, hits = [], {}
    for k, t in sorted(rows):
        seen = [h for h in hits.get(k, []) if h > t - 20]
        wait = seen[0] + 20 - t if len(seen) >= 3 else 0
        hits[k] = seen if wait else [*seen, t]
        want.append((k, float(t), not wait, float(wait)))
    assert got == sorted(want)


def test_the_last_due_run_comes_without_another_trigger(spark, tmp_path):
    from quern.streaming import jobs

    # key 1 is deferred to 110 and hears nothing more; the clock of key 2 moves on
    rows = [(1, 100), (1, 103), (1, 104), (2, 100), (2, 500)]
    got = sorted((r.token, r.at, r.kind) for r in jobs.drain(jobs.coalesced_runs(_fed(spark, tmp_path / "in", rows), 10.0), "test").collect())
    assert got == [(1, 100.0, "now"), (1, 110.0, "deferred"), (2, 100.0, "now"), (2, 500.0, "now")]
