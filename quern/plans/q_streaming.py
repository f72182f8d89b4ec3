"""Streaming queries over the events table, drained to the end, and Python operators over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import chunker, convert, pii
from quern.operators import service
from quern.plans import adapters as A
from quern.plans.registry import register
from quern.session import shared_dir, ship, spread, table
from quern.streaming import jobs, statetable, timers


@register("r1_stream_fixed_windows", "SELECT token, window_start, hits, denied FROM (SELECT user_id AS token, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS hits, count(*) > 2 AS denied FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 HOUR <= (SELECT date_trunc('millisecond', max(ts)) FROM events)")
def r1(spark, sf_dir):
    out = jobs.drain(jobs.rate_windows(jobs.events_stream(spark, sf_dir), 2, "1 hour"), "rate")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_IN_ORDER = "e AS (SELECT user_id AS token, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)"


@register(
    "r2_stream_limiter",
    f"""WITH RECURSIVE {_IN_ORDER},
r AS (
  SELECT DISTINCT token, 0::BIGINT AS i, []::BIGINT[] AS taken, NULL::BIGINT AS t, 0::BIGINT AS wait FROM e
  UNION ALL
  SELECT token, i, CASE WHEN len(l) < 2 THEN list_append(l, t) ELSE l END, t, CASE WHEN len(l) < 2 THEN 0 ELSE l[1] + 7200000000 - t END
  FROM (SELECT e.*, list_filter(r.taken, lambda x: x > e.t - 7200000000) AS l FROM r JOIN e ON e.token = r.token AND e.i = r.i + 1) s)
SELECT token, round(t / 1e6, 6) AS at, wait = 0 AS admitted, round(wait / 1e6, 6) AS wait FROM r WHERE i > 0""",
)
def r2(spark, sf_dir):
    ship(spark)
    out = jobs.drain(jobs.sliding_limiter(jobs.events_stream(spark, sf_dir), 2, 7200.0), "limiter")
    return out.withColumns({c: F.round(c, 6) for c in ("at", "wait")})


@register(
    "r6_stream_coalescing",
    f"""WITH RECURSIVE {_IN_ORDER},
r AS (
  SELECT DISTINCT token, 0::BIGINT AS i, NULL::BIGINT AS last, NULL::BIGINT AS due, NULL::BIGINT AS fired, NULL::BIGINT AS started FROM e
  UNION ALL
  SELECT token, i, CASE WHEN now THEN t ELSE last1 END, CASE WHEN now THEN due1 ELSE coalesce(due1, last1 + 3600000000) END, CASE WHEN fire THEN due END, CASE WHEN now THEN t END
  FROM (SELECT *, coalesce(last1 + 3600000000 <= t, true) AS now FROM (
    SELECT e.*, due, coalesce(e.t >= due, false) AS fire, CASE WHEN e.t >= due THEN due ELSE last END AS last1, CASE WHEN e.t >= due THEN NULL ELSE due END AS due1 FROM r JOIN e ON e.token = r.token AND e.i = r.i + 1) a) b),
rest AS (SELECT token, arg_max(coalesce(due, -1), i) AS due FROM r GROUP BY token),
runs AS (SELECT token, fired AS t, 'deferred' AS kind FROM r WHERE fired IS NOT NULL UNION ALL SELECT token, started, 'now' FROM r WHERE started IS NOT NULL
  UNION ALL SELECT token, due, 'deferred' FROM rest WHERE due > 0 AND due // 1000 < (SELECT max(t) // 1000 FROM e))
SELECT token, round(t / 1e6, 6) AS at, kind FROM runs""",
)
def r6(spark, sf_dir):
    ship(spark)
    return jobs.drain(jobs.coalesced_runs(jobs.events_stream(spark, sf_dir), 3600.0), "coalesce").withColumn("at", F.round("at", 6))


@register("c1_chunk_documents", None)
def c1(spark, sf_dir):
    ship(spark)
    return chunker.chunk_table(spread(A.documents(spark, sf_dir).select("relative_path", "content")))


_PLANTED = """CASE doc_id % 7 WHEN 0 THEN concat(text, '\n\U0001F600 AKIA', lpad(CAST(doc_id AS STRING), 16, '0'), ' end') WHEN 1 THEN concat(text, '\nto DE89370400440532013000.') ELSE text END"""


@register(
    "c17_pii_findings",
    """WITH d AS (SELECT *, length(text) + len(regexp_extract_all(text, '[\\x{10000}-\\x{10FFFF}]')) AS units, 2 + length(text) - length(replace(text, chr(10), '')) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id::VARCHAR AS key, 'aws_access_key' AS rule, (units + 4)::INT AS start, 20 AS length, line::INT AS line, 3 AS col, 'AKIA…' || right(lpad(doc_id::VARCHAR, 16, '0'), 4) AS preview, 'AKIA' || lpad(doc_id::VARCHAR, 16, '0') AS normalized, 1 AS total, false AS capped FROM d WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id::VARCHAR, 'iban', (units + 4)::INT, 22, line::INT, 4, 'DE…3000', 'DE89370400440532013000', 1, false FROM d WHERE doc_id % 7 = 1""",
)
def c17(spark, sf_dir):
    """The documents hold no findings of their own: two of seven get one planted behind their text."""
    ship(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_PLANTED).alias("text"))
    return pii.scan_table(spread(d))


@register("c3_c11_convert_pages", None)
def c3(spark, sf_dir):
    ship(spark)
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id", F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content"))
    return convert.convert_table(spread(p))


@register("q3_read_documents", None)
def q3(spark, sf_dir):
    """Requests by exact path and by suffix, over all documents split into passages."""
    ship(spark)
    d = A.documents(spark, sf_dir)
    passages = chunker.chunk_table(d).withColumnRenamed("path", "relative_path")
    exact = d.filter("doc_id % 50 = 0").select(F.col("relative_path").alias("path"))
    ends = d.filter("doc_id % 50 = 0").select(F.concat("doc_id", F.lit(".md")).alias("path"))
    return service.read_documents(passages, exact.unionByName(ends).withColumn("heading", F.lit(None).cast("string")), 400)


@register(
    "q5_accepted_reports",
    """WITH RECURSIVE e AS (SELECT user_id AS who, 'question ' || event_id AS query, substring(event_type, 1, 4) AS note, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT DISTINCT who, 0::BIGINT AS i, NULL::TIMESTAMP AS last, NULL::VARCHAR AS query, NULL::VARCHAR AS note, NULL::TIMESTAMP AS ts, false AS ok FROM e
  UNION ALL
  SELECT e.who, e.i, CASE WHEN r.last > e.ts - INTERVAL 1 HOUR THEN r.last ELSE e.ts END, e.query, e.note, e.ts, NOT coalesce(r.last > e.ts - INTERVAL 1 HOUR, false) FROM r JOIN e ON e.who = r.who AND e.i = r.i + 1)
SELECT who AS reporter, query, note, ts AS created_at FROM r WHERE ok""",
)
def q5(spark, sf_dir):
    ship(spark)
    r = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.col("user_id").alias("reporter"), F.concat(F.lit("question "), "event_id").alias("query"), F.col("event_type").alias("note"), F.col("ts").alias("created_at"))
    return service.accepted_reports(r, 1, note_limit=4)


@register("e1_passage_embeddings", None)
def e1(spark, sf_dir):
    ship(spark)
    c = A.chunks(spark, sf_dir).select("doc_id", "chunk_index", "content")
    return service.embed(c, F.col("content"), service.bag_of_words(64), "passage: ").drop("content")


@register(
    "r10_compacted_state",
    """SELECT source, concat(source, '/', doc_id, '.md') AS relative_path, CASE WHEN doc_id % 6 = 5 THEN 'v2' ELSE md5(text) END AS content_hash FROM documents
WHERE source IS NOT NULL AND NOT (source = 'src2' AND doc_id % 2 = 1) AND doc_id % 6 <> 4""",
)
def r10(spark, sf_dir):
    """Documents arrive in four batches, a fifth changes every sixth, a sixth removes every sixth, a seventh lists half of one source
    completely; a snapshot is made every third batch."""
    path = f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").filter("source IS NOT NULL")
    rows = d.select("doc_id", "source", F.concat("source", F.lit("/"), "doc_id", F.lit(".md")).alias("relative_path"), F.md5("text").alias("content_hash"), F.lit(False).alias("deleted"))
    batches = [rows.filter(F.col("doc_id") % 4 == k) for k in range(4)]
    batches.append(rows.filter("doc_id % 6 = 5").withColumn("content_hash", F.lit("v2")))
    batches.append(rows.filter("doc_id % 6 = 4").withColumn("deleted", F.lit(True)))
    for n, b in enumerate(batches):
        statetable.apply_batch(b.drop("doc_id"), n, path, compact_every=3)
    left = rows.filter("source = 'src2' AND doc_id % 2 = 0 AND doc_id % 6 <> 4").withColumn("content_hash", F.expr("CASE WHEN doc_id % 6 = 5 THEN 'v2' ELSE content_hash END"))
    statetable.apply_batch(left.drop("doc_id"), len(batches), path, complete=True, compact_every=3)
    return statetable.current(spark, path)


@register(
    "k8_committed_log",
    f"""WITH {A.LOG}, {A.HITS} SELECT l.query_id, l.token, count(h.rank) AS hits, round(max(h.score), 9) AS best FROM log l LEFT JOIN hits h USING (query_id) GROUP BY ALL""",
)
def k8(spark, sf_dir):
    """Searches with their hits, appended as a stream and read back as two tables that were committed together."""
    base = f"{shared_dir(spark)}/searches-{uuid.uuid4().hex}"
    log = A.query_log(spark, sf_dir).select("query_id", "created_at", "token")
    hits = A.query_hits(spark, sf_dir).groupBy("query_id").agg(F.collect_list(F.struct("rank", "doc_id", "score")).alias("hits"))
    rows = log.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array()))
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")
    jobs.append_searches(stream, f"{base}/log", f"{base}/state").awaitTermination()
    headers, found = jobs.read_searches(spark, f"{base}/log", "query_id long, created_at timestamp_ntz, token long", "query_id long, rank int, doc_id long, score double")
    per = found.groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 9).alias("best"))
    return headers.join(per, "query_id", "left").select("query_id", "token", F.coalesce("hits", F.lit(0)).alias("hits"), "best")


@register(
    "r13_late_rows",
    """WITH e AS (SELECT event_id, ts, event_id % 4 AS part FROM events),
b AS (SELECT p.part, (SELECT max(ts) FROM e WHERE e.part < p.part) - INTERVAL 1 HOUR AS bound FROM (SELECT DISTINCT part FROM e) p)
SELECT event_id, coalesce(ts < bound, false) AS late FROM e JOIN b USING (part)""",
)
def r13(spark, sf_dir):
    """Events come in four parts, one after the other; what lies more than an hour behind the parts before is kept aside."""
    base = f"{shared_dir(spark)}/late-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for k in range(4):
        events.filter(F.col("event_id") % 4 == k).write.parquet(f"{base}/in/part={k}")
        stream = spark.readStream.schema("event_id long, ts timestamp, part int").parquet(f"{base}/in")
        jobs.split_late(stream, f"{base}/out", f"{base}/state", delay=3600.0).awaitTermination()
    read = lambda name, late: spark.read.schema("event_id long").option("recursiveFileLookup", "true").parquet(f"{base}/out/{name}").withColumn("late", F.lit(late))
    return read("on_time", False).unionByName(read("late", True))


@register("r7_scheduler_ticks", None)
def r7(spark, sf_dir):
    """Events as what happens to the sources of projects: decisions of the scheduler; tests compare it with a plain one."""
    ship(spark)
    kind = F.expr("CASE event_id % 5 WHEN 0 THEN 'register' WHEN 1 THEN 'synced' WHEN 2 THEN 'webhook' ELSE 'probe' END")
    e = jobs.events_stream(spark, sf_dir)
    rows = e.select(
        F.concat(F.lit("p"), F.expr("user_id % 20")).alias("project"), F.concat(F.lit("s"), F.expr("user_id % 3")).alias("source"), F.col("ts").alias("at"), kind.alias("kind"),
        F.lit(86_400.0).alias("interval"), F.lit(604_800.0).alias("max_age"), F.concat(F.lit("v"), F.expr("event_id % 2")).alias("token"),
    )
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, timers.STATE_STORE)
    try:
        return jobs.drain(timers.schedule(rows), "scheduler")
    finally:
        spark.conf.set(key, before)
