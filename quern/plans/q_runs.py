"""Queries of golden sets, run records, timers and synthetic fixtures, beside the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import runs as R
from quern.plans import adapters as A
from quern.plans.registry import register
from quern.session import ship, table


@register("k12_replace_golden", "SELECT CASE WHEN quality = 1 THEN 'a' ELSE 'b' END AS project, 'g-' || doc_id AS key, 'old ' || toxic AS question FROM labels WHERE quality <> 1 UNION ALL SELECT 'a', n_name, 'new ' || n_regionkey FROM nation")
def k12(spark, sf_dir):
    old = table(spark, sf_dir, "labels").select(F.when(F.col("quality") == 1, "a").otherwise("b").alias("project"), F.concat(F.lit("g-"), "doc_id").alias("key"), F.concat(F.lit("old "), "toxic").alias("question"))
    new = table(spark, sf_dir, "nation").select(F.col("n_name").alias("key"), F.concat(F.lit("new "), "n_regionkey").alias("question"))
    return R.replace_golden(old, new, "a")


@register("k12_golden_lines", """SELECT 'p' AS project, '{"key":"' || n_name || '","question":"q' || n_regionkey || '"}' AS line FROM nation""")
def k12_lines(spark, sf_dir):
    return R.golden_lines(table(spark, sf_dir, "nation").select(F.lit("p").alias("project"), F.col("n_name").alias("key"), F.concat(F.lit("q"), "n_regionkey").alias("question")))


@register("k10_record_index_run", "SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM (SELECT user_id, max(event_id) AS event_id, ts FROM events GROUP BY user_id, ts)) WHERE n <= 20")
def k10(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "ts").agg(F.max("event_id").alias("event_id")).select("user_id", "event_id", "ts")
    return R.record_run(e.filter("event_id % 7 <> 0"), e.filter("event_id % 7 = 0"), ["user_id"], "ts", 20)


@register("r9_queue_order", """WITH b AS (SELECT user_id AS project, event_id % 5 AS key, min(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) AS l, min(ts) AS asked_at FROM events GROUP BY 1, 2)
SELECT project, key, CASE WHEN l = 0 THEN 'interactive' ELSE 'scheduled' END AS lane, row_number() OVER (PARTITION BY project ORDER BY l, asked_at, key) AS position FROM b""")
def r9(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("project"), F.expr("event_id % 5").alias("key"), F.when(F.col("event_type") == "purchase", "interactive").otherwise("scheduled").alias("lane"), F.col("ts").alias("asked_at"))
    return R.queue_order(t)


@register("r12_keyed_drain", "SELECT doc_id, length(text) AS n FROM documents")
def r12(spark, sf_dir):
    ship(spark)
    return R.drain_batches(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", lambda f: f.assign(n=f["text"].str.len())[["doc_id", "n"]], "doc_id long, n long")


@register("q10_evaluation_history", "SELECT lang AS run_id, count(*) AS questions, round(avg(CASE WHEN doc_id % 9 < 5 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS recall_at_5, round(avg(CASE WHEN doc_id % 9 = 8 THEN 0 ELSE 1.0::DOUBLE / (doc_id % 9 + 1) END), 9) AS mrr FROM documents GROUP BY lang")
def q10(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    r = d.select(F.col("lang").alias("run_id"), F.expr("CASE WHEN doc_id % 9 <> 8 THEN doc_id % 9 END").alias("rank"))
    h = R.evaluation_history(d.select(F.col("lang").alias("run_id")).distinct(), r)
    return h.select("run_id", "questions", F.round("recall_at_5", 9).alias("recall_at_5"), F.round("mrr", 9).alias("mrr"))


@register("q6_query_summary", f"WITH {A.LOG} SELECT model, generation, floor, count(*) AS searches, count(DISTINCT query_norm) AS questions, count(*) FILTER (hit_count = 0) AS empty, count(*) FILTER (floor > 0 AND top_score < floor) AS refused, round(avg(top_score), 9) AS avg_score, max(created_at) AS last_at FROM log GROUP BY ALL ORDER BY searches DESC, last_at DESC LIMIT 1")
def q6(spark, sf_dir):
    return R.query_summary(A.query_log(spark, sf_dir)).withColumn("avg_score", F.round("avg_score", 9))


@register("q7_apply_floor", """WITH p AS (SELECT s_suppkey AS project, s_suppkey % 3 AS model, s_suppkey % 2 AS generation, 0.5::DOUBLE AS floor FROM supplier)
SELECT project, model, generation, CASE WHEN project % 2 = 0 AND model = 1 AND generation = 0 THEN 0.75 ELSE floor END AS floor,
 CASE WHEN project % 2 = 0 AND model <> 1 THEN 'model moved' WHEN project % 2 = 0 AND generation <> 0 THEN 'generation moved' END AS fault FROM p""")
def q7(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("project"), F.expr("s_suppkey % 3").alias("model"), F.expr("s_suppkey % 2").alias("generation"), F.lit(0.5).cast("double").alias("floor"))
    return R.apply_floor(p, p.filter("project % 2 = 0").select("project", F.lit(1).alias("model"), F.lit(0).alias("generation"), F.lit(0.75).cast("double").alias("floor")))


@register("q8_findings_page", "SELECT event_type AS rule, lpad(user_id::VARCHAR, 8, '0') AS key, event_id AS start FROM events WHERE event_type = 'error' AND lpad(user_id::VARCHAR, 8, '0') > '00000002' ORDER BY key, start LIMIT 40")
def q8(spark, sf_dir):
    f = table(spark, sf_dir, "events").select(F.col("event_type").alias("rule"), F.lpad(F.col("user_id").cast("string"), 8, "0").alias("key"), F.col("event_id").alias("start"))
    return R.findings_page(f, "error", ("00000002", 1 << 40), 40)


@register("q16_prompts", "SELECT item_id, 'Answer the question from the documentation. Search first, read what you cite, and say so if nothing fits.' || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM benchmark")
def q16(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", R.prompt("answer", "text").alias("prompt"))


@register("d7_first_due", "SELECT source, 3600 AS seconds, make_timestamp(trunc(epoch_us(TIMESTAMP '2024-01-01') + CAST('0x' || substr(md5('7:' || source), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * 3600 * 1000000)::BIGINT) AS first_due FROM (SELECT 's' || s_suppkey AS source FROM supplier)")
def d7(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("source"), F.lit(3600).alias("seconds"))
    return R.first_due(s, "seconds", F.to_timestamp(F.lit("2024-01-01 00:00:00"))).withColumn("first_due", F.col("first_due").cast("timestamp_ntz"))


@register("z16_synthetic_vectors", None)
def z16(spark, sf_dir):
    ship(spark)
    return R.synthetic_vectors(spark, 500, 16)
