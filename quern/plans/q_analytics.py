"""Query-log analytics over events read as logged searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import analytics as Q
from quern.plans import adapters as A
from quern.plans.registry import register
from quern.plans.sqlbook import sql
from quern.session import table

_REFUSED = "floor > 0 AND top_score < floor"
_REPEATED = f"""rq AS (SELECT query_norm, count(*) AS asked, count(DISTINCT token) AS tokens, count(DISTINCT created_at::DATE) AS days, count(*) FILTER (hit_count = 0) AS empty,
 max(top_score) AS best_score, bool_or(coalesce({_REFUSED}, false)) AS refused, min(created_at) AS first_at, max(created_at) AS last_at,
 arg_max(query_text, (created_at, query_id)) AS spelling FROM log WHERE actor = 'mcp' GROUP BY query_norm)"""


def _mcp(spark, sf_dir):
    return Q.in_scope(A.query_log(spark, sf_dir), actor="mcp")


@register("a4_repeated_questions", f"WITH {A.LOG}, {_REPEATED} SELECT * FROM rq")
def a4(spark, sf_dir):
    return Q.repeated_questions(_mcp(spark, sf_dir))


@register(
    "n4_t9_gap_order",
    f"""WITH {A.LOG}, {_REPEATED}, r AS (SELECT query_norm, asked, best_score, rank() OVER (ORDER BY asked DESC) AS asked_rank, rank() OVER (ORDER BY best_score ASC NULLS FIRST) AS score_rank FROM rq)
SELECT query_norm, asked_rank, score_rank, round(1.0::DOUBLE / (60 + asked_rank) + 1.0::DOUBLE / (60 + score_rank), 9) AS gap FROM r ORDER BY 4 DESC, asked DESC, query_norm LIMIT 20""",
)
def n4(spark, sf_dir):
    g = Q.gap_order(Q.repeated_questions(_mcp(spark, sf_dir)))
    g = g.withColumn("gap", F.round("gap", 9))
    return g.orderBy(F.desc("gap"), F.desc("asked"), "query_norm").limit(20).select("query_norm", "asked_rank", "score_rank", "gap")


@register(
    "n6_j13_top_documents",
    f"""WITH {A.LOG}, {A.HITS}, g AS (SELECT query_norm, doc_id, count(*) AS times, max(score) AS best FROM hits JOIN log USING (query_id) WHERE actor = 'mcp' GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_norm ORDER BY times DESC, best DESC, doc_id) AS place FROM g) WHERE place <= 3""",
)
def n6(spark, sf_dir):
    return Q.top_hits(_mcp(spark, sf_dir), A.query_hits(spark, sf_dir))


@register("a6_most_returned_chunks", f"WITH {A.LOG}, {A.HITS} SELECT doc_id, chunk_index, count(*) AS times, min(rank) AS best_rank, round(avg(score), 6) AS avg_score FROM hits GROUP BY doc_id, chunk_index")
def a6(spark, sf_dir):
    return A.query_hits(spark, sf_dir).groupBy("doc_id", "chunk_index").agg(F.count("*").alias("times"), F.min("rank").alias("best_rank"), F.round(F.avg("score"), 6).alias("avg_score"))


@register(
    "a7_j12_volume_per_day",
    f"""WITH {A.LOG}, c AS (SELECT unnest(generate_series(DATE '2023-12-28', DATE '2024-02-03', INTERVAL 1 DAY))::DATE AS day),
p AS (SELECT created_at::DATE AS day, count(*) AS n, count(*) FILTER (hit_count = 0) AS e, count(*) FILTER ({_REFUSED}) AS r, avg(top_score) AS a FROM log GROUP BY 1)
SELECT day::VARCHAR AS day, coalesce(n, 0) AS searches, coalesce(e, 0) AS empty, coalesce(r, 0) AS refused, round(a, 6) AS avg_score FROM c LEFT JOIN p USING (day)""",
)
def a7(spark, sf_dir):
    return Q.volume(A.query_log(spark, sf_dir), "2023-12-28", "2024-02-03").withColumn("avg_score", F.round("avg_score", 6))


@register(
    "j10_never_returned",
    f"""WITH {A.DOCUMENTS}, {A.LOG}, {A.HITS} SELECT doc_id, relative_path FROM docs d WHERE NOT EXISTS (SELECT 1 FROM hits h JOIN log l USING (query_id) WHERE h.doc_id = d.doc_id AND l.created_at >= d.indexed_at)""",
)
def j10(spark, sf_dir):
    d = A.documents(spark, sf_dir).select("doc_id", "relative_path", "indexed_at")
    return Q.never_returned(d, A.query_log(spark, sf_dir), A.query_hits(spark, sf_dir)).drop("indexed_at")


@register("j11_searches_since_indexing", f"WITH {A.DOCUMENTS}, {A.LOG}, s AS (SELECT i, (SELECT count(*) FROM log WHERE created_at >= i) AS searches FROM (SELECT DISTINCT indexed_at AS i FROM docs)) SELECT doc_id, searches FROM docs JOIN s ON i = indexed_at")
def j11(spark, sf_dir):
    return Q.searches_since(A.documents(spark, sf_dir).select("doc_id", "indexed_at"), A.query_log(spark, sf_dir)).select("doc_id", "searches")


@register("a9_what_if_floor", f"""WITH {A.LOG} SELECT count(*) AS searches, count(*) FILTER (top_score < 0.05) AS refused_now, count(*) FILTER (top_score < 0.12) AS refused_then,
 count(*) FILTER (top_score < 0.12 AND NOT top_score < 0.05) AS gained, count(*) FILTER (top_score < 0.05 AND NOT top_score < 0.12) AS lost FROM log""")
def a9(spark, sf_dir):
    return Q.what_if(A.query_log(spark, sf_dir), 0.05, 0.12)


@register("a9_band_samples", f"WITH {A.LOG} SELECT query_norm, count(*) AS asked, max(top_score) AS best FROM log WHERE top_score >= 0.05 AND top_score < 0.12 GROUP BY query_norm ORDER BY asked DESC, best DESC, query_norm LIMIT 5")
def a9b(spark, sf_dir):
    return Q.band_samples(A.query_log(spark, sf_dir), 0.05, 0.12)


@register(
    "f7_configuration_scope",
    f"WITH {A.LOG} SELECT query_id FROM log WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-12' AND model = 'base' AND generation = 1 AND floor IS NOT DISTINCT FROM NULL",
)
def f7(spark, sf_dir):
    return Q.in_scope(A.query_log(spark, sf_dir), "2024-01-05 00:00:00", "2024-01-12 00:00:00", model="base", generation=1, floor=F.lit(None).cast("double")).select("query_id")


@register("r1_fixed_windows", "SELECT user_id AS token, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS hits, count(*) > 2 AS denied FROM events GROUP BY 1, 2")
def r1(spark, sf_dir):
    return Q.rate_windows(A.query_log(spark, sf_dir), 2, 3600)


@register("r2_sliding_log", "SELECT event_id AS query_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '7199.999999 seconds' PRECEDING AND CURRENT ROW) AS recent FROM events")
def r2(spark, sf_dir):
    return Q.sliding_counts(A.query_log(spark, sf_dir), 7200).select("query_id", "recent")


@register(
    "r4_debounce_sessions",
    """WITH g AS (SELECT user_id AS token, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY token ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT token, min(ts) AS start_at, count(*) AS n FROM s GROUP BY token, k""",
)
def r4(spark, sf_dir):
    return Q.sessions(A.query_log(spark, sf_dir), "2 hours")


@register("r5_coalesced_trigger", """WITH g AS (SELECT user_id AS token, ts, event_type, event_id, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY token ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT token, min(ts) AS start_at, arg_max(event_type, (CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END, event_id)) AS trigger FROM s GROUP BY token, k""")
def r5(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    rank = F.struct(F.expr("CASE event_type WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END"), "event_id")
    s = e.groupBy(F.col("user_id").alias("token"), F.session_window("ts", "2 hours").alias("s")).agg(F.max_by("event_type", rank).alias("trigger"))
    return s.select("token", F.col("s.start").alias("start_at"), "trigger")


@register("a25_histogram", "SELECT event_type, " + ", ".join(f"count(*) FILTER (value <= {b}) AS le_{i}" for i, b in enumerate((1, 5, 10, 50, 100))) + ", count(*) AS le_inf, round(sum(value), 4) AS total FROM events WHERE isfinite(value) GROUP BY event_type")
def a25(spark, sf_dir):
    return Q.histogram(table(spark, sf_dir, "events"), "value", ["event_type"], [1.0, 5.0, 10.0, 50.0, 100.0]).withColumn("total", F.round("total", 4))


@register("k9_keep_newest", "SELECT event_id, user_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def k9(spark, sf_dir):
    return Q.keep_newest(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20)


_L = "WITH " + A.LOG.replace("FROM events", "FROM {events}")
sql("f6_actor_token_filter", f"{_L} SELECT query_id, token FROM log WHERE actor = 'mcp' AND token IN (3, 5, 8)")
sql("f8_half_open_days", f"{_L} SELECT query_id FROM log WHERE created_at >= CAST('2024-01-03' AS TIMESTAMP_NTZ) AND created_at < CAST('2024-01-07' AS TIMESTAMP_NTZ) + INTERVAL '1' DAY", f"{_L} SELECT query_id FROM log WHERE created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-07' + INTERVAL 1 DAY")
sql("f9_refused_by", f"{_L} SELECT query_id, coalesce(floor > 0 AND top_score < floor, false) AS refused FROM log")
sql("j21_accounts_in_log", "SELECT c_custkey, c_name FROM {customer} c WHERE EXISTS (SELECT 1 FROM {events} e WHERE e.user_id = c.c_custkey)")
sql("r8_retention", "SELECT event_id FROM {events} WHERE ts >= CAST('2024-01-31' AS TIMESTAMP_NTZ) - INTERVAL '7' DAY", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY")
sql("t7_limit_plus_one", "SELECT event_id, ts, count(*) OVER () > 50 AS truncated FROM (SELECT * FROM {events} WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 51) x ORDER BY ts DESC, event_id DESC LIMIT 50")
sql("f19_null_partition", f"{_L} SELECT query_id FROM log WHERE floor IS NULL")
sql("k13_question_export", f"{_L} SELECT query_norm, concat('q-', substring(sha256(query_norm), 1, 12)) AS id, count(*) AS asked, concat('asked ', CAST(count(*) AS STRING), ' times') AS note FROM log GROUP BY query_norm".replace("sha256(query_norm)", "sha2(query_norm, 256)"), f"{_L} SELECT query_norm, concat('q-', substring(sha256(query_norm), 1, 12)) AS id, count(*) AS asked, concat('asked ', CAST(count(*) AS VARCHAR), ' times') AS note FROM log GROUP BY query_norm")
sql("z12_oldest_and_counts", f"{_L} SELECT model, min(created_at) AS oldest, count(*) AS n FROM log GROUP BY model")
sql("z18_rate_cost", "SELECT user_id, k, CAST(sum(cost) AS BIGINT) AS cost FROM (SELECT user_id, explode(array(struct('requests' AS k, 1 AS cost), struct('tools' AS k, CASE WHEN event_type = 'purchase' THEN 2 ELSE 0 END AS cost))) AS x FROM {events}) LATERAL VIEW inline(array(x)) t AS k, cost GROUP BY user_id, k", "SELECT user_id, k, CAST(sum(cost) AS BIGINT) AS cost FROM (SELECT user_id, 'requests' AS k, 1 AS cost FROM events UNION ALL SELECT user_id, 'tools', CASE WHEN event_type = 'purchase' THEN 2 ELSE 0 END FROM events) GROUP BY user_id, k")
sql("z17_audit_phrasing", "SELECT event_id, CASE event_type WHEN 'signup' THEN 'joined' WHEN 'purchase' THEN 'bought' WHEN 'error' THEN 'ran into an error' ELSE concat('did ', event_type) END AS phrase FROM {events}")
