"""Evaluation and calibration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import evaluation as E
from quern.operators import ranks
from quern.plans import adapters as A
from quern.plans.registry import register
from quern.plans.sqlbook import sql
from quern.session import table

_RUN = """SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(doc_id * 7 % 11 AS INT) END AS rank, CAST((doc_id * 31 % 1000) AS DOUBLE) / 1000 AS score,
 CASE WHEN doc_id % 4 = 0 THEN 'h' END AS heading, CAST(doc_id * 5 % 9 AS INT) AS heading_rank, doc_id % 6 = 0 AS gated, quality, toxic"""
_RUNS = f"run AS ({_RUN} FROM labels)"


def _run(spark, sf_dir):
    return spark.sql(f"{_RUN} FROM {{labels}}", labels=table(spark, sf_dir, "labels"))


_METRICS = """count(*) AS n, round(avg(CASE WHEN rank < 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN rank < 5 THEN 1.0 ELSE 0 END), 6) AS recall_5,
 round(avg(coalesce(1.0::DOUBLE / (rank + 1), 0)), 6) AS mrr, round(avg(CASE WHEN rank IS NOT NULL THEN score END), 6) AS correct_score,
 round(avg(CASE WHEN heading IS NOT NULL THEN CASE WHEN heading_rank < 5 THEN 1.0 ELSE 0 END END), 6) AS heading_5,
 count(*) FILTER (gated) AS gated, count(*) FILTER (gated AND rank IS NOT NULL) AS gated_with_answer"""
_ROUND = ("recall_1", "recall_5", "mrr", "correct_score", "heading_5")


def _rounded(df, names=_ROUND, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in names})


@register("a15_retrieval_metrics", f"WITH {_RUNS} SELECT {_METRICS} FROM run")
def a15(spark, sf_dir):
    return _rounded(E.retrieval_metrics(_run(spark, sf_dir)))


@register("a16_metrics_by_tag", f"WITH {_RUNS}, t AS (SELECT *, unnest([CASE quality WHEN 1 THEN 'good' ELSE 'poor' END, CASE toxic WHEN 1 THEN 'rude' ELSE 'kind' END]) AS tag FROM run) SELECT tag, {_METRICS} FROM t GROUP BY tag")
def a16(spark, sf_dir):
    r = _run(spark, sf_dir).withColumn("tags", F.expr("array(CASE quality WHEN 1 THEN 'good' ELSE 'poor' END, CASE toxic WHEN 1 THEN 'rude' ELSE 'kind' END)"))
    return _rounded(E.by_tag(r))


@register("a17_refusal_bands", f"WITH {A.SAMPLES} SELECT kind, count(*) AS n, count(*) FILTER (score < 0.5) AS refused, count(*) FILTER (score < 0.5 AND truth = 1) AS refused_with_answer FROM samples GROUP BY kind")
def a17(spark, sf_dir):
    low = F.col("score") < 0.5
    return A.samples(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.count_if(low).alias("refused"), F.count_if(low & (F.col("truth") == 1)).alias("refused_with_answer"))


@register("a20_j22_auc", f"WITH {A.SAMPLES} SELECT round(avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END), 6) AS auc FROM samples p, samples n WHERE p.truth = 1 AND n.truth = 0")
def a20(spark, sf_dir):
    return _rounded(E.auc(A.samples(spark, sf_dir)), ["auc"])


@register("a21_score_features", f"""WITH {A.LOG}, {A.HITS}, g AS (SELECT query_id, max(score) AS top, max(CASE WHEN rank = 2 THEN score END) AS second, min(score) AS last, avg(score) AS mean, stddev_pop(score) AS sd FROM hits GROUP BY query_id)
SELECT query_id, round(top, 6) AS top, round(top - coalesce(second, 0), 6) AS gap, round(top - last, 6) AS spread, round(CASE WHEN sd > 1e-12 THEN (top - mean) / sd ELSE 0 END, 4) AS z FROM g""")
def a21(spark, sf_dir):
    return _rounded(_rounded(E.score_features(A.query_hits(spark, sf_dir)), ("top", "gap", "spread")), ["z"], 4)


@register("a22_j23_floor_sweep", f"WITH {A.SAMPLES}, f AS (SELECT unnest(range(600, 991, 10)) / 1000.0::DOUBLE AS floor) SELECT kind, floor, round(avg(CASE WHEN floor(score * 1000) < round(floor * 1000) THEN 1.0 ELSE 0 END), 6) AS refused FROM samples, f GROUP BY kind, floor")
def a22(spark, sf_dir):
    return _rounded(E.floor_sweep(A.samples(spark, sf_dir), E.grid(spark, step=10)), ["refused"])


@register("a24_fit_floor", f"WITH {A.SAMPLES}, f AS (SELECT unnest(range(600, 991)) AS c), t AS (SELECT c, (SELECT count(*) FROM samples WHERE floor(score * 1000) < c) AS below FROM f) SELECT coalesce(max(c) / 1000.0::DOUBLE, 0) AS floor FROM t WHERE below <= floor((SELECT count(*) FROM samples) * 0.75)")
def a24(spark, sf_dir):
    return E.fit_floor(A.samples(spark, sf_dir), 0.75)


@register("a23_drop_ratio", f"""WITH {A.LOG}, {A.HITS}, t AS (SELECT *, doc_id % 2 = 0 AS relevant, score >= first_value(score) OVER (PARTITION BY query_id ORDER BY rank) * 0.4 AS keep FROM hits)
SELECT count(*) FILTER (keep) AS kept, count(*) FILTER (NOT keep) AS lost, count(*) FILTER (keep AND relevant) AS relevant_kept, count(*) FILTER (NOT keep AND relevant) AS relevant_lost FROM t""")
def a23(spark, sf_dir):
    return E.drop_ratio(A.query_hits(spark, sf_dir).withColumn("relevant", F.expr("doc_id % 2 = 0")), 0.4)


_PAIR = """prev AS (SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id * 7 % 11 END AS rank, doc_id % 10 AS fp FROM labels),
cur AS (SELECT doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 3 % 11 END AS rank, CASE WHEN doc_id % 17 = 0 THEN -1 ELSE doc_id % 10 END AS fp FROM labels WHERE doc_id % 13 <> 0)"""


def _pair(spark, sf_dir):
    t = table(spark, sf_dir, "labels")
    p = t.selectExpr("doc_id AS key", "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id * 7 % 11 END AS rank", "doc_id % 10 AS fp")
    c = t.filter("doc_id % 13 <> 0").selectExpr("doc_id AS key", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 3 % 11 END AS rank", "CASE WHEN doc_id % 17 = 0 THEN -1 ELSE doc_id % 10 END AS fp")
    return p, c


@register("j19_u4_lost_keys", f"WITH {_PAIR} SELECT p.key, p.fp, p.rank AS was, c.rank AS now FROM prev p JOIN cur c ON p.key = c.key AND p.fp = c.fp WHERE p.rank < 5 AND NOT coalesce(c.rank < 5, false)")
def j19(spark, sf_dir):
    return E.regressions(*_pair(spark, sf_dir))


@register("u3_newly_skipped", f"WITH {_PAIR} SELECT key FROM cur WHERE rank IS NULL INTERSECT SELECT key FROM prev WHERE rank IS NOT NULL")
def u3(spark, sf_dir):
    p, c = _pair(spark, sf_dir)
    return c.filter("rank IS NULL").select("key").join(p.filter("rank IS NOT NULL"), "key", "left_semi").distinct()


@register("h1_fingerprint", """SELECT conv_id, turn, substring(sha256('["' || conv_id || '","' || turn || '","' || role || '"]'), 1, 16) AS fp FROM conversations""")
def h1(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", E.fingerprint(F.col("conv_id"), F.col("turn"), F.col("role")).alias("fp"))


@register("x12_heading_matches", "SELECT p_partkey, (p_type = 'x' OR ('guide > ' || p_brand) LIKE '% > Brand#1' OR p_brand = 'Brand#1') AS hit FROM part")
def x12(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", E.heading_matches(F.concat(F.lit("guide > "), "p_brand"), F.lit("Brand#1")).alias("hit"))


_S = "WITH " + A.SAMPLES.replace("FROM labels", "FROM {labels}")
_R = "WITH " + _RUNS.replace("FROM labels", "FROM {labels}")
_SQL = "WITH " + A.SAMPLES


@register("a18_quantile_linear", f"{_SQL} SELECT kind, min(score) AS least, round(quantile_cont(score, 0.05), 9) AS p05, round(quantile_cont(score, 0.5), 9) AS median, max(score) AS most FROM samples GROUP BY kind")
def a18(spark, sf_dir):
    q = ranks.quantiles(A.samples(spark, sf_dir), "kind", "score", {"least": (0.0, "linear"), "p05": (0.05, "linear"), "median": (0.5, "linear"), "most": (1.0, "linear")})
    return q.select("kind", "least", F.round("p05", 9).alias("p05"), F.round("median", 9).alias("median"), "most")


@register("a19_quantile_nearest_rank", f"{_SQL}, r AS (SELECT kind, score, row_number() OVER (PARTITION BY kind ORDER BY score) AS i, count(*) OVER (PARTITION BY kind) AS n FROM samples) SELECT kind, max(CASE WHEN i = ceil(0.05 * n) THEN score END) AS p05, max(CASE WHEN i = ceil(0.5 * n) THEN score END) AS p50 FROM r GROUP BY kind")
def a19(spark, sf_dir):
    return ranks.quantiles(A.samples(spark, sf_dir), "kind", "score", {"p05": (0.05, "nearest"), "p50": (0.5, "nearest")}).drop("n")


sql("t10_worst_misses", f"{_R} SELECT key, rank, score FROM run ORDER BY coalesce(1.0 / (rank + 1), 0) ASC, score DESC, key LIMIT 25")
sql("t11_deterministic_sample", "SELECT doc_id, md5(CAST(doc_id AS STRING)) AS h FROM {documents} ORDER BY h LIMIT 60", "SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS h FROM documents ORDER BY h LIMIT 60")
sql("q12_gate_verdict", f"{_R}, m AS (SELECT avg(CASE WHEN rank < 5 THEN 1.0 ELSE 0.0 END) AS r5, avg(CASE WHEN heading IS NOT NULL THEN CASE WHEN heading_rank < 5 THEN 1.0 ELSE 0.0 END END) AS h5 FROM run) SELECT r5 >= 0.675 AS recall_ok, h5 >= 0.650 AS heading_ok FROM m")
sql("z5_feature_threshold", f"{_S}, f AS (SELECT min(score) AS t FROM samples WHERE truth = 1) SELECT kind, round(avg(CASE WHEN truth = 0 AND score < t THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 6) AS caught FROM samples, f GROUP BY kind")
sql("z3_slice_comparison", f"{_R}, b AS (SELECT key, toxic AS slice, coalesce(rank < 5, false) AS before, coalesce(key * 3 % 11 < 5, false) AS now FROM run) SELECT slice, count(*) AS n, CAST(count_if(now AND NOT before) AS BIGINT) AS gained, CAST(count_if(before AND NOT now) AS BIGINT) AS lost, CAST(count_if(now) AS BIGINT) AS hits, count_if(now) * 1000 > count(*) * 400 AS gate FROM b GROUP BY slice")
sql("n7_unbounded_total", "SELECT label, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM {embeddings} GROUP BY label")
sql("z7_first_per_group", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM {documents}) x WHERE n = 1")
sql("j20_known_files", "SELECT conv_id FROM (SELECT DISTINCT conv_id FROM {conversations}) c WHERE NOT EXISTS (SELECT 1 FROM {labels} l WHERE l.doc_id = c.conv_id)")
sql("a12_scoped_totals", "SELECT count(*) AS n, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars FROM {documents} WHERE lang = 'fr' AND source = 'src3'")
sql("v5_rrf_score", "SELECT n_nationkey, round(1D / (60 + n_nationkey), 9) AS score FROM {nation}", "SELECT n_nationkey, round(1::DOUBLE / (60 + n_nationkey), 9) AS score FROM nation")
sql("v1_cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(aggregate(zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), 0D, (s, x) -> s + x), 5) AS dot FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
