"""Queries of findings, reports, retention, gates and upkeep, beside the SQL that checks them. The relations are read from the
driver's tables by SQL that both engines share; what is checked is then done by operators here and by SQL alone there."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from quern.operators import analytics
from quern.operators import evaluation as E
from quern.operators import findings as S
from quern.operators import logbook as L
from quern.operators import service, upkeep
from quern.plans import adapters as A
from quern.plans.registry import register
from quern.session import ship, table

_NAME = re.compile(r"\{(\w+)\}")


def rel(spark, sf_dir, text: str):
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in set(_NAME.findall(text))})


def _cte(**parts: str) -> str:
    """The relations as WITH clauses of the checking engine: tables by name, doubled braces single."""
    plain = {n: _NAME.sub(r"\1", t).replace("{{", "{").replace("}}", "}") for n, t in parts.items()}
    return "WITH " + ", ".join(f"{n} AS ({t})" for n, t in plain.items())


DOCS = "SELECT doc_id, lang AS project, 1 + doc_id % 2 AS generation, source, concat(source, '/', doc_id, '.md') AS relative_path, md5(text) AS content_hash, doc_id % 9 = 0 AS truncated FROM {documents}"
PROJECTS = "SELECT lang AS project, max(CASE WHEN lang = 'en' THEN 2 ELSE 1 END) AS live_generation FROM {documents} WHERE lang IS NOT NULL GROUP BY lang"
SCANS = """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE md5(text) END AS content_hash, CASE WHEN doc_id % 7 = 0 THEN 'no_content' ELSE 'scanned' END AS status,
 CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS ruleset, CASE WHEN doc_id % 11 <> 0 THEN 'k1' END AS key_id, doc_id % 13 = 0 AS capped FROM {documents} WHERE doc_id % 8 <> 1"""
FINDINGS = "SELECT conv_id * 1000 + turn AS finding_id, conv_id AS doc_id, role AS rule, turn AS start, md5(text) AS value_hmac, CASE WHEN turn % 3 = 0 THEN 'k0' ELSE 'k1' END AS key_id FROM {conversations}"
_SCAN = _cte(docs=DOCS, projects=PROJECTS, scans=SCANS, findings=FINDINGS) + """,
d AS (SELECT d.*, s.doc_id AS sid, s.content_hash AS sh, status, ruleset, s.key_id, capped FROM docs d JOIN projects p ON p.project = d.project AND p.live_generation = d.generation LEFT JOIN scans s ON s.doc_id = d.doc_id),
u AS (SELECT *, coalesce(sid IS NULL OR sh <> content_hash OR (status = 'scanned' AND (ruleset <> 2 OR key_id IS DISTINCT FROM 'k1')), false) AS due FROM d),
f AS (SELECT f.*, d.project, d.relative_path FROM findings f JOIN d ON d.doc_id = f.doc_id AND d.sh = d.content_hash)"""


def _scan(spark, sf_dir):
    return [rel(spark, sf_dir, t) for t in (DOCS, PROJECTS, SCANS)]


@register("j15_z11_due_documents", f"{_SCAN} SELECT project, doc_id, content_hash FROM u WHERE due")
def j15(spark, sf_dir):
    return S.due_documents(*_scan(spark, sf_dir), 2, "k1")


@register("z11_projects_with_due", f"{_SCAN} SELECT DISTINCT project FROM u WHERE due")
def z11(spark, sf_dir):
    return S.projects_with_due(*_scan(spark, sf_dir), 2, "k1")


@register("j14_current_findings", f"{_SCAN} SELECT project, relative_path, start, finding_id, rule, CASE WHEN key_id = 'k1' THEN left(value_hmac, 12) END AS \"group\" FROM f")
def j14(spark, sf_dir):
    return S.listing(rel(spark, sf_dir, FINDINGS), *_scan(spark, sf_dir), key_id="k1")


@register("f18_keyset_page", f"{_SCAN} SELECT relative_path, start, finding_id FROM f WHERE (relative_path, start, finding_id) > ('src1/', 1, 0) ORDER BY relative_path, start, finding_id LIMIT 40")
def f18(spark, sf_dir):
    f = S.listing(rel(spark, sf_dir, FINDINGS), *_scan(spark, sf_dir))
    return S.page(f, ["relative_path", "start", "finding_id"], 40, ("src1/", 1, 0))[0].select("relative_path", "start", "finding_id")


@register("a11_findings_by_rule", f"{_SCAN} SELECT p.project, r.rule, count(f.rule) AS findings FROM projects p CROSS JOIN (SELECT unnest(['user', 'assistant', 'other']) AS rule) r LEFT JOIN f ON f.project = p.project AND f.rule = r.rule GROUP BY p.project, r.rule")
def a11(spark, sf_dir):
    return S.by_rule(rel(spark, sf_dir, FINDINGS), *_scan(spark, sf_dir), ["user", "assistant", "other"])


@register("a11_scan_state", f"""{_SCAN} SELECT project, count(*) FILTER (due) AS pending, count(*) FILTER (NOT due AND status = 'scanned') AS scanned, count(*) FILTER (NOT due AND status = 'no_content') AS without_text,
 count(*) FILTER (NOT due AND status = 'scanned' AND capped) AS capped, count(*) FILTER (NOT due AND status = 'scanned' AND truncated) AS truncated FROM u GROUP BY project""")
def a11_state(spark, sf_dir):
    return S.scan_state(*_scan(spark, sf_dir), 2, "k1")


REPORTS = f"""SELECT query_id AS report_id, query_norm, query_text AS query, CASE WHEN token % 9 > 0 THEN token END AS token, CASE WHEN query_id % 3 = 0 THEN concat('note ', query_id) END AS note, created_at
 FROM (SELECT {A._LOG} FROM {{events}}) x"""
_REPORTS = _cte(r=REPORTS)


@register("a8_configurations_present", f"WITH {A.LOG} SELECT model, generation, floor, count(*) AS searches, min(created_at) AS first_at, max(created_at) AS last_at FROM log GROUP BY model, generation, floor")
def a8(spark, sf_dir):
    return L.configurations(A.query_log(spark, sf_dir))


@register(
    "a10_reported_gaps",
    f"""{_REPORTS} SELECT query_norm, list(query ORDER BY created_at DESC, report_id DESC)[1] AS sample, count(*) AS reports, count(DISTINCT token) AS reporters, min(created_at) AS first_at, max(created_at) AS last_at,
 (list(note ORDER BY created_at DESC, report_id DESC) FILTER (note IS NOT NULL))[1] AS last_note FROM r GROUP BY query_norm""",
)
def a10(spark, sf_dir):
    return L.gap_groups(rel(spark, sf_dir, REPORTS))


@register("a5_first_by_order", f"WITH {A.LOG} SELECT token, list(query_text ORDER BY created_at DESC, query_id DESC)[1] AS latest, (list(query_text ORDER BY created_at DESC, query_id DESC) FILTER (hit_count > 0))[1] AS latest_answered FROM log GROUP BY token")
def a5(spark, sf_dir):
    order = ["created_at", "query_id"]
    return A.query_log(spark, sf_dir).groupBy("token").agg(L.latest("query_text", order).alias("latest"), L.latest("query_text", order, F.col("hit_count") > 0).alias("latest_answered"))


@register(
    "r3_hourly_cap",
    """WITH RECURSIVE e AS (SELECT event_id, user_id % 7 AS who, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id % 7 ORDER BY ts, event_id) AS i FROM events),
r AS (
  SELECT DISTINCT who, 0::BIGINT AS i, []::BIGINT[] AS taken, NULL::BIGINT AS event_id, false AS ok FROM e
  UNION ALL
  SELECT who, i, CASE WHEN len(l) < 2 THEN list_append(l, t) ELSE l END, event_id, len(l) < 2
  FROM (SELECT e.who, e.i, e.event_id, e.t, list_filter(r.taken, lambda x: x > e.t - 3600000000) AS l FROM r JOIN e ON e.who = r.who AND e.i = r.i + 1) s)
SELECT event_id AS report_id, who AS reporter FROM r WHERE ok""",
)
def r3(spark, sf_dir):
    ship(spark)
    r = table(spark, sf_dir, "events").select(F.col("event_id").alias("report_id"), F.expr("user_id % 7").alias("reporter"), F.col("ts").alias("created_at"))
    return L.within_hourly_cap(r, 2).select("report_id", "reporter")


@register("t8_retention_cutoff", "WITH n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY date_trunc('minute', ts) DESC) AS i FROM events), c AS (SELECT event_type, date_trunc('minute', ts) AS cut FROM n WHERE i = 60) SELECT event_id FROM events e LEFT JOIN c USING (event_type) WHERE cut IS NULL OR date_trunc('minute', ts) >= cut")
def t8(spark, sf_dir):
    """Times of whole minutes, so that several rows share the cut."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("at"))
    return L.retained(e, ["event_type"], "at", 60).select("event_id")


@register("k13_question_ids", f"WITH {A.LOG} SELECT query_norm, count(*) AS asked, 'q-' || substring(sha256(query_norm), 1, 12) AS id FROM log GROUP BY query_norm")
def k13(spark, sf_dir):
    q = A.query_log(spark, sf_dir).groupBy("query_norm").agg(F.count("*").alias("asked"))
    return L.question_ids(q, [-F.col("asked")]).select("query_norm", "asked", "id")


_THREE = "floor({x} * 1000 + 0.5)::BIGINT // 1000 || '.' || lpad((floor({x} * 1000 + 0.5)::BIGINT % 1000)::VARCHAR, 3, '0')"


@register(
    "k13_question_lines",
    f"""WITH {A.LOG}, {A.HITS}, q AS (SELECT query_norm, arg_max(query_text, (created_at, query_id)) AS spelling, count(*) AS asked, count(DISTINCT CASE WHEN token % 9 > 0 THEN token END) AS tokens, count(*) FILTER (token % 9 = 0) AS unknown,
 count(DISTINCT created_at::DATE) AS days, min(created_at) AS first_at, max(created_at) AS last_at, max(top_score) AS best_score FROM log GROUP BY query_norm),
h AS (SELECT query_norm, doc_id, count(*) AS times, max(score) AS best FROM hits JOIN log USING (query_id) GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY query_norm ORDER BY times DESC, best DESC, doc_id) AS place FROM h),
l AS (SELECT query_norm, string_agg('doc ' || doc_id || ' (' || {_THREE.format(x='best')} || ', ' || times || 'x)', '; ' ORDER BY place) AS hits FROM t WHERE place <= 3 GROUP BY query_norm)
SELECT to_json({{'id': 'q-' || substring(sha256(query_norm), 1, 12), 'query': spelling, 'note': 'Asked ' || asked || 'x by ' || tokens || CASE tokens WHEN 1 THEN ' token' ELSE ' tokens' END || CASE WHEN unknown > 0 THEN ' and ' || unknown || ' unattributed' ELSE '' END
 || ' on ' || days || CASE days WHEN 1 THEN ' day, ' ELSE ' days, ' END || strftime(first_at, '%Y-%m-%d') || ' to ' || strftime(last_at, '%Y-%m-%d') || '. Best score: ' || coalesce({_THREE.format(x='best_score')}, 'none')
 || '. Returned: ' || coalesce(hits, 'nothing') || '. To do: name the document that should have answered, or delete this line.'}})::VARCHAR AS line FROM q LEFT JOIN l USING (query_norm)""",
)
def k13_lines(spark, sf_dir):
    log = A.query_log(spark, sf_dir)
    known = F.when(F.col("token") % 9 > 0, F.col("token"))
    q = log.groupBy("query_norm").agg(
        L.latest("query_text", ["created_at", "query_id"]).alias("spelling"),
        F.count("*").alias("asked"),
        F.count_distinct(known).alias("tokens"),
        F.count_if(known.isNull()).alias("unknown"),
        F.count_distinct(F.to_date("created_at")).alias("days"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.max("top_score").alias("best_score"),
    )
    top = analytics.top_hits(log, A.query_hits(spark, sf_dir)).withColumn("path", F.concat(F.lit("doc "), "doc_id"))
    return L.question_lines(q, top, [-F.col("asked")]).select("line")


AUDIT = "SELECT event_id, ts AS created_at, CASE WHEN user_id % 4 > 0 THEN concat('p', user_id % 4) END AS project, event_type AS action, user_id AS actor FROM {events}"


@register("q9_audit_facets", _cte(a=AUDIT) + " SELECT 'action' AS facet, action AS value, count(*) AS n FROM a GROUP BY action UNION ALL SELECT 'project', project, count(*) FROM a WHERE project IS NOT NULL GROUP BY project UNION ALL SELECT 'actor', actor::VARCHAR, count(*) FROM a GROUP BY actor")
def q9(spark, sf_dir):
    return L.facets(rel(spark, sf_dir, AUDIT), ["action", "project", "actor"])


@register("f8_f19_audit_scope", _cte(a=AUDIT) + " SELECT event_id FROM a WHERE project IS NULL AND created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-08' AND action = 'error'")
def f8(spark, sf_dir):
    return L.audit_scope(rel(spark, sf_dir, AUDIT), "none", "2024-01-03", "2024-01-07", action="error").select("event_id")


OFF = "SELECT doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id * 7 % 11 END AS rank, doc_id % 4 = 0 AS below_floor, array('x', CASE WHEN toxic = 1 THEN 'rude' ELSE 'kind' END) AS tags FROM {labels}"
ON = "SELECT doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE doc_id * 3 % 11 END AS rank, doc_id % 6 = 0 AS below_floor, array('x') AS tags FROM {labels}"
_ARMS = "WITH j AS (SELECT toxic = 1 AS s, coalesce(doc_id % 3 <> 0 AND doc_id * 7 % 11 < 5, false) AS a, coalesce(doc_id % 5 <> 0 AND doc_id * 3 % 11 < 5, false) AS b, doc_id % 4 = 0 AS al, doc_id % 6 = 0 AS bl FROM labels)"


def _side(name: str, w: str) -> str:
    parts = {"questions": "true", "off_hits": "a", "on_hits": "b", "gained": "b AND NOT a", "lost": "a AND NOT b", "off_past_floor": "a AND NOT al", "on_past_floor": "b AND NOT bl"}
    return ", ".join(f"count(*) FILTER ({w} AND {c}) AS {name}_{n}" for n, c in parts.items())


@register("z3_slice_gate", f"{_ARMS}, c AS (SELECT {_side('slice', 's')}, {_side('rest', 'NOT s')} FROM j), g AS (SELECT *, NULL::VARCHAR AS fault, slice_questions > 0 AND slice_on_hits * 1000 > slice_questions * 300 AS slice_passed FROM c) SELECT *, slice_passed AND rest_lost = 0 AS passed FROM g")
def z3(spark, sf_dir):
    return E.slice_gate(rel(spark, sf_dir, OFF), rel(spark, sf_dir, ON), "rude", 300)


PROBES = f"SELECT x.*, concat('g', doc_id % 3) AS corpus FROM (SELECT {A._SAMPLES} FROM {{labels}}) x"


@register("z4_probe_floor", _cte(s=PROBES) + ", f AS (SELECT corpus, max(score) AS floor FROM s WHERE truth = 0 AND doc_id % 2 = 0 GROUP BY corpus) SELECT corpus, kind, floor, count(*) AS n, avg(CASE WHEN score < floor THEN 1.0 ELSE 0.0 END)::DOUBLE AS refused FROM s LEFT JOIN f USING (corpus) WHERE NOT (truth = 0 AND doc_id % 2 = 0) GROUP BY corpus, kind, floor")
def z4(spark, sf_dir):
    s = rel(spark, sf_dir, PROBES)
    return E.probe_floor(s, (F.col("truth") == 0) & (F.col("doc_id") % 2 == 0), ["corpus"])


@register("z5_feature_thresholds", _cte(s=PROBES.replace("x.*", "x.*, score * score - score AS dip")) + """, v AS (SELECT corpus, truth, unnest([{'f': 'score', 'v': score}, {'f': 'dip', 'v': dip}], recursive := true) FROM s), t AS (SELECT f, min(v) AS t FROM v WHERE truth = 1 GROUP BY f)
SELECT corpus, count(*) AS n, v.f AS feature, t AS threshold, avg(CASE WHEN v < t THEN 1.0 ELSE 0.0 END)::DOUBLE AS caught FROM v JOIN t ON t.f = v.f WHERE truth = 0 GROUP BY corpus, v.f, t""")
def z5(spark, sf_dir):
    s = rel(spark, sf_dir, PROBES).withColumn("dip", F.col("score") * F.col("score") - F.col("score"))
    return E.feature_thresholds(s, ["score", "dip"], ["corpus"])


GOLDEN = "SELECT conv_id AS key, CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'fr' END AS project, concat('src', conv_id % 5, '/', conv_id, '.md') AS expect_file FROM {conversations} WHERE turn = 0"


@register("j20_expected_known", _cte(g=GOLDEN, d=DOCS) + " SELECT key, EXISTS (SELECT 1 FROM d WHERE d.project = g.project AND d.relative_path = g.expect_file) AS scorable FROM g")
def j20(spark, sf_dir):
    return E.expected_known(rel(spark, sf_dir, GOLDEN), rel(spark, sf_dir, DOCS)).select("key", "scorable")


_OWN = {"queries": "SELECT event_id AS query_id, concat('p', user_id % 4) AS project FROM {events}", "gaps": "SELECT concat('p', doc_id % 4) AS project FROM {labels}", "runs": "SELECT concat('p', page_id % 3) AS project FROM {pages}"}
_HITS = "SELECT event_id % 700 AS query_id FROM {events} WHERE event_id % 3 = 0"
_MEMBERS = "SELECT concat('p', conv_id % 5) AS project, role FROM {conversations}"
_PROJ = "SELECT concat('p', n_regionkey) AS project FROM {nation}"


@register(
    "z8_exclusion_counts",
    _cte(**_OWN, hits=_HITS, members=_MEMBERS, proj=_PROJ)
    + """, c AS (SELECT project, 'queries' AS what FROM queries UNION ALL SELECT project, 'gaps' FROM gaps UNION ALL SELECT project, 'runs' FROM runs UNION ALL SELECT project, 'queries_hits' FROM hits JOIN queries USING (query_id)
 UNION ALL SELECT project, 'members:' || role FROM members WHERE role IN ('user', 'system')), w AS (SELECT unnest(['queries', 'gaps', 'runs', 'queries_hits', 'members:user', 'members:system']) AS what)
SELECT p.project, w.what, count(c.what) AS n FROM (SELECT DISTINCT project FROM proj) p CROSS JOIN w LEFT JOIN c ON c.project = p.project AND c.what = w.what GROUP BY p.project, w.what""",
)
def z8(spark, sf_dir):
    tables = {n: rel(spark, sf_dir, t) for n, t in _OWN.items()}
    return upkeep.excluded_counts(rel(spark, sf_dir, _PROJ), tables, rel(spark, sf_dir, _HITS), "queries", rel(spark, sf_dir, _MEMBERS), ["user", "system"])


_MODELS = "SELECT c_custkey AS project, CASE WHEN c_custkey % 5 > 0 THEN concat('m', c_custkey % 5) END AS model FROM {customer}"


@register("q14_needs_reindex", _cte(p=_MODELS) + " SELECT project, model AS indexed_with FROM p WHERE model <> 'm2' AND project IN (SELECT o_custkey FROM orders)")
def q14(spark, sf_dir):
    return upkeep.needing_reindex(rel(spark, sf_dir, _MODELS), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("project")), "m2")


_SOURCES = "SELECT o_orderkey AS source, CASE WHEN o_orderkey % 3 > 0 THEN 60 END AS interval_, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate END AS next_at, CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate + INTERVAL '5' DAY END AS webhook_at FROM {orders}"


@register("t12_due_first", _cte(s=_SOURCES) + " SELECT source, CASE WHEN interval_ IS NOT NULL AND next_at IS NULL THEN NULL ELSE least(CASE WHEN interval_ IS NOT NULL THEN next_at END, webhook_at) END AS claim FROM s WHERE (interval_ IS NOT NULL AND (next_at IS NULL OR next_at <= TIMESTAMP '1998-01-01')) OR webhook_at <= TIMESTAMP '1998-01-01' ORDER BY claim NULLS FIRST, source LIMIT 100")
def t12(spark, sf_dir):
    s = rel(spark, sf_dir, _SOURCES).withColumnRenamed("interval_", "interval")
    return upkeep.due_sources(s, F.expr("timestamp_ntz '1998-01-01'"), 100).select("source", "claim")


@register("d5_plausible_date", "SELECT o_orderkey, CASE WHEN o_orderdate > TIMESTAMP '1970-01-01' AND o_orderdate <= TIMESTAMP '1996-01-02' THEN o_orderdate END AS at FROM orders")
def d5(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", upkeep.plausible_date(F.col("o_orderdate").cast("timestamp_ntz"), F.expr("timestamp_ntz '1996-01-01'")).alias("at"))


@register("d6_past_skip_age", "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN true ELSE ts < TIMESTAMP '2024-01-29' END AS past FROM events")
def d6(spark, sf_dir):
    last = F.when(F.col("event_id") % 6 != 0, F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", upkeep.past_skip_age(last, 24, F.expr("timestamp_ntz '2024-01-30'")).alias("past"))


_META = """SELECT page_id AS doc_id, page_id % 7 > 0 AS answered, CASE WHEN page_id % 5 = 0 THEN concat('ftp:', url) ELSE url END AS url, CASE WHEN page_id % 4 > 0 THEN page_id END AS modified_at, page_id % 2 = 0 AS stamp,
 concat('http://old/', page_id) AS old_url, CASE WHEN page_id % 3 > 0 THEN -page_id END AS old_modified_at, page_id % 11 > 0 AS known, page_id % 10 = 6 AS changed FROM {pages}"""


@register("d8_stored_meta", _cte(m=_META) + " SELECT doc_id, CASE WHEN NOT answered THEN old_url WHEN regexp_matches(url, '^https?://') THEN url END AS url, CASE WHEN NOT answered THEN old_modified_at WHEN stamp AND NOT changed AND known AND old_modified_at IS NOT NULL THEN old_modified_at ELSE modified_at END AS modified_at FROM m")
def d8(spark, sf_dir):
    return upkeep.stored_meta(rel(spark, sf_dir, _META))


_LANGS = "SELECT source, max(CASE WHEN doc_id % 2 = 0 THEN 'english' WHEN doc_id % 3 = 0 THEN 'klingon' END) AS language FROM {documents} GROUP BY source"
_CONFIGS = "SELECT doc_id AS chunk_id, source, CASE WHEN doc_id % 3 = 0 THEN 'simple' WHEN doc_id % 3 = 1 THEN 'english' END AS config FROM {documents}"


@register("j17_z15_relex_due", _cte(s=_LANGS, c=_CONFIGS) + " SELECT chunk_id, CASE WHEN language = 'english' THEN 'english' ELSE 'simple' END AS config FROM c JOIN s USING (source) WHERE c.config IS DISTINCT FROM CASE WHEN language = 'english' THEN 'english' ELSE 'simple' END")
def j17(spark, sf_dir):
    return upkeep.relex_due(rel(spark, sf_dir, _CONFIGS), rel(spark, sf_dir, _LANGS), ["english", "german"])


_BODIES = """SELECT event_id AS request_id, CASE event_id % 5 WHEN 0 THEN '[{{"method":"tools/call","id":1,"params":{{"name":"search"}}}},{{"method":"tools/call","id":null,"params":{{"name":"search"}}}},{{"method":"ping","id":2}}]'
 WHEN 1 THEN '{{"method":"tools/list","id":7}}' WHEN 2 THEN '{{"method":"notifications/x","id":7}}' WHEN 3 THEN concat('{{"method":"tools/call","id":"', user_id, '","params":{{"name":"read"}}}}') ELSE 'no json' END AS body,
 CASE WHEN user_id % 3 > 0 THEN user_id END AS token, user_id % 2 = 0 AS open, user_id % 4 AS project, CASE WHEN user_id % 9 > 0 THEN concat('10.0.0.', user_id) END AS address_key FROM {events}"""


@register(
    "z18_rate_checks",
    _cte(r=_BODIES)
    + """, b AS (SELECT *, CASE WHEN token IS NOT NULL THEN concat('tok:', token) WHEN open THEN concat('ip:', project, ':', coalesce(address_key, 'unknown')) END AS base, CASE WHEN token IS NOT NULL THEN 60 ELSE 20 END AS own FROM r)
SELECT request_id, base AS key, own::INT AS "limit", CASE request_id % 5 WHEN 0 THEN 2 ELSE 1 END::BIGINT AS cost FROM b WHERE base IS NOT NULL AND request_id % 5 IN (0, 1, 3)
UNION ALL SELECT request_id, base || ':tool:search', 10, 2 FROM b WHERE base IS NOT NULL AND request_id % 5 = 0""",
)
def z18(spark, sf_dir):
    r = rel(spark, sf_dir, _BODIES)
    return upkeep.limit_checks(r, upkeep.message_cost(r, ["search", "read"]), 60, 20, {"search": 10, "read": 0})


@register("q2_list_topics", f"WITH {A.DOCUMENTS} SELECT relative_path, source, (SELECT count(*) FROM docs) AS documents, (SELECT count(DISTINCT source) FROM docs) AS sources, (SELECT count(*) FROM docs WHERE relative_path > 'src1') > 200 AS has_more FROM docs WHERE relative_path > 'src1' ORDER BY relative_path LIMIT 200")
def q2(spark, sf_dir):
    return service.list_topics(A.documents(spark, sf_dir), "src1", 200)
