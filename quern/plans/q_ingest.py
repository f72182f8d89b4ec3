"""Ingest, journal, governance and listing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import catalog as C
from quern.operators import ingest as I
from quern.plans import adapters as A
from quern.plans.registry import register
from quern.plans.sqlbook import checked, sql
from quern.session import table

_RAW = "CASE doc_id % 7 WHEN 0 THEN '/a\\b/' || doc_id WHEN 1 THEN './x//' || doc_id WHEN 2 THEN 'x/../' || doc_id WHEN 3 THEN '' WHEN 4 THEN 'k/' || doc_id || '/' ELSE source || '/' || doc_id END"
_RAW_SPARK = _RAW.replace("\\", "\\\\")


@register("s4_clean_path", f"WITH p AS (SELECT doc_id, regexp_replace(replace({_RAW}, '\\', '/'), '^(\\./|/)+', '') AS q FROM documents) SELECT doc_id, CASE WHEN len(list_filter(string_split(q, '/'), lambda s: s IN ('', '.', '..'))) = 0 THEN q END AS path FROM p")
def s4(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", I.clean_path(F.expr(_RAW_SPARK)).alias("path"))


@register("s27_key_usability", f"""WITH k AS (SELECT doc_id, {_RAW} AS k FROM documents), p AS (SELECT doc_id, k, regexp_replace(replace(k, '\\', '/'), '^(\\./|/)+', '') AS q FROM k)
SELECT doc_id, CASE WHEN k LIKE '%/' THEN 'folder-marker' WHEN len(list_filter(string_split(q, '/'), lambda s: s IN ('', '.', '..'))) > 0 OR q <> k THEN 'unsafe-name' END AS fault FROM p""")
def s27(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", I.key_fault(F.expr(_RAW_SPARK)).alias("fault"))


_GEN = """o AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
n AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate >= TIMESTAMP '1997-06-01' GROUP BY 1)"""


def _generations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    g = lambda c: o.filter(c).groupBy(F.col("o_custkey").alias("relative_path")).agg(F.max("o_totalprice").alias("content_hash"))
    return g(F.col("o_orderdate") < F.expr("timestamp_ntz '1998-01-01'")), g(F.col("o_orderdate") >= F.expr("timestamp_ntz '1997-06-01'"))


@register("j8_s24_snapshot_diff", f"WITH {_GEN} SELECT coalesce(o.k, n.k) AS relative_path, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.v <> n.v THEN 'modified' ELSE 'unchanged' END AS change FROM o FULL OUTER JOIN n ON o.k = n.k")
def j8(spark, sf_dir):
    return I.snapshot_diff(*_generations(spark, sf_dir))


@register("k1_upsert", f"WITH {_GEN} SELECT k AS relative_path, v AS content_hash FROM n UNION ALL SELECT k, v FROM o WHERE k NOT IN (SELECT k FROM n)")
def k1(spark, sf_dir):
    return I.upsert(*_generations(spark, sf_dir), ["relative_path"])


@register("k2_u1_removed_paths", f"WITH {A.DOCUMENTS} SELECT relative_path FROM docs WHERE doc_id % 5 = 0 AND source NOT IN ('src1', 'src2')")
def u1(spark, sf_dir):
    d = A.documents(spark, sf_dir).select("relative_path", "source", "doc_id")
    return I.missing(d.drop("doc_id"), d.filter("doc_id % 5 <> 0"), d.filter("source IN ('src1', 'src2')")).select("relative_path")


@register("s25_revision_token", "SELECT sha256(string_agg(k || chr(9) || v || chr(9) || s, chr(10) ORDER BY k || chr(9) || v || chr(9) || s)) AS token, count(*) AS files FROM (SELECT 'src' || doc_id AS k, lang AS v, n_chars::VARCHAR AS s FROM documents)")
def s25(spark, sf_dir):
    return I.revision(table(spark, sf_dir, "documents").select(F.concat(F.lit("src"), "doc_id").alias("key"), F.col("lang").alias("version"), F.col("n_chars").alias("size")))


_TREE = "CASE WHEN p_partkey % 11 = 0 THEN 'd' || p_size WHEN p_partkey % 11 = 1 THEN 'd' || p_size || '/e' || (p_partkey % 100) ELSE 'd' || p_size || '/e' || (p_partkey % 100) || '/' || p_partkey END"


@register("s28_path_conflicts", f"WITH f AS (SELECT DISTINCT {_TREE} AS key FROM part WHERE p_size % 3 <> 0 OR p_partkey % 11 <> 0) SELECT key FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE starts_with(f.key, g.key || '/'))")
def s28(spark, sf_dir):
    f = table(spark, sf_dir, "part").filter("p_size % 3 <> 0 OR p_partkey % 11 <> 0").selectExpr(f"{_TREE} AS key").distinct()
    return I.without_conflicts(f)


@register("k3_generation_sweep", f"WITH d AS (SELECT doc_id, lang AS project, (doc_id % 3)::INT AS generation FROM documents) SELECT doc_id FROM d WHERE generation = CASE project WHEN 'en' THEN 2 ELSE 1 END")
def k3(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "lang AS project", "cast(doc_id % 3 as int) AS generation")
    p = d.select("project").distinct().withColumn("live_generation", F.expr("CASE project WHEN 'en' THEN 2 ELSE 1 END"))
    return I.sweep(d, p).select("doc_id")


_CHANGES = "SELECT o_orderkey AS seq, 'p' || o_custkey AS relative_path, CASE o_orderstatus WHEN 'F' THEN 'added' WHEN 'O' THEN 'modified' ELSE 'removed' END AS change, o_orderdate AS changed_at"
_JOURNAL = f"c AS ({_CHANGES} FROM orders), j AS (SELECT relative_path, arg_max(change, (changed_at, seq)) AS change, max(CASE WHEN change = 'added' THEN changed_at END) AS added_at, max(changed_at) AS changed_at FROM c GROUP BY 1)"


def _journal(spark, sf_dir):
    return I.journal(spark.sql(f"{_CHANGES} FROM {{orders}}", orders=table(spark, sf_dir, "orders")))


@register("r11_change_journal", f"WITH {_JOURNAL} SELECT * FROM j")
def r11(spark, sf_dir):
    return _journal(spark, sf_dir)


@register("d2_q4_whats_new", f"""WITH {_JOURNAL}, k AS (SELECT *, CASE WHEN change = 'removed' AND coalesce(added_at > TIMESTAMP '2001-01-01', false) THEN NULL WHEN change = 'modified' AND coalesce(added_at > TIMESTAMP '2001-01-01', false) THEN 'added' ELSE change END AS reads_as FROM j WHERE changed_at > TIMESTAMP '2001-01-01')
SELECT relative_path, reads_as, changed_at FROM k WHERE reads_as IS NOT NULL ORDER BY changed_at DESC, relative_path LIMIT 50""")
def q4(spark, sf_dir):
    k = I.classify(_journal(spark, sf_dir), F.expr("timestamp_ntz '2001-01-01'"))
    return k.orderBy(F.desc("changed_at"), "relative_path").limit(50).select("relative_path", "reads_as", "changed_at")


@register("f15_text_changed", """SELECT o_orderkey, (o_custkey % 5 <> o_orderkey % 5) AND NOT coalesce(o_orderstatus = left(o_orderpriority, 1) AND o_orderkey % 3 <> 0, false) AS changed FROM orders""")
def f15(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = I.text_changed(F.expr("o_custkey % 5"), F.expr("o_orderkey % 5"), F.col("o_orderstatus"), F.expr("left(o_orderpriority, 1)"), F.expr("o_orderkey % 3 = 0"), F.lit(False))
    return o.select("o_orderkey", c.alias("changed"))


@register("d3_history_start", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP '2001-06-01' ELSE greatest(o_orderdate, TIMESTAMP '1996-01-01', TIMESTAMP '2001-06-01' - INTERVAL 90 DAY) END AS starts FROM orders")
def d3(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    ts = lambda s: F.expr(f"timestamp_ntz '{s}'")
    return o.select("o_orderkey", I.history_starts(F.expr("CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END"), ts("1996-01-01"), ts("2001-06-01")).alias("starts"))


@register("t13_budget_prefix", f"WITH {A.CHUNKS}, r AS (SELECT doc_id, chunk_index, sum(length(content) + 1) OVER w AS run, row_number() OVER w AS i FROM chunks WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index ROWS UNBOUNDED PRECEDING)) SELECT doc_id, chunk_index FROM r WHERE run <= 600 OR i = 1")
def t13(spark, sf_dir):
    c = A.chunks(spark, sf_dir).select("doc_id", "chunk_index", "content")
    return I.budget_prefix(c, ["doc_id"], ["chunk_index"], F.length("content") + 1, 600).select("doc_id", "chunk_index")


@register("k6_export_lines", f"WITH {A.DOCUMENTS}, {A.CHUNKS}, n AS (SELECT doc_id, list({{'chunk_index': chunk_index, 'content': content}} ORDER BY chunk_index) AS chunks FROM chunks GROUP BY 1) SELECT to_json({{'relative_path': relative_path, 'source': source, 'chunks': chunks}})::VARCHAR AS line FROM docs JOIN n USING (doc_id)")
def k6(spark, sf_dir):
    d = A.documents(spark, sf_dir).select("doc_id", "relative_path", "source")
    return I.export(d, A.chunks(spark, sf_dir).select("doc_id", "chunk_index", "content"))


_D = "WITH docs AS (SELECT lang AS project, source, doc_id, concat(source, '/', doc_id, '.md') AS relative_path, text AS content, n_chars FROM {documents})"
_C = "source, doc_id, lang, n_chars FROM {documents}"
sql("s2_extension_filter", "SELECT page_id, url FROM {pages} WHERE regexp_like(lower(url), '[.](html|md|mdx)$')", "SELECT page_id, url FROM pages WHERE regexp_matches(lower(url), '[.](html|md|mdx)$')")
sql("s3_content_hash", "SELECT doc_id, sha2(text, 256) AS content_hash FROM {documents}", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
checked("s6_document_page", f"{_D} SELECT relative_path, source FROM docs WHERE relative_path > 'src11/2' ORDER BY relative_path LIMIT 50", lambda spark, sf_dir: C.page_after(A.documents(spark, sf_dir), "src11/2", 50).select("relative_path", "source"))
checked("s7_point_lookup", f"{_D} SELECT doc_id, content FROM docs WHERE project = 'en' AND relative_path = 'src0/0.md' LIMIT 1", lambda spark, sf_dir: C.lookup(A.documents(spark, sf_dir), "en", "src0/0.md").select("doc_id", "content"))
checked("s8_suffix_lookup", f"{_D} SELECT relative_path FROM (SELECT relative_path, count(*) OVER () AS n FROM docs WHERE suffix(relative_path, '/77.md')) x WHERE n = 1", lambda spark, sf_dir: C.by_suffix(A.documents(spark, sf_dir), "77.md"))
checked("s9_chunk_range", f"WITH {A.CHUNKS} SELECT doc_id, chunk_index, content FROM chunks WHERE chunk_index BETWEEN 1 AND 2 AND starts_with(lower(source), 'src1')", lambda spark, sf_dir: C.chunk_range(A.chunks(spark, sf_dir).filter(F.startswith(F.lower("source"), F.lit("src1"))), 1, 2).select("doc_id", "chunk_index", "content"))
checked("s10_existing_snapshot", f"{_D} SELECT relative_path, md5(content) AS content_hash, source FROM docs WHERE project = 'de'", lambda spark, sf_dir: C.snapshot(A.documents(spark, sf_dir), "de", F.md5("content")))
checked("s26_directory_revision", "SELECT source, concat('files=', count(*), ';newest=', max(doc_id)) AS revision FROM {documents} GROUP BY source", lambda spark, sf_dir: C.directory_revision(table(spark, sf_dir, "documents"), "source", "doc_id"))
checked("f1_tenant_generation", "SELECT doc_id FROM {documents} WHERE lang = 'de' AND doc_id % 2 = 1", lambda spark, sf_dir: C.in_generation(A.documents(spark, sf_dir), "de", 1, F.expr("doc_id % 2")).select("doc_id"))
checked("f2_f3_f4_source_scope_prefix", f"{_D} SELECT doc_id FROM docs WHERE source IN ('src1', 'src10', 'src11') AND starts_with(relative_path, 'src1/')", lambda spark, sf_dir: C.in_scope(A.documents(spark, sf_dir), ["src1", "src10", "src11"], "src1/").select("doc_id"))
checked("f3_empty_scope", "SELECT doc_id FROM {documents} WHERE false", lambda spark, sf_dir: C.in_scope(A.documents(spark, sf_dir), []).select("doc_id"))
sql("f5_version_equality", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_returnflag = 'R' AND l_linestatus = 'F'")
checked("f13_due_for_scan", "SELECT o.o_orderkey FROM {orders} o LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS ruleset, max(l_suppkey) AS h FROM {lineitem} WHERE l_quantity > 30 GROUP BY l_orderkey) s ON s.l_orderkey = o.o_orderkey WHERE s.l_orderkey IS NULL OR s.h <> o.o_custkey % 100 OR s.ruleset < 5", lambda spark, sf_dir: C.due_for_scan(table(spark, sf_dir, "orders").select("o_orderkey", F.expr("o_custkey % 100").alias("content_hash")), table(spark, sf_dir, "lineitem").filter("l_quantity > 30").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").alias("ruleset"), F.max("l_suppkey").alias("content_hash")), "o_orderkey", 5))
@register(
    "f14_unchanged",
    "SELECT doc_id FROM documents WHERE text IS NOT NULL AND doc_id % 3 <> 0 AND (doc_id % 5 <> 0 OR source = 'src1')",
)
def f14(spark, sf_dir):
    """Against a stored generation in which every third text was another and every fifth document stood in src1."""
    d = table(spark, sf_dir, "documents")
    stored = d.select(F.col("doc_id"), F.md5(F.expr("CASE WHEN doc_id % 3 = 0 THEN concat(text, 'x') ELSE text END")).alias("content_hash"), F.expr("CASE WHEN doc_id % 5 = 0 THEN 'src1' ELSE source END").alias("source"))
    return I.unchanged(d.select("doc_id", "source", F.md5("text").alias("content_hash")), stored, "doc_id").select("doc_id")


checked("f16_stale", "SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') > 365 AS stale FROM orders", lambda spark, sf_dir: C.stale(table(spark, sf_dir, "orders"), "o_orderdate", F.lit("2002-01-01").cast("date"), 365).select("o_orderkey", "stale"))
checked("f17_quota", "SELECT s_suppkey, q, q > 0 AND n > q AS breached FROM (SELECT s_suppkey, CAST(coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 7 END, 5) AS INT) AS q, trunc(s_acctbal / 1000)::INT AS n FROM supplier) x", lambda spark, sf_dir: C.quota(table(spark, sf_dir, "supplier"), F.expr("CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey % 7 END"), F.lit(5), F.expr("CAST(s_acctbal / 1000 AS INT)")).select("s_suppkey", "q", "breached"))
sql("j2_page_chain", "SELECT o_orderkey, l_linenumber, c_name FROM (SELECT * FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) p JOIN {lineitem} l ON l.l_orderkey = p.o_orderkey JOIN {customer} c ON c.c_custkey = p.o_custkey")
sql("j3_semi_candidates", "SELECT vec_id FROM {embeddings} e WHERE e.vec_id IN (SELECT doc_id FROM {documents} WHERE source = 'src3')")
checked("j4_top_n_per_config", "SELECT lang, doc_id, n_chars FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM {documents}) x WHERE r <= 50", lambda spark, sf_dir: C.top_each(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), F.col("doc_id")], 50))
sql("j5_config_terms", "SELECT l.lang, t AS term FROM (SELECT DISTINCT lang FROM {documents}) l CROSS JOIN (SELECT explode(array('alpha', 'beta', 'gamma')) AS t) x", "SELECT l.lang, t AS term FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT unnest(['alpha', 'beta', 'gamma']) AS t) x")
sql("j6_range_neighbours", "SELECT a.l_orderkey, a.l_linenumber, count(b.l_linenumber) AS near FROM {lineitem} a LEFT JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber BETWEEN a.l_linenumber - 1 AND a.l_linenumber + 1 AND (b.l_partkey <> a.l_partkey OR b.l_linenumber <> a.l_linenumber) GROUP BY a.l_orderkey, a.l_linenumber")
sql("j7_reattach_page", "SELECT v.ord, n.n_name FROM (SELECT inline(array(struct(1 AS ord, 7 AS k), struct(2 AS ord, 3 AS k), struct(3 AS ord, 19 AS k)))) v JOIN {nation} n ON n.n_nationkey = v.k", "SELECT v.ord, n.n_name FROM (VALUES (1, 7), (2, 3), (3, 19)) v(ord, k) JOIN nation n ON n.n_nationkey = v.k")
checked("j9_journal_live", "SELECT l.doc_id, d.source FROM {labels} l LEFT JOIN (SELECT * FROM {documents} WHERE lang = 'en') d ON d.doc_id = l.doc_id", lambda spark, sf_dir: C.journal_with_live(table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "documents").filter("lang = 'en'"), "doc_id"))
sql("j14_four_way", "SELECT l_orderkey, l_linenumber, n_name FROM {lineitem} l JOIN {orders} o ON o.o_orderkey = l.l_orderkey JOIN {customer} c ON c.c_custkey = o.o_custkey JOIN {nation} n ON n.n_nationkey = c.c_nationkey WHERE l_quantity > 48 AND n_regionkey = 1")
_DEEP = """docs AS (SELECT doc_id, lang, source, concat(source, '/', lang, '/', doc_id % 7, '/', doc_id, '.md') AS relative_path, doc_id % 600 AS changed_at FROM {documents}),
sources AS (SELECT source AS name, min(doc_id) % 500 + 300 AS created_at FROM docs WHERE lang = 'es' GROUP BY source
  UNION ALL SELECT concat(source, '/', lang) AS name, min(doc_id) % 400 + 100 AS created_at FROM docs WHERE lang <> 'en' GROUP BY source, lang
  UNION ALL SELECT concat(source, '/', lang, '/', 3) AS name, 0 AS created_at FROM docs GROUP BY source, lang)"""


@register("j16_prefix_semi", f"WITH {_DEEP.replace('{documents}', 'documents')} SELECT relative_path, changed_at FROM docs d WHERE EXISTS (SELECT 1 FROM sources s WHERE starts_with(d.relative_path, s.name || '/') AND d.changed_at >= s.created_at)")
def j16(spark, sf_dir):
    """Sources of one, two and three segments, those of one name within those of another, each with a time of its own."""
    d = table(spark, sf_dir, "documents")
    docs = spark.sql(f"WITH {_DEEP} SELECT relative_path, changed_at FROM docs", documents=d)
    return I.in_source_scope(docs, spark.sql(f"WITH {_DEEP} SELECT name, created_at FROM sources", documents=d))


sql("j17_relex_config", "SELECT d.doc_id, coalesce(m.cfg, 'simple') AS config FROM {documents} d LEFT JOIN (SELECT lang, concat(lang, '_stem') AS cfg FROM (SELECT DISTINCT lang FROM {documents}) x WHERE lang <> 'en') m ON m.lang = d.lang")
checked("j18_delete_beyond_top", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM {orders}) x WHERE n > 10", lambda spark, sf_dir: C.top_each(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 10, beyond=True).select("o_custkey", "o_orderkey"))
sql("k4_k5_meta_update", "SELECT d.doc_id, coalesce(n.url, concat('old/', d.doc_id)) AS url, CASE WHEN d.source = 'src4' THEN '' ELSE md5(d.text) END AS content_hash FROM {documents} d LEFT JOIN (SELECT page_id, url FROM {pages}) n ON n.page_id = d.doc_id")
checked("a13_recounts", "SELECT lang, source, count(*) AS documents, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS chunks FROM documents GROUP BY lang, source", lambda spark, sf_dir: C.recounts(A.documents(spark, sf_dir), F.size(F.split("content", "\\n"))).withColumnRenamed("project", "lang"))
checked("a14_source_freshness", "SELECT o_orderpriority, min(o_orderdate) AS oldest, CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS never FROM {orders} GROUP BY o_orderpriority", lambda spark, sf_dir: C.freshness(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderdate", F.col("o_orderstatus") == "P"))
sql("a26_distinct_facets", "SELECT DISTINCT lang, source FROM {documents}")
sql("a27_existence_probe", "SELECT count(*) > 0 AS found FROM (SELECT 1 AS one FROM {documents} WHERE lang = 'fr' LIMIT 1) x")
checked("a28_directory_grouping", f"{_D} SELECT regexp_replace(relative_path, '/[^/]*$', '') AS dir, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM docs GROUP BY 1", lambda spark, sf_dir: C.listing(A.documents(spark, sf_dir).withColumn("n_chars", F.length("content")), "n_chars"))
sql("a3_ordered_aggregation", "SELECT n_regionkey, listagg(n_name, ' | ') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ' | ' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
sql("n1_dense_rank_list", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderdate, o_orderkey) AS r FROM {orders}")
sql("n5_competition_rank", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment) AS r FROM {customer}")
sql("t5_top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20")
sql("t15_ceiling", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (ORDER BY source, doc_id) AS r FROM {documents}) x WHERE r <= 300")
checked("u5_distinct_first", "SELECT text, min(doc_id) AS first_id FROM {documents} GROUP BY text", lambda spark, sf_dir: C.first_with_text(table(spark, sf_dir, "documents")))
checked("q13_run_history", "SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM {events} WHERE event_type = 'purchase') x WHERE n = 1", lambda spark, sf_dir: C.top_each(table(spark, sf_dir, "events").filter("event_type = 'purchase'").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 1))
checked("z9_run_summary", "SELECT o_orderkey, greatest(0, o_custkey - o_orderkey % 900) AS updated, greatest(0, trunc(o_totalprice)::BIGINT) AS ms, substring(o_orderpriority, 1, 3) AS error FROM orders", lambda spark, sf_dir: C.run_summary(table(spark, sf_dir, "orders"), "o_custkey", F.expr("o_orderkey % 900"), F.col("o_totalprice"), "o_orderpriority", 3).select("o_orderkey", "updated", "ms", "error"))
checked("z10_interrupted_runs", "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'error' ELSE 'ok' END AS status FROM {labels} UNION ALL SELECT doc_id, 'interrupted' FROM {labels} WHERE doc_id % 10 = 0", lambda spark, sf_dir: C.interrupted(table(spark, sf_dir, "labels"), "doc_id", F.expr("doc_id % 10 = 0")))
sql("z15_relex_due", "SELECT doc_id FROM {documents} WHERE lang IS NULL OR lang IS DISTINCT FROM CASE source WHEN 'src1' THEN 'en' ELSE lang END")
sql("d4_utc_day", "SELECT event_id, date_format(ts, 'yyyy-MM-dd') AS day FROM {events}", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
sql("r7_due_set", "SELECT user_id, max(ts) AS last_at FROM {events} GROUP BY user_id HAVING max(ts) < CAST('2024-01-30 12:00:00' AS TIMESTAMP_NTZ)", "SELECT user_id, max(ts) AS last_at FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 12:00:00'")
