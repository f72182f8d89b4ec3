"""Scalar-function and web queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quern.functions import scalars as S
from quern.operators import web as W
from quern.plans.registry import register
from quern.plans.sqlbook import sql
from quern.sources import files
from quern.session import shared_dir, ship, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@register("x1_normalize_query", r"SELECT conv_id, turn, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS norm FROM conversations")
def x1(spark, sf_dir):
    ship(spark)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.normalize_query(F.col("text")).alias("norm"))


@register("x2_estimate_tokens", "SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def x2(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.estimate_tokens(F.col("text")).alias("tokens"))


@register("x5_title_from_path", "SELECT page_id, upper(substring(w, 1, 1)) || substring(w, 2) AS title FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(url, '([^/]+)$', 1), '[.][^.]+$', ''), '[-_\\s]+', ' ', 'g')) AS w FROM pages)")
def x5(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.title_from_path(F.col("url")).alias("title"))


@register("x6_clean_heading", "SELECT p_partkey, trim(replace(p_name, '`', '')) AS heading FROM part")
def x6(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.clean_heading(F.concat(F.lit("`"), "p_name", F.lit("` {#id-1}"))).alias("heading"))


@register("x7_extension", "SELECT page_id, lower(regexp_extract(url, '[^/.][^/]*[.]([^./]+)$', 1)) AS ext FROM pages")
def x7(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.extension(F.col("url")).alias("ext"))


@register("x8_embedding_text", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source || chr(10) || chr(10) || text ELSE text END AS t FROM documents")
def x8(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return d.select("doc_id", S.embedding_text(F.when(F.expr("doc_id % 2 = 0"), F.col("source")), F.col("text")).alias("t"))


@register("x9_stored_content", "SELECT doc_id, CASE WHEN strlen(text) > 300 THEN (SELECT substring(text, 1, max(n)::INT) FROM range(301) r(n) WHERE strlen(substring(text, 1, n::INT)) <= 300) ELSE text END AS content, strlen(text) > 300 AS truncated FROM documents")
def x9(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", S.stored_content(F.col("text"), 300).alias("s")).select("doc_id", "s.*")


@register("x13_escape_like", r"SELECT p_partkey, replace(replace(replace(p_brand || '%_\', '\', '\\'), '%', '\%'), '_', '\_') AS e FROM part")
def x13(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.escape_like(F.concat("p_brand", F.lit("%_\\"))).alias("e"))


@register("x18_cursor", "SELECT c_custkey, regexp_replace(replace(replace(to_base64(encode(c_name || '??>>' || c_mktsegment)), '+', '-'), '/', '_'), '=+$', '') AS cur, c_name || '??>>' || c_mktsegment AS back FROM customer")
def x18(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", S.cursor(F.concat("c_name", F.lit("??>>"), "c_mktsegment")).alias("cur"))
    return c.withColumn("back", S.from_cursor(F.col("cur")))


@register("x20_slug", "SELECT p_partkey, substring(regexp_replace(regexp_replace(lower(p_name || ' #' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM part")
def x20(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.slug(F.concat("p_name", F.lit(" #"), "p_type")).alias("slug"))


@register("v6_chunk_budget", "SELECT l_orderkey, l_linenumber, greatest(96 - l_linenumber - l_quantity::INT, 16) AS budget FROM lineitem")
def v6(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", S.overlap_budget(F.lit(96), F.col("l_linenumber"), F.col("l_quantity").cast("int")).alias("budget"))


_KEY = bytes.fromhex("00112233445566778899aabbccddeeff").ljust(64, b"\0")
_PADS = [bytes(b ^ x for b in _KEY).hex() for x in (0x36, 0x5C)]


@register("h2_hmac_finding", f"SELECT doc_id, mac, left(mac, 12) AS group_id FROM (SELECT doc_id, sha256(unhex('{_PADS[1]}' || sha256(unhex('{_PADS[0]}' || hex(encode(text)))))) AS mac FROM documents)")
def h2(spark, sf_dir):
    h = S.hmac_sha256("00112233445566778899aabbccddeeff", F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", h.alias("mac"), F.substring(h, 1, 12).alias("group_id"))


@register(
    "h3_fnv1a",
    "SELECT k, printf('%08x', list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(v, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619::UBIGINT) & 4294967295::UBIGINT)) AS h FROM (SELECT p_partkey AS k, p_name || ' ' || p_type || ' ' || p_brand AS v FROM part)",
)
def h3(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), S.fnv1a(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("h"))


@register("h4_source_url", "SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages")
def h4(spark, sf_dir):
    u = F.regexp_replace("url", "^(https?://)", "$1me:pw@")
    return table(spark, sf_dir, "pages").select("page_id", S.source_url(u).alias("u"))


@register("d1_parse_since", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderdate WHEN 1 THEN o_orderdate + INTERVAL 90 MINUTE ELSE NULL END AS since FROM orders""")
def d1(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.expr("o_orderkey % 4")
    t = F.when(text == 0, day).when(text == 1, F.concat(day, F.lit("T01:30:00Z"))).when(text == 2, F.lit("2023-02-30")).otherwise(F.lit("yesterday"))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.parse_since(t).cast("timestamp_ntz").alias("since"))


@register("w1_named_entities", "SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&') AS t FROM pages")
def w1(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", W.decode_named(F.col("html")).alias("t"))


@register("w2_sitemap_entries", "SELECT page_id, url AS loc, CASE WHEN page_id % 2 = 0 THEN '2024-01-05' END AS lastmod FROM pages")
def w2(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    xml = F.concat(F.lit("<urlset><url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc>"), F.when(F.expr("page_id % 2 = 0"), "<lastmod>2024-01-05</lastmod>").otherwise(""), F.lit("</url></urlset>"))
    return p.select("page_id", F.inline(W.sitemap_entries(xml)))


@register("w3_markdown_links", "SELECT page_id, regexp_replace(url, '[)].*$', '') AS links FROM pages")
def w3(spark, sf_dir):
    text = F.concat(F.lit("[a]("), "url", F.lit(") ```\n[b](https://no.example/)\n``` [c]("), "url", F.lit(")"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(W.markdown_links(text), " ").alias("links"))


@register("w4_anchors", "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS href FROM pages")
def w4(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(W.anchors(F.col("html"))).alias("href"))


_HREFS = "a AS (SELECT page_id, url, unnest(list_distinct(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))) AS href FROM pages)"


@register("w5_resolved_links", f"WITH {_HREFS} SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_replace(href, '#.*$', '') AS link FROM a")
def w5(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(W.anchors(F.col("html"))).alias("href"))
    return p.select("page_id", W.resolve(F.col("url"), F.col("href")).alias("link"))


@register("w1_references", "SELECT page_id, 'A' || 'é' || '€' || '😀' || '&#0;&#xD800;&#x110000;&#zz;' || '<' || page_id AS t FROM pages")
def w1_references(spark, sf_dir):
    text = F.concat(F.lit("&#65;&#xe9;&#8364;&#X1F600;&#0;&#xD800;&#x110000;&#zz;&lt;"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", W.decode_references(text).alias("t"))


@register("w5_folded_links", "SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/a/b' || page_id || '?q=..' AS link FROM pages")
def w5_folded(spark, sf_dir):
    """A reference that climbs above the root and back, from every page."""
    ref = F.concat(F.lit("../../../x/.././a/./b"), F.col("page_id").cast("string"), F.lit("?q=..#f"))
    return table(spark, sf_dir, "pages").select("page_id", W.resolve(F.col("url"), ref).alias("link"))


_ROBOTS = [("bot", True, "/"), ("bot", False, "/fr/"), ("bot", True, "/fr/1*"), ("bot", False, "/*.html$")]


@register(
    "w6_robots",
    """WITH p AS (SELECT DISTINCT url, CASE WHEN regexp_replace(url, '^https?://[^/?#]+', '') = '' THEN '/' ELSE regexp_replace(url, '^https?://[^/?#]+', '') END AS path FROM pages)
SELECT url, CASE WHEN regexp_matches(path, '[.]html$') THEN CASE WHEN starts_with(path, '/fr/1') THEN length('/fr/1*') >= length('/*.html$') ELSE false END WHEN starts_with(path, '/fr/1') THEN true WHEN starts_with(path, '/fr/') THEN false ELSE true END AS allowed FROM p""",
)
def w6(spark, sf_dir):
    rules = spark.createDataFrame(_ROBOTS, "agent string, allow boolean, pattern string")
    return W.robots_allowed(table(spark, sf_dir, "pages").select("url", F.lit("bot").alias("agent")).distinct(), rules)


@register(
    "w6_robots_groups",
    """WITH h AS (SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages)
SELECT host, true AS allow, '/' || length(host) AS pattern, 2.5::DOUBLE AS delay FROM h WHERE length(host) % 3 = 0
UNION ALL SELECT host, false, '/fr/', 2.5::DOUBLE FROM h WHERE length(host) % 3 = 0
UNION ALL SELECT host, false, '/all/', NULL::DOUBLE FROM h WHERE length(host) % 3 = 1""",
)
def w6_groups(spark, sf_dir):
    """Each host's robots file by the length of its name: groups for the agent, for any, or for others only."""
    h = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host")).distinct()
    n = F.length("host")
    own = F.concat(F.lit("# site\r\nUser-agent: *\nDisallow: /all/\n\nuser-agent: quern # us\nUser-Agent: other\nAllow: /"), n.cast("string"), F.lit("\nDisallow:\nCrawl-delay: 2.5\nUser-agent: else\nDisallow: /\nUser-agent: QUERN\nDisallow: /fr/\n"))
    body = F.when(n % 3 == 0, own).when(n % 3 == 1, F.lit("User-agent: else\nDisallow: /\nUser-agent: *\nDisallow: /all/\nSitemap: x")).otherwise(F.lit("User-agent: else\nDisallow: /"))
    rules, delays = W.robots_groups(h.withColumn("body", body), "quernbot/1.0")
    return rules.join(delays, "host", "left").select("host", "allow", "pattern", "delay")


@register("w7_has_text", "SELECT page_id, page_id % 3 = 1 AS has FROM pages")
def w7(spark, sf_dir):
    """Pages as they are, pages of which only scripts and comments are left, and pages of tags and spaces."""
    script = F.concat(F.lit("<html><head><title>"), "url", F.lit("</title></head><body><script>"), "url", F.lit("</script><!-- "), "url", F.lit(" --></body></html>"))
    case = F.expr("page_id % 3")
    page = F.when(case == 1, F.col("html")).when(case == 0, script).otherwise(F.concat(F.lit("<div title='"), F.replace("url", F.lit("'"), F.lit("")), F.lit("'> &nbsp;\n</div>")))
    return table(spark, sf_dir, "pages").select("page_id", W.has_text(page).alias("has"))


@register("w8_relative_path", "SELECT page_id, CASE WHEN contains(url, '?') THEN p || '-' || substring(md5(url), 1, 8) ELSE p END AS path FROM (SELECT page_id, url, CASE WHEN q = '' THEN 'index' ELSE q END AS p FROM (SELECT page_id, url, trim(regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '[?#].*$', ''), '/') AS q FROM pages))")
def w8(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", W.relative_path(F.col("url"), F.substring(F.md5("url"), 1, 8)).alias("path"))


@register(
    "w9_crawl_scope",
    """WITH p AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS host, CASE WHEN q = '' THEN '/' ELSE q END AS path FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '^https?://[^/?#]+', ''), '[?#].*$', '') AS q FROM pages))
SELECT a.page_id, b.page_id AS start_id, a.host = b.host AND starts_with(a.path, regexp_replace(b.path, '[^/]*$', '')) AS inside FROM p a JOIN p b ON a.page_id // 5 = b.page_id // 5""",
)
def w9(spark, sf_dir):
    """Pages against the start pages of their five neighbours."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.expr("page_id div 5").alias("g"))
    j = p.join(p.select(F.col("page_id").alias("start_id"), F.col("url").alias("start"), "g"), "g")
    return j.select("page_id", "start_id", W.in_scope(F.col("url"), F.col("start")).alias("inside"))


@register("w11_entry_kind", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'sitemap' WHEN 1 THEN 'llms' WHEN 2 THEN 'sitemap' WHEN 3 THEN 'llms' ELSE 'page' END AS kind FROM pages")
def w11(spark, sf_dir):
    case = F.expr("page_id % 5")
    site = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    url = F.when(case == 0, F.concat(site, F.lit("/Sitemap-1.xml?x"))).when(case == 1, F.concat(site, F.lit("/docs/llms-full.txt"))).when(case == 3, F.concat(site, F.lit("/llms.txt"))).otherwise(F.col("url"))
    body = F.when(case == 2, F.lit("<?xml version='1.0'?><sitemapindex><sitemap/></sitemapindex>")).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", W.entry_kind(url, body).alias("kind"))


@register(
    "w9_crawl_levels",
    """WITH RECURSIVE r AS (SELECT 0 AS n, 0 AS depth UNION ALL SELECT n * 2 + k, depth + 1 FROM r, (VALUES (1), (2)) v(k) WHERE depth < 4 AND n * 2 + k < 25)
SELECT n_name AS url, min(depth) AS depth FROM r JOIN nation ON n_nationkey = n GROUP BY n_name""",
)
def w9b(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    pages = n.select(F.col("n_name").alias("url"))
    parent = n.select(F.col("n_nationkey").alias("pk"), F.col("n_name").alias("src"))
    links = n.filter("n_nationkey > 0").select(((F.col("n_nationkey") - 1) / 2).cast("int").alias("pk"), F.col("n_name").alias("dst")).join(parent, "pk").select("src", "dst")
    return W.crawl(pages, links, n.filter("n_nationkey = 0").select(F.col("n_name").alias("url")), 4)


@register(
    "w9_composed_crawl",
    """WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), r AS (SELECT page_id AS id, 2 AS depth FROM pages WHERE page_id IN (1, 2)
UNION ALL SELECT id * 2 + k, depth + 1 FROM r, n, (VALUES (1), (2)) v(k) WHERE depth < 12 AND id * 2 + k < n.n AND NOT ((id * 2 + k) % 10 = 7 AND (id * 2 + k) % 100 <> 57))
SELECT 'https://site.example/p/' || id AS url, 'page' AS kind, depth FROM r
UNION ALL SELECT * FROM (VALUES ('https://site.example/sitemap.xml', 'sitemap', 0), ('https://site.example/maps/0-sitemap.xml', 'sitemap', 1), ('https://site.example/maps/1-sitemap.xml', 'sitemap', 1))""",
)
def w9_composed(spark, sf_dir):
    """The pages as one site: an index of two sitemaps leads to pages 1 and 2, page i to 2 i + 1 and 2 i + 2 by relative links, and
    robots rules refuse numbers that end in 7 but not in 57."""
    p = table(spark, sf_dir, "pages").select("page_id", "html")
    site = "https://site.example"
    link = lambda k: F.concat(F.lit("<a href=\"../x/./../p/"), F.expr(f"page_id * 2 + {k}").cast("string"), F.lit("#top\">next</a>"))
    off = F.lit("<a href=\"http://other.example/p/3\">away</a>")
    pages = p.select(F.concat(F.lit(f"{site}/p/"), "page_id").alias("url"), F.concat(link(1), off, link(2)).alias("body"))
    loc = lambda u: f"<loc>{u}</loc>"
    maps = [(f"{site}/sitemap.xml", "<sitemapindex>" + "".join(f"<sitemap>{loc(f'{site}/maps/{k}-sitemap.xml')}</sitemap>" for k in (0, 1)) + "</sitemapindex>")]
    maps += [(f"{site}/maps/{k}-sitemap.xml", f"<urlset><url>{loc(f'{site}/p/{k + 1}')}</url><url>{loc(f'{site}/p/&#x31;')}</url></urlset>") for k in (0, 1)]
    bodies = pages.unionByName(spark.createDataFrame(maps, "url string, body string"))
    rules = spark.createDataFrame([("bot", False, "/p/*7$"), ("bot", True, "/p/*57$")], "agent string, allow boolean, pattern string")
    return W.explore(bodies, spark.createDataFrame([(f"{site}/sitemap.xml",)], "url string"), rules, "bot", 12)


sql("w10_conditional_fetch", "SELECT p.page_id, coalesce(md5(p.url) = s.etag, false) AS unchanged FROM {pages} p LEFT JOIN (SELECT page_id, md5(CASE WHEN page_id % 3 = 0 THEN '' ELSE url END) AS etag FROM {pages} WHERE page_id % 2 = 0) s ON s.page_id = p.page_id")
sql("w12_change_token", "SELECT split_part(url, '/', 3) AS host, concat('pages=', count(*), ';newest=', max(page_id)) AS token FROM {pages} GROUP BY 1")
@register(
    "s11_numbered_lines",
    """SELECT doc_id, (doc_id % 3)::INT AS part, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) * 2 AS line_no, n_chars FROM documents""",
)
def s11_lines(spark, sf_dir):
    """Documents as JSON lines in three files, a blank line before each: numbers count the blank ones."""
    base = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr("cast(doc_id % 3 as int)").alias("part"), F.concat(F.lit("\n"), F.to_json(F.struct("doc_id", "n_chars"))).alias("value"))
    d.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(base)
    found = None
    for k in range(3):
        own = files.numbered_lines(spark, f"{base}/part={k}").withColumn("part", F.lit(k))
        found = own if found is None else found.unionByName(own)
    q = F.from_json("value", "doc_id long, n_chars long")
    return found.select(q.getField("doc_id").alias("doc_id"), "part", "line_no", q.getField("n_chars").alias("n_chars"))


sql("s11_ndjson_scan", "SELECT event_id, k FROM (SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events}) x WHERE k < 40", "SELECT event_id, k FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) WHERE k < 40")
sql("z6_nested_questions", "SELECT conv_id, q.turn, q.text FROM (SELECT conv_id, array_sort(collect_list(struct(turn, text))) AS qs FROM {conversations} WHERE role = 'user' GROUP BY conv_id) LATERAL VIEW explode(qs) t AS q", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
sql("c16_thread_render", "SELECT conv_id, array_join(transform(array_sort(collect_list(struct(turn, role, text))), x -> concat('**', x.role, '**: ', x.text)), '\\n\\n') AS body FROM {conversations} WHERE role <> 'system' GROUP BY conv_id", "SELECT conv_id, string_agg('**' || role || '**: ' || text, chr(10) || chr(10) ORDER BY turn, role, text) AS body FROM conversations WHERE role <> 'system' GROUP BY conv_id")
