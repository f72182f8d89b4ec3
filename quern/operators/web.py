"""Web operators over pages: entities, sitemaps, links, robots, scope and frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The named references that feeds use.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def decode_named(text: Column) -> Column:
    """The six named references; the ampersand last, so that nothing is decoded twice."""
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def decode_references(text: Column) -> Column:
    """Decimal, hexadecimal and the six named references; those of no character (zero, surrogates, beyond the last) stay."""
    parts = F.split(text, "&#")

    def one(s: Column) -> Column:
        code = F.conv(F.regexp_extract(s, r"^[xX]([0-9a-fA-F]{1,6});", 1), 16, 10)
        n = F.coalesce(F.nullif(F.regexp_extract(s, r"^([0-9]{1,7});", 1), F.lit("")), code).cast("int")
        ok = s.rlike(r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});") & (n > 0) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(ok, n).otherwise(F.lit(63))), 8, "0")), "UTF-32")
        return F.when(ok, F.concat(char, F.regexp_replace(s, r"^[^;]*;", ""))).otherwise(F.concat(F.lit("&#"), s))

    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one)
    return decode_named(F.concat(F.get(parts, F.lit(0)), F.array_join(rest, "")))


def fold_dots(url: Column) -> Column:
    """The URL with the dot segments of its path folded: a stack of segments, in one pass. Above the root there is nothing."""
    path = F.regexp_extract(url, r"^https?://[^/?#]*([^?#]*)", 1)
    steps = F.slice(F.split(path, "/"), F.lit(2), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    push = lambda s, x: F.when(x == ".", s).when(x == "..", F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(x)))
    folded = F.array_join(F.aggregate(steps, F.lit([]).cast("array<string>"), push), "/")
    open_end = F.when(path.rlike(r"/\.{1,2}$") & (folded != ""), "/").otherwise("")
    out = F.concat(F.regexp_extract(url, r"^(https?://[^/?#]*)", 1), F.lit("/"), folded, open_end, F.regexp_extract(url, r"^[^?#]*(.*)$", 1))
    return F.when(path.rlike(r"/\.{1,2}(/|$)"), out).otherwise(url)


def sitemap_entries(xml: Column) -> Column:
    """Array of struct(loc, lastmod) of a sitemap or sitemap index."""
    blocks = F.regexp_extract_all(xml, F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1))
    return F.transform(blocks, lambda b: F.struct(decode_references(F.trim(F.regexp_extract(b, r"(?s)<loc>(.*?)</loc>", 1))).alias("loc"), F.nullif(F.trim(F.regexp_extract(b, r"(?s)<lastmod>(.*?)</lastmod>", 1)), F.lit("")).alias("lastmod")))


def markdown_links(text: Column) -> Column:
    """Targets of Markdown links outside fences, first seen first, distinct."""
    plain = F.regexp_replace(text, r"(?s)```.*?(?:```|$)", "")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(r"\[[^\]]*\]\((https?://[^)\s]+)\)"), F.lit(1)))


def anchors(html: Column) -> Column:
    """href values of anchors outside comments, decoded, first seen first, distinct."""
    plain = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(r"""<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""), F.lit(1)), decode_named))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def resolve(base: Column, ref: Column) -> Column:
    """An http(s) URL without fragment from an absolute, host-relative, root-relative or path-relative reference, its dot
    segments folded. Null for other schemes."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    r = F.regexp_replace(ref, r"#.*$", "")
    out = (
        F.when(r.rlike(r"^https?://"), r)
        .when(r.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
        .when(r.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), r))
        .when(r.startswith("/"), F.concat(origin, r))
        .when(r == "", F.regexp_replace(base, r"#.*$", ""))
        .when(r.startswith("?"), F.concat(F.regexp_replace(base, r"[?#].*$", ""), r))
        .otherwise(F.concat(folder, F.lit("/"), r))
    )
    return fold_dots(out)


def has_text(html: Column) -> Column:
    """Whether anything but markup, scripts and styles is left."""
    t = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return F.length(F.regexp_replace(t, r"\s|&nbsp;", "")) > 0


def relative_path(url: Column, suffix: Column) -> Column:
    """The path of a URL as a file path; a query adds its hash."""
    p = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"^https?://[^/?#]+", ""), r"[?#].*$", ""), r"^/+|/+$", "")
    p = F.when(p == "", F.lit("index")).otherwise(p)
    return F.when(url.contains("?"), F.concat(p, F.lit("-"), suffix)).otherwise(p)


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, allowed: the longest matching rule of the agent's group decides, allow wins ties, no match allows.

    rules: agent, allow (boolean), pattern with * and a final $. They are few: broadcast only below a checked count.
    """
    body = F.regexp_replace(F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1"), r"\*", ".*")
    regex = F.concat(F.lit("^"), F.when(F.col("pattern").endswith("$"), body).otherwise(F.concat(body, F.lit(".*"))))
    r = rules.select("agent", "allow", F.length("pattern").alias("_n"), regex.alias("_re"))
    r = F.broadcast(r) if r.limit(100_001).count() <= 100_000 else r
    path = F.regexp_replace("url", r"^https?://[^/?#]+", "")
    m = urls.withColumn("_path", F.when(path == "", "/").otherwise(path)).join(r, "agent", "left").filter(F.col("_re").isNull() | F.expr("_path rlike _re"))
    best = m.groupBy("url").agg(F.max_by("allow", F.struct("_n", "allow")).alias("_a"))
    return urls.select("url").distinct().join(best, "url", "left").select("url", F.coalesce("_a", F.lit(True)).alias("allowed"))


def robots_groups(files: DataFrame, agent: str) -> tuple[DataFrame, DataFrame]:
    """(host, allow, pattern) and (host, delay in seconds) of the groups of robots files (host, body) that speak to an agent.

    Lines in a row that name agents begin a group. Groups of the longest name that the agent's begins with hold, all of them
    together; without one those of `*`; without these nothing is refused. Names and keys in any case; comments, empty rules and
    lines of other keys are passed over; of several delays the longest holds. A file's lines are put in order in a task of
    their own. Null bodies and repeated hosts: as one file with no lines, or the lines of all."""
    lines = files.select("host", F.posexplode(F.split(F.coalesce("body", F.lit("")), r"\r\n?|\n")).alias("_i", "_l"))
    text = F.trim(F.regexp_replace("_l", "#.*$", ""))
    kv = lines.withColumn("_k", F.lower(F.regexp_extract(text, r"^([A-Za-z-]+)\s*:", 1))).withColumn("_v", F.trim(F.regexp_replace(text, r"^[A-Za-z-]+\s*:", "")))
    kv = kv.filter(F.col("_k").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = Window.partitionBy("host").orderBy("_i")
    starts = (F.col("_k") == "user-agent") & (F.coalesce(F.lag("_k").over(w), F.lit("")) != "user-agent")
    kv = kv.withColumn("_s", starts.cast("int")).withColumn("_g", F.sum("_s").over(w))
    name = F.lower("_v")
    mine = F.when(F.startswith(F.lit(agent.lower()), name) & (name != ""), F.length("_v")).when(name == "*", F.lit(0))
    named = kv.filter("_k = 'user-agent'").withColumn("_n", mine).filter("_n IS NOT NULL").groupBy("host", "_g").agg(F.max("_n").alias("_n"))
    best = named.withColumn("_best", F.max("_n").over(Window.partitionBy("host"))).filter("_n = _best").select("host", "_g")
    held = kv.filter("_k <> 'user-agent'").join(best, ["host", "_g"])
    rules = held.filter("_k IN ('allow', 'disallow') AND _v <> ''").select("host", (F.col("_k") == "allow").alias("allow"), F.col("_v").alias("pattern"))
    delays = held.filter("_k = 'crawl-delay'").select("host", F.expr("try_cast(_v AS double)").alias("delay")).groupBy("host").agg(F.max("delay").alias("delay")).filter("delay IS NOT NULL")
    return rules, delays


def authority(url: Column) -> Column:
    """Host and port of an http(s) URL, without the scheme's own port."""
    named = F.lower(F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?([^/?#]+)", 1))
    return F.regexp_replace(named, F.when(F.startswith(F.lower(url), F.lit("https")), F.lit(":443$")).otherwise(F.lit(":80$")), F.lit(""))


def url_path(url: Column) -> Column:
    """The path of an absolute URL, without query and fragment; / where it has none."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"(?s)[?#].*$", "")
    return F.when(path == "", F.lit("/")).otherwise(path)


def in_scope(url: Column, root: Column) -> Column:
    """Same host, and below the directory of the root; a site over http and over https is one site."""
    return (authority(url) == authority(root)) & url_path(url).startswith(F.regexp_replace(url_path(root), r"[^/]*$", ""))


def crawl(pages: DataFrame, links: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """url and depth of pages reached from the roots by links in breadth-first order. Each level is one join with the
    level before and one anti join with what was seen; levels are cut in shared storage."""
    from quern.session import cut

    level = cut(pages.join(roots.select("url").distinct(), "url", "left_semi").select("url", F.lit(0).alias("depth")), "crawl")
    seen = level
    for d in range(1, depth + 1):
        nxt = links.join(level.select(F.col("url").alias("src")), "src").select(F.col("dst").alias("url")).distinct()
        level = cut(nxt.join(seen.select("url"), "url", "left_anti").join(pages.select("url").distinct(), "url", "left_semi").select("url", F.lit(d).alias("depth")), "crawl")
        if level.isEmpty():
            break
        seen = cut(seen.unionByName(level), "crawl")
    return seen


def entry_kind(url: Column, body: Column) -> Column:
    low = F.lower(url)
    return F.when(low.rlike(r"sitemap[^/]*\.xml(\?|$)") | body.rlike(r"<(urlset|sitemapindex)\b"), "sitemap").when(low.rlike(r"/llms(-full)?\.txt(\?|$)"), "llms").otherwise("page")


def explore(bodies: DataFrame, entries: DataFrame, rules: DataFrame, agent: str, depth: int) -> DataFrame:
    """url, kind, depth of what a crawl from the entries meets: a sitemap leads to its locations (other sitemaps among them), a list
    for models to its links, a page to its anchors.

    bodies: url, body of what can be fetched; entries: url; rules as in robots_allowed(). Links are resolved against their page,
    dot segments folded, fragments dropped; those outside the entry's scope, refused to the agent, not to be fetched or met
    before are left. Each level joins only what the level before found, and is written: no level is computed twice. A page that
    several entries lead to belongs to the first (by url)."""
    from quern.session import cut

    wanted = entries.select("url").distinct()
    level = cut(bodies.join(wanted, "url").select("url", F.col("url").alias("_root"), entry_kind(F.col("url"), F.col("body")).alias("kind"), "body", F.lit(0).alias("depth")), "explore")
    seen = level.select("url", "kind", "depth")
    for d in range(1, depth + 1):
        to = F.when(F.col("kind") == "sitemap", F.transform(sitemap_entries(F.col("body")), lambda e: e["loc"])).when(F.col("kind") == "llms", markdown_links(F.col("body"))).otherwise(anchors(F.col("body")))
        links = level.select("_root", "url", F.explode(to).alias("_href")).select("_root", resolve(F.col("url"), F.col("_href")).alias("url"))
        # a page that is linked everywhere is met once for each root before it is shuffled to its body
        links = links.filter(F.col("url").isNotNull() & in_scope(F.col("url"), F.regexp_replace("_root", "[^/]*$", ""))).groupBy("url").agg(F.min("_root").alias("_root"))
        new = cut(links.join(seen.select("url"), "url", "left_anti"), "explore-links")
        if new.isEmpty():
            break
        allowed = robots_allowed(new.select("url", F.lit(agent).alias("agent")), rules).filter("allowed").select("url")
        level = cut(bodies.join(new.join(allowed, "url", "left_semi"), "url").select("url", "_root", entry_kind(F.col("url"), F.col("body")).alias("kind"), "body", F.lit(d).alias("depth")), "explore")
        seen = cut(seen.unionByName(level.select("url", "kind", "depth")), "explore-seen")
    return seen
