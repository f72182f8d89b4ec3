"""Upkeep of projects and sources: what an export leaves out, who needs a new index, whose turn it is, what an origin said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def excluded_counts(projects: DataFrame, tables: dict[str, DataFrame], hits: DataFrame, queries: str, members: DataFrame, roles: list[str]) -> DataFrame:
    """project, what, n: how many rows of each table (with a column project), of the hits of its queries (query_id) and of the members
    of each role an export of a project leaves out. Every count stands for every project, 0 included. Each table is counted on
    its own before the union; hits are counted by query before the join."""
    per = [t.groupBy("project").agg(F.count("*").alias("n")).withColumn("what", F.lit(name)) for name, t in tables.items()]
    of_query = hits.groupBy("query_id").agg(F.count("*").alias("_n")).join(tables[queries].select("query_id", "project"), "query_id")
    per.append(of_query.groupBy("project").agg(F.sum("_n").alias("n")).withColumn("what", F.lit(f"{queries}_hits")))
    per.append(members.filter(F.col("role").isin(roles)).groupBy("project", F.concat(F.lit("members:"), "role").alias("what")).agg(F.count("*").alias("n")))
    counts = per[0].select("project", "what", "n")
    for p in per[1:]:
        counts = counts.unionByName(p.select("project", "what", "n"))
    names = [*tables, f"{queries}_hits", *[f"members:{r}" for r in roles]]
    every = projects.select("project").distinct().select("project", F.explode(F.array(*[F.lit(n) for n in names])).alias("what"))
    return every.join(counts, ["project", "what"], "left").select("project", "what", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def needing_reindex(projects: DataFrame, sources: DataFrame, model: str) -> DataFrame:
    """project, indexed_with of projects indexed with another model that have a source; never indexed ones have nothing stale."""
    p = projects.filter(F.col("model").isNotNull() & (F.col("model") != model)).select("project", F.col("model").alias("indexed_with"))
    return p.join(sources.select("project").distinct(), "project", "left_semi")


def due_sources(sources: DataFrame, now: Column, limit: int | None = None) -> DataFrame:
    """Sources whose time has come, oldest claim first (claim: the earlier of the schedule and a webhook's time; a scheduled source
    without a time yet is first of all, its claim null). sources: source, interval, next_at, webhook_at. Without a limit unordered."""
    scheduled = F.col("interval").isNotNull()
    due = (scheduled & (F.col("next_at").isNull() | (F.col("next_at") <= now))) | (F.col("webhook_at") <= now)
    claim = F.when(scheduled & F.col("next_at").isNull(), None).otherwise(F.least(F.when(scheduled, F.col("next_at")), F.col("webhook_at")))
    s = sources.filter(F.coalesce(due, F.lit(False))).withColumn("claim", claim)
    return s if limit is None else s.orderBy(F.col("claim").asc_nulls_first(), "source").limit(limit)


def past_skip_age(last: Column, hours: int, now: Column) -> Column:
    """Whether an unchanged probe may no longer skip a source: never synced, or longer ago than the age. 0 hours: never."""
    return F.lit(False) if hours <= 0 else F.coalesce(last < now - F.expr(f"INTERVAL {hours} HOURS"), F.lit(True))


def plausible_date(at: Column, now: Column) -> Column:
    """A date that an origin reported; null at or before the epoch and more than a day ahead."""
    return F.when((at > F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")) & (at <= now + F.expr("INTERVAL 24 HOURS")), at)


def stored_meta(rows: DataFrame) -> DataFrame:
    """doc_id, url, modified_at to store. rows: doc_id, answered (the driver gave an answer), url, modified_at, stamp (the date is the
    moment of observation), old_url, old_modified_at, known (stored before), changed (the text). No answer keeps what is stored; an
    answer holds, nulls too, but a stamp on an unchanged text fills only a date that was null. Only http(s) addresses are kept."""
    answered = F.coalesce("answered", F.lit(False))
    url = F.when(F.col("url").rlike("(?i)^https?://"), F.col("url"))
    held = F.coalesce(F.col("stamp") & ~F.col("changed") & F.col("known"), F.lit(False))
    date = F.when(held, F.coalesce("old_modified_at", "modified_at")).otherwise(F.col("modified_at"))
    return rows.select("doc_id", F.when(answered, url).otherwise(F.col("old_url")).alias("url"), F.when(answered, date).otherwise(F.col("old_modified_at")).alias("modified_at"))


def relex_due(chunks: DataFrame, sources: DataFrame, known: list[str]) -> DataFrame:
    """chunk_id, config of the chunks (chunk_id, source, config) whose configuration is not that of their source: its language where
    that is a known one, else `simple`. Chunks of no source are left alone. Only these are stemmed again."""
    want = F.when(F.col("language").isin(known), F.col("language")).otherwise("simple")
    s = sources.select("source", want.alias("_want"))
    return chunks.join(s, "source").filter(~F.col("config").eqNullSafe(F.col("_want"))).select("chunk_id", F.col("_want").alias("config"))


# Methods that count against no limit.
EXEMPT = ["initialize", "ping"]


def message_cost(requests: DataFrame, tools: list[str]) -> DataFrame:
    """request_id, what (`requests`, or the name of a tool), cost: what each request body (JSON, one message or an array) costs. A
    message counts if it has a method as text and an id (null too), is neither exempt nor a notification; a call of a tool counts
    for the tool besides. Bodies that are not JSON and costs of 0 give no row."""
    body = F.trim("body")
    all_of = F.from_json(F.when(F.startswith(body, F.lit("[")), body).otherwise(F.concat(F.lit("["), body, F.lit("]"))), "array<string>")
    m = requests.select("request_id", F.explode(all_of).alias("m")).filter(F.startswith(F.ltrim("m"), F.lit("{")))
    v = F.try_parse_json("m")

    def text(path: str) -> Column:
        return F.when(F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING", F.try_variant_get(v, path, "string"))

    m = m.select("request_id", text("$.method").alias("method"), text("$.params.name").alias("tool"), F.json_object_keys("m").alias("keys"))
    m = m.filter(F.col("method").isNotNull() & F.array_contains("keys", "id") & ~F.col("method").isin(EXEMPT) & ~F.startswith("method", F.lit("notifications/")))
    call = (F.col("method") == "tools/call") & F.col("tool").isin(tools)
    what = F.array_compact(F.array(F.lit("requests"), F.when(call, F.col("tool"))))
    return m.select("request_id", F.explode(what).alias("what")).groupBy("request_id", "what").agg(F.count("*").alias("cost"))


def limit_checks(requests: DataFrame, costs: DataFrame, identified: int, anonymous: int, by_tool: dict[str, int]) -> DataFrame:
    """request_id, key, limit, cost: the counters that each request (request_id, token, open, project, address_key) is held against.
    A request with a token has its own counter, one without that of its address, in an open project only; a tool with a limit has
    one below that. A limit of 0 is off."""
    base = F.when(F.col("token").isNotNull(), F.concat(F.lit("tok:"), F.col("token").cast("string")))
    base = base.when(F.col("open"), F.concat(F.lit("ip:"), F.col("project").cast("string"), F.lit(":"), F.coalesce("address_key", F.lit("unknown"))))
    own = F.when(F.col("token").isNotNull(), F.lit(identified)).otherwise(F.lit(anonymous))
    tool = F.create_map(*[x for k, v in by_tool.items() for x in (F.lit(k), F.lit(v))]) if by_tool else F.expr("map_from_arrays(cast(array() as array<string>), cast(array() as array<int>))")
    j = costs.join(requests.select("request_id", base.alias("_base"), own.alias("_own")).filter("_base IS NOT NULL"), "request_id")
    whole = F.col("what") == "requests"
    limit = F.when(whole, F.col("_own")).otherwise(F.coalesce(F.try_element_at(tool, F.col("what")), F.lit(0)))
    key = F.when(whole, F.col("_base")).otherwise(F.concat("_base", F.lit(":tool:"), "what"))
    return j.select("request_id", key.alias("key"), limit.cast("int").alias("limit"), "cost").filter(F.col("limit") > 0)
