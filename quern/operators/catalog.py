"""Operators over the document catalogue: lookups and pages, filters, freshness and quotas, counts, run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_after(rows: DataFrame, after: str | None, limit: int, key: str = "relative_path") -> DataFrame:
    """The next `limit` rows by key beyond a cursor (keyset paging): a filter that reaches the scan, and a top-n."""
    rows = rows if after is None else rows.filter(F.col(key) > after)
    return rows.orderBy(key).limit(limit)


def lookup(documents: DataFrame, project: str, path: str) -> DataFrame:
    """The document at a path of a project: one row or none."""
    return documents.filter((F.col("project") == project) & (F.col("relative_path") == path)).limit(1)


def by_suffix(documents: DataFrame, suffix: str) -> DataFrame:
    """relative_path of the only document whose path ends with /suffix; no row if there is none or more than one."""
    hits = documents.filter(F.endswith("relative_path", F.lit(f"/{suffix}")))
    return hits.agg(F.count("*").alias("n"), F.min("relative_path").alias("relative_path")).filter("n = 1").select("relative_path")


def chunk_range(chunks: DataFrame, first: int, last: int) -> DataFrame:
    """Chunks first to last (both included) of each document."""
    return chunks.filter(F.col("chunk_index").between(first, last))


def snapshot(documents: DataFrame, project: str, digest: Column) -> DataFrame:
    """relative_path, content_hash, source of the documents that a project holds now."""
    return documents.filter(F.col("project") == project).select("relative_path", digest.alias("content_hash"), "source")


def directory_revision(files: DataFrame, by: str, newest: str) -> DataFrame:
    """by, revision: number of files and the newest of them, as one token."""
    return files.groupBy(by).agg(F.concat(F.lit("files="), F.count("*").cast("string"), F.lit(";newest="), F.max(newest).cast("string")).alias("revision"))


def in_generation(rows: DataFrame, project: str, generation: int, column: Column) -> DataFrame:
    """Rows of one project and generation: the filter that every read of the index carries."""
    return rows.filter((F.col("project") == project) & (column == generation))


def in_scope(documents: DataFrame, sources: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Documents of some sources (none allowed: no rows) under a path prefix, taken literally."""
    if sources is not None:
        documents = documents.filter(F.col("source").isin(sources)) if sources else documents.filter(F.lit(False))
    return documents if prefix is None else documents.filter(F.startswith("relative_path", F.lit(prefix)))


def due_for_scan(documents: DataFrame, scans: DataFrame, key: str, ruleset: int) -> DataFrame:
    """Documents without a scan, or scanned with another hash or by older rules. documents: key and content_hash."""
    s = scans.select(F.col(key).alias("_k"), F.col("content_hash").alias("_h"), F.col("ruleset").alias("_r"))
    j = documents.join(s, F.col(key) == F.col("_k"), "left")
    return j.filter(F.col("_k").isNull() | (F.col("_h") != F.col("content_hash")) | (F.col("_r") < ruleset)).select(key)


def stale(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """rows plus stale: older than so many days."""
    return rows.withColumn("stale", F.date_diff(now, F.col(at).cast("date")) > days)


def quota(rows: DataFrame, own: Column, instance: Column, used: Column) -> DataFrame:
    """rows plus q (own, else the instance's) and breached; a quota of 0 is no limit."""
    r = rows.withColumn("q", F.coalesce(own, instance).cast("int"))
    return r.withColumn("breached", (F.col("q") > 0) & (used > F.col("q")))


def freshness(rows: DataFrame, by: str, at: str, never: Column) -> DataFrame:
    """by, oldest sync, and how many never synced."""
    return rows.groupBy(by).agg(F.min(at).alias("oldest"), F.count_if(never).alias("never"))


def recounts(documents: DataFrame, chunks: Column) -> DataFrame:
    """Documents and chunks per project and source."""
    return documents.groupBy("project", "source").agg(F.count("*").alias("documents"), F.sum(chunks).cast("long").alias("chunks"))


def listing(documents: DataFrame, size: str) -> DataFrame:
    """dir, documents, chars: what lies in each directory."""
    d = documents.withColumn("dir", F.regexp_replace("relative_path", "/[^/]*$", ""))
    return d.groupBy("dir").agg(F.count("*").alias("documents"), F.sum(size).cast("long").alias("chars"))


def top_each(rows: DataFrame, by: list[str], order: list[Column], n: int, beyond: bool = False) -> DataFrame:
    """The first n rows of each group in an order; with beyond, those after them. n is cut before the shuffle."""
    r = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return r.filter(F.col("_n") > n if beyond else F.col("_n") <= n).drop("_n")


def journal_with_live(journal: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Every journal row with the source of its document, null if that is gone."""
    return journal.join(live.select(key, "source"), key, "left")


def run_summary(runs: DataFrame, total: str, skipped: Column, ms: Column, error: str, most: int) -> DataFrame:
    """updated and ms never below 0, the error cut to a length."""
    zero = F.lit(0)
    return runs.withColumns({"updated": F.greatest(zero, F.col(total) - skipped), "ms": F.greatest(zero.cast("long"), ms.cast("long")), "error": F.substring(error, 1, most)})


def interrupted(runs: DataFrame, key: str, running: Column) -> DataFrame:
    """key, status of every run, and one more row `interrupted` for each that was left running."""
    done = runs.select(key, F.when(running, "error").otherwise("ok").alias("status"))
    return done.unionByName(runs.filter(running).select(key, F.lit("interrupted").alias("status")))


def first_with_text(documents: DataFrame) -> DataFrame:
    """Each distinct text with the smallest id that has it."""
    return documents.groupBy("text").agg(F.min("doc_id").alias("first_id"))
