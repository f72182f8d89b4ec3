"""Incremental indexing: snapshots, diffs, generations, the change journal, export and import."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_path(path: Column) -> Column:
    """Slashes forward, no leading `./` or `/`; null if the result is empty or has an empty, `.` or `..` segment."""
    p = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"^(?:\./|/)+", "")
    bad = F.exists(F.split(p, "/"), lambda s: s.isin("", ".", ".."))
    return F.when(~bad, p)


def key_fault(key: Column) -> Column:
    """folder-marker for keys that end in a slash, unsafe-name for those that do not clean to themselves; else null."""
    return F.when(key.endswith("/"), "folder-marker").when(clean_path(key).isNull() | (clean_path(key) != key), "unsafe-name")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str = "relative_path", hash_col: str = "content_hash") -> DataFrame:
    """key and change (added, removed, modified, unchanged): a full outer join of two generations."""
    o = old.select(F.col(key), F.col(hash_col).alias("_o"))
    n = new.select(F.col(key), F.col(hash_col).alias("_n"))
    change = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("_o") != F.col("_n"), "modified").otherwise("unchanged")
    return o.join(n, key, "full_outer").select(key, change.alias("change"))


def text_changed(old_hash, new_hash, old_text, new_text, old_cut, new_cut) -> Column:
    """The hash differs, and it is not so that both texts are known, untruncated and equal."""
    same = old_text.isNotNull() & new_text.isNotNull() & ~old_cut & ~new_cut & (old_text == new_text)
    return (old_hash != new_hash) & ~F.coalesce(same, F.lit(False))


def revision(files: DataFrame) -> DataFrame:
    """SHA-256 over the sorted lines key TAB version TAB size, and the number of files. The lines of one source tree meet
    in one row by definition of the token."""
    line = F.concat_ws("\t", "key", "version", F.col("size").cast("string"))
    return files.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("token"), F.count("*").alias("files"))


def without_conflicts(files: DataFrame, key: str = "key") -> DataFrame:
    """Files none of whose ancestors is a file itself: ancestors are exploded and anti-joined, no prefix scan."""
    parts = F.split(key, "/")
    up = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    a = files.filter(F.size(parts) > 1).select(F.col(key).alias("_child"), F.explode(up).alias(key))
    bad = a.join(files.select(key), key, "left_semi").select(F.col("_child").alias(key)).distinct()
    return files.join(bad, key, "left_anti")


def unchanged(new: DataFrame, stored: DataFrame, key: str = "relative_path") -> DataFrame:
    """The new documents whose stored version has the same content_hash and the same source: a join on the path, so that equal
    texts elsewhere do not count. A null hash equals nothing, a null source a null source."""
    old = stored.select(F.col(key).alias("_k"), F.col("content_hash").alias("_h"), F.col("source").alias("_s"))
    same = (F.col(key) == F.col("_k")) & (F.col("content_hash") == F.col("_h")) & F.col("source").eqNullSafe(F.col("_s"))
    return new.join(old, same, "left_semi")


def in_source_scope(changes: DataFrame, sources: DataFrame) -> DataFrame:
    """The changes (relative_path, changed_at) under the name of some source (name, created_at), made when it was there already.

    Each path is looked up by its own ancestors, of which it has as many as segments, and keeps the earliest time of those that
    are sources: equal keys meet, no prefix is compared with every path. Names may have several segments and lie within
    each other. Null paths and times match nothing; an empty name no path."""
    parts = F.split("relative_path", "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    paths = changes.select("relative_path").distinct().filter(F.size(parts) > 1).select("relative_path", F.explode(up).alias("name"))
    named = sources.filter("name <> ''").groupBy("name").agg(F.min("created_at").alias("_since"))
    since = paths.join(named, "name").groupBy("relative_path").agg(F.min("_since").alias("_since"))
    return changes.join(since, "relative_path").filter("changed_at >= _since").drop("_since").select(*changes.columns)


def upsert(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new rows, and current rows whose key has no new one."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def sweep(documents: DataFrame, pointers: DataFrame) -> DataFrame:
    """Documents of each project's live generation."""
    return documents.join(pointers, "project").filter(F.col("generation") == F.col("live_generation")).drop("live_generation")


def missing(stored: DataFrame, seen: DataFrame, protected: DataFrame, key: str = "relative_path") -> DataFrame:
    """Stored paths that were not seen, but for those of protected sources."""
    return stored.join(seen.select(key).distinct(), key, "left_anti").join(protected.select("source").distinct(), "source", "left_anti")


def journal(changes: DataFrame) -> DataFrame:
    """The latest change of each path, with the time it was last added (last writer wins)."""
    at = F.struct("changed_at", "seq")
    return changes.groupBy("relative_path").agg(F.max_by("change", at).alias("change"), F.max(F.when(F.col("change") == "added", F.col("changed_at"))).alias("added_at"), F.max("changed_at").alias("changed_at"))


def classify(rows: DataFrame, since: Column) -> DataFrame:
    """Changes strictly after since: added then removed inside the window is hidden, added then modified reads as added."""
    inside = F.coalesce(F.col("added_at") > since, F.lit(False))
    kind = F.when((F.col("change") == "removed") & inside, None).when((F.col("change") == "modified") & inside, "added").otherwise(F.col("change"))
    return rows.filter(F.col("changed_at") > since).withColumn("reads_as", kind).filter("reads_as IS NOT NULL")


def history_starts(tracking: Column, created: Column, now: Column, days: int = 90) -> Column:
    """The latest of tracking start, creation and the retention horizon; now if nothing is tracked."""
    return F.when(tracking.isNull(), now).otherwise(F.greatest(tracking, created, now - F.expr(f"INTERVAL {days} DAYS")))


def budget_prefix(rows: DataFrame, by: list[str], order: list[str], size: Column, budget: int) -> DataFrame:
    """Of each group the first rows whose running size stays within the budget; the first row is always kept."""
    w = Window.partitionBy(*by).orderBy(*order)
    run = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_run", run).withColumn("_i", F.row_number().over(w)).filter((F.col("_run") <= budget) | (F.col("_i") == 1)).drop("_run", "_i")


def export(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One JSON line per document with its chunks nested in order."""
    nested = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("chunks"))
    return documents.join(nested, "doc_id", "left").select(F.to_json(F.struct("relative_path", "source", F.coalesce("chunks", F.array()).alias("chunks"))).alias("line"))
