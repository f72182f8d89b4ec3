"""The newest state of every path under a stream of changes: deltas with tombstones, compacted into snapshots.

A batch writes what changed as one delta folder, and every COMPACT_EVERY batches the deltas since the last snapshot are
merged into a new one, without what was removed; the commit marker that names the new snapshot comes last. So a batch reads
one snapshot and a bounded number of deltas, however many batches there were, and of those only the buckets of the sources
and paths that it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.streaming.commits import Commits

SOURCE_BUCKETS, PATH_BUCKETS = 16, 16
COMPACT_EVERY = 8
STATE = "source string, relative_path string, content_hash string, deleted boolean, kind string, n long, sb int, pb int"


def _bucketed(rows: DataFrame) -> DataFrame:
    sb = F.pmod(F.xxhash64("source"), F.lit(SOURCE_BUCKETS)).cast("int")
    return rows.withColumn("sb", sb).withColumn("pb", F.pmod(F.xxhash64("relative_path"), F.lit(PATH_BUCKETS)).cast("int"))


def folders(commits: Commits, marker: tuple[int, ...] | None) -> list[str]:
    """The folders that hold the state of a committed epoch."""
    if marker is None:
        return []
    n, base = marker[0], marker[1] - 1  # the note is the epoch of the snapshot plus one; 0: none yet
    out = [f"{commits.path}/state/kind=snapshot/n={base}"] if base >= 0 else []
    out += [f"{commits.path}/state/kind=delta/n={c[0]}" for c in commits.all() if base < c[0] <= n]
    return [f for f in out if commits.exists(f[len(commits.path) + 1 :])]


def state_at(commits: Commits, marker: tuple[int, ...] | None) -> DataFrame:
    """All versions in these folders; latest() picks the newest of each path. Filters on sb and pb prune folders."""
    spark = commits.spark
    where = folders(commits, marker)
    if not where:
        return spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).option("basePath", f"{commits.path}/state").parquet(*where)


def latest(versions: DataFrame) -> DataFrame:
    """source, relative_path, content_hash of the paths that are not removed."""
    new = versions.groupBy("source", "relative_path").agg(F.max_by(F.struct("content_hash", "deleted"), "n").alias("_x"))
    return new.filter("NOT _x.deleted").select("source", "relative_path", F.col("_x.content_hash").alias("content_hash"))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The state as last committed."""
    commits = Commits(spark, path)
    return latest(state_at(commits, max(commits.all(), default=None)))


def changes(known: DataFrame, new: DataFrame, complete: bool) -> DataFrame:
    """source, relative_path, content_hash, change (added, modified, removed) between a state and a batch (with deleted).

    complete: the batch lists its sources completely, so what the state has of them beyond it is removed."""
    k = known.withColumnRenamed("content_hash", "_known")
    j = k.join(new, ["source", "relative_path"], "full_outer")
    gone = F.col("deleted") if not complete else F.coalesce(F.col("deleted"), F.lit(True))
    kind = F.when(F.col("_known").isNull() & ~F.col("deleted"), "added").when(F.col("_known").isNotNull() & gone, "removed").when(F.col("_known") != F.col("content_hash"), "modified")
    return j.select("source", "relative_path", "content_hash", kind.alias("change")).filter("change IS NOT NULL")


def apply_batch(batch: DataFrame, n: int, path: str, complete: bool = False, compact_every: int = COMPACT_EVERY) -> None:
    """Batch n of (relative_path, content_hash, and source and deleted where there are such): journal, delta, now and then a
    snapshot, then the marker. A path that comes twice counts once: with the larger hash, removed only if all its rows say so."""
    commits = Commits(batch.sparkSession, path)
    if commits.has(n):
        return
    before = commits.before(n)
    base = before[1] - 1 if before else -1
    source = F.coalesce(F.col("source"), F.lit("")) if "source" in batch.columns else F.lit("")
    gone = F.coalesce(F.col("deleted"), F.lit(False)) if "deleted" in batch.columns else F.lit(False)
    rows = batch.select(source.alias("source"), "relative_path", F.coalesce("content_hash", F.lit("")).alias("content_hash"), gone.alias("deleted")).filter("relative_path IS NOT NULL")
    new = _bucketed(rows.groupBy("source", "relative_path").agg(F.max("content_hash").alias("content_hash"), F.bool_and("deleted").alias("deleted"))).persist()
    try:
        versions = state_at(commits, before)
        buckets = new.select("sb", "pb").distinct().collect()  # SOURCE_BUCKETS * PATH_BUCKETS rows at most
        versions = versions.filter(F.col("sb").isin([r.sb for r in buckets]))
        if complete:
            versions = versions.join(new.select("source").distinct(), "source", "left_semi")
        else:
            versions = versions.filter(F.col("pb").isin([r.pb for r in buckets])).join(new.select("source", "relative_path"), ["source", "relative_path"], "left_semi")
        changed = changes(latest(versions), new.drop("sb", "pb"), complete).persist()
        try:
            changed.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{path}/journal/n={n}")
            delta = _bucketed(changed.select("source", "relative_path", "content_hash", (F.col("change") == "removed").alias("deleted")))
            delta.write.mode("overwrite").partitionBy("sb", "pb").parquet(f"{path}/state/kind=delta/n={n}")
        finally:
            changed.unpersist()
        if n - base >= compact_every:
            delta = batch.sparkSession.read.schema(STATE).option("basePath", f"{path}/state").parquet(f"{path}/state/kind=delta/n={n}")
            merged = latest(state_at(commits, before).unionByName(delta)).withColumn("deleted", F.lit(False))
            _bucketed(merged).write.mode("overwrite").partitionBy("sb", "pb").parquet(f"{path}/state/kind=snapshot/n={n}")
            base = n
        commits.add(n, base + 1)
    finally:
        new.unpersist()


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove snapshots and deltas that neither the last committed epoch nor one before it (a replay) can need."""
    commits = Commits(spark, path)
    kept = commits.all()[-2:]
    needed = {f for m in kept for f in folders(commits, m)}
    for c in commits.all():
        for kind in ("snapshot", "delta"):
            f = f"state/kind={kind}/n={c[0]}"
            if f"{commits.path}/{f}" not in needed and commits.exists(f):
                commits.drop(f)
