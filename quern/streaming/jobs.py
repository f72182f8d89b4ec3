"""Structured Streaming forms of the stateful behaviours: rate windows, debounce, coalescing, log append, change capture."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.session import shared_dir
from quern.streaming import statetable
from quern.streaming.commits import Commits


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a file stream; the schema is stated, never inferred."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    s = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def rate_windows(events: DataFrame, limit: int, window: str = "1 minute", late: str = "0 seconds", key: str = "user_id", at: str = "ts") -> DataFrame:
    """Aligned windows per key, emitted once closed by the watermark; later rows are dropped by the engine."""
    w = events.withWatermark(at, late).groupBy(key, F.window(at, window).alias("w")).agg(F.count("*").alias("hits"))
    return w.select(F.col(key).alias("token"), F.col("w.start").alias("window_start"), "hits", (F.col("hits") > limit).alias("denied"))


def debounce(events: DataFrame, gap: str = "60 seconds", late: str = "0 seconds", key: str = "user_id", at: str = "ts") -> DataFrame:
    """One row per burst of a key, when nothing came for the gap."""
    s = events.withWatermark(at, late).groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select(F.col(key).alias("token"), F.col("s.start").alias("start_at"), "n")


def retained(events: DataFrame, keep: Column, at: str = "ts") -> DataFrame:
    """Rows not older than the bound."""
    return events.filter(F.col(at) >= keep)


def _times(batches: Iterator[pd.DataFrame], at: str) -> list[float]:
    """The times of a key in one micro-batch, in order: Arrow may hand them over in several parts."""
    return sorted(x.timestamp() for pdf in batches for x in pdf[at])


def _wake(state: GroupState, at: float) -> None:
    """Ask for a timeout at a time in seconds, or as soon as the watermark moves if it is past that."""
    state.setTimeoutTimestamp(max(int(at * 1000), state.getCurrentWatermarkMs() + 1))


def sliding_limiter(events: DataFrame, limit: int, seconds: float, key: str = "user_id", at: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Per row whether its key has had `limit` admitted rows in the last `seconds`, and the seconds to wait if so. State is
    the admitted times still in the window: at most `limit` numbers a key, dropped when the watermark has left them behind.
    Rows behind the watermark are dropped by the engine."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        out = []
        for t in _times(batches, at):
            hits = [h for h in hits if h > t - seconds]
            wait = hits[0] + seconds - t if len(hits) >= limit else 0.0
            if not wait:
                hits.append(t)
            out.append((k[0], t, wait == 0.0, wait))
        state.update((hits,))
        _wake(state, (hits[-1] if hits else 0.0) + seconds)
        yield pd.DataFrame(out, columns=["token", "at", "admitted", "wait"])

    rows = events.withWatermark(at, late).groupBy(key)
    return rows.applyInPandasWithState(run, "token long, at double, admitted boolean, wait double", "hits array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def coalesced_runs(events: DataFrame, gap: float, key: str = "user_id", at: str = "ts", late: str = "0 seconds") -> DataFrame:
    """Triggers of a key: run now if the last run is a gap ago, else remember the earliest due time and run then: at the next
    trigger at or after it, or when the watermark passes it. State is the last run and the due time, dropped a gap after
    the last run. Rows behind the watermark are dropped by the engine."""

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, due = state.get if state.exists else (None, None)
        out = []
        if state.hasTimedOut:
            if due is None:
                state.remove()
                return
            out.append((k[0], due, "deferred"))
            last, due = due, None
        else:
            for t in _times(batches, at):
                if due is not None and t >= due:
                    out.append((k[0], due, "deferred"))
                    last, due = due, None
                if last is None or last + gap <= t:
                    out.append((k[0], t, "now"))
                    last = t
                elif due is None:
                    due = last + gap
        state.update((last, due))
        _wake(state, due if due is not None else last + gap)
        yield pd.DataFrame(out, columns=["token", "at", "kind"])

    rows = events.withWatermark(at, late).groupBy(key)
    return rows.applyInPandasWithState(run, "token long, at double, kind string", "last double, due double", "append", GroupStateTimeout.EventTimeTimeout)


def drain(stream: DataFrame, label: str) -> DataFrame:
    """Run a stream over all that is available, into a file sink with a checkpoint, both in the shared folder; what it
    wrote, as a table."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/stream-{label}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def append_searches(stream: DataFrame, path: str, checkpoint: str, capacity: int | None = None):
    """A log of searches (query_id, created_at, ..., hits) as two tables that are committed together: a header of each search
    and its hits, one row each. Readers see both of an epoch or neither.

    capacity bounds what an epoch keeps, as a buffer does: the earliest searches are accepted, the others dropped and counted
    in the epoch's marker. Without it nothing is dropped."""

    def write(batch: DataFrame, n: int) -> None:
        commits = Commits(batch.sparkSession, path)
        if commits.has(n):
            return
        batch = batch.persist()
        try:
            total = batch.count()
            kept = batch if capacity is None or total <= capacity else batch.orderBy("created_at", "query_id").limit(capacity)
            kept.drop("hits").write.mode("overwrite").parquet(f"{path}/headers/n={n}")
            kept.select("query_id", F.inline("hits")).write.mode("overwrite").parquet(f"{path}/hits/n={n}")
            accepted = total if capacity is None else min(total, capacity)
            commits.add(n, accepted, total - accepted)
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_searches(spark: SparkSession, path: str, schema: str, hit_schema: str) -> tuple[DataFrame, DataFrame]:
    """Headers and hits of the committed epochs, each with its epoch n. Epochs are committed in order, so the last decides."""
    last = max((c[0] for c in Commits(spark, path).all()), default=-1)
    read = lambda name, s: spark.read.schema(f"{s}, n long").parquet(f"{path}/{name}").filter(F.col("n") <= last) if last >= 0 else spark.createDataFrame([], f"{s}, n long")
    return read("headers", schema), read("hits", hit_schema)


def search_counts(spark: SparkSession, path: str) -> tuple[int, int]:
    """Searches accepted and dropped so far."""
    done = Commits(spark, path).all()
    return sum(c[1] for c in done), sum(c[2] for c in done)


def split_late(stream: DataFrame, path: str, checkpoint: str, at: str = "ts", delay: float = 0.0):
    """The rows of a stream as two tables, on_time and late: a row is late if its time lies more than `delay` seconds before the
    latest time of the batches before its own. No row is lost, and rows without a time are late. The bound is noted in each
    epoch's marker, so a replayed batch is split as it was at first."""

    def write(batch: DataFrame, n: int) -> None:
        commits = Commits(batch.sparkSession, path)
        if commits.has(n):
            return
        before = commits.before(n)
        bound = before[1] if before else None
        batch = batch.persist()
        try:
            micros = F.unix_micros(F.col(at).cast("timestamp"))
            late = micros.isNull() | (micros < bound) if bound is not None else micros.isNull()
            batch.filter(~late).write.mode("overwrite").parquet(f"{path}/on_time/n={n}")
            batch.filter(late).write.mode("overwrite").parquet(f"{path}/late/n={n}")
            top = batch.agg(F.max(micros)).first()[0]
            new = None if top is None else top - int(delay * 1_000_000)
            commits.add(n, max(x for x in (bound, new, 0) if x is not None))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def capture_changes(snapshots: DataFrame, path: str, checkpoint: str, complete: bool = False, compact_every: int = statetable.COMPACT_EVERY):
    """Each micro-batch is the newest state of some paths (relative_path, content_hash; source and deleted if there are such
    columns); the journal gets what differs from the state before it. complete: a batch lists all of each source it names.

    State is kept as in statetable: a batch reads one snapshot and at most compact_every deltas."""

    def write(batch: DataFrame, n: int) -> None:
        statetable.apply_batch(batch, n, path, complete, compact_every)

    return snapshots.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
