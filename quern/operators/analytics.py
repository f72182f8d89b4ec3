"""Query-log analytics: repetition, gaps, volume, what-if floors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import ranks
from quern.operators.retrieval import rrf
from quern.session import cut


def in_scope(log: DataFrame, since: str | None = None, until: str | None = None, actor: str | None = None, model: str | None = None, generation: int | None = None, floor: Column | None = None) -> DataFrame:
    """The log within a half-open window and one configuration; a null floor matches a null floor. Absent filters add
    no predicate; those given reach the scan."""
    if since is not None:
        log = log.filter(F.col("created_at") >= F.expr(f"timestamp_ntz '{since}'"))
    if until is not None:
        log = log.filter(F.col("created_at") < F.expr(f"timestamp_ntz '{until}'"))
    for name, value in (("actor", actor), ("model", model), ("generation", generation)):
        if value is not None:
            log = log.filter(F.col(name) == value)
    return log if floor is None else log.filter(F.col("floor").eqNullSafe(floor))


def repeated_questions(log: DataFrame) -> DataFrame:
    """One row per normalised question: how often, by how many tokens, on how many UTC days, best score, whether it was
    ever refused or empty, first and last time, latest spelling."""
    refused = (F.col("floor") > 0) & (F.col("top_score") < F.col("floor"))
    return log.groupBy("query_norm").agg(
        F.count("*").alias("asked"),
        F.countDistinct("token").alias("tokens"),
        F.countDistinct(F.to_date("created_at")).alias("days"),
        F.count_if(F.col("hit_count") == 0).alias("empty"),
        F.max("top_score").alias("best_score"),
        F.bool_or(F.coalesce(refused, F.lit(False))).alias("refused"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        F.max_by("query_text", F.struct("created_at", "query_id")).alias("spelling"),
    )


def gap_order(questions: DataFrame) -> DataFrame:
    """Questions ranked by repetition fused with badness of the best score (an absent score is the worst)."""
    q = ranks.ranks(cut(questions, "questions"), {"asked_rank": ("asked", True), "score_rank": ("best_score", False)})
    return q.withColumn("gap", rrf("asked_rank") + rrf("score_rank"))


def top_hits(log: DataFrame, hits: DataFrame, n: int = 3) -> DataFrame:
    """Per question the n documents it was answered with most often, then by best score, then by document."""
    j = hits.join(log.select("query_id", "query_norm"), "query_id").groupBy("query_norm", "doc_id").agg(F.count("*").alias("times"), F.max("score").alias("best"))
    w = Window.partitionBy("query_norm").orderBy(F.desc("times"), F.desc("best"), "doc_id")
    return j.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def volume(log: DataFrame, first: str, last: str) -> DataFrame:
    """Counts per UTC day from a calendar: days without a search stay, with zeros."""
    days = log.sparkSession.sql(f"SELECT explode(sequence(date '{first}', date '{last}')) AS day")
    refused = (F.col("floor") > 0) & (F.col("top_score") < F.col("floor"))
    per = log.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("hit_count") == 0).alias("e"), F.count_if(refused).alias("r"), F.avg("top_score").alias("avg_score"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.broadcast(days).join(per, "day", "left").select(F.col("day").cast("string").alias("day"), zero("n").alias("searches"), zero("e").alias("empty"), zero("r").alias("refused"), "avg_score")


def never_returned(documents: DataFrame, log: DataFrame, hits: DataFrame) -> DataFrame:
    """Documents that no search made since their indexing has returned (anti join on the document and the time)."""
    shown = hits.join(log.select("query_id", "created_at"), "query_id").groupBy("doc_id").agg(F.max("created_at").alias("shown_at"))
    # "some hit at or after indexing" is "the latest hit is": one row per document instead of every hit
    return documents.join(shown, "doc_id", "left").filter(F.col("shown_at").isNull() | (F.col("shown_at") < F.col("indexed_at"))).drop("shown_at")


def searches_since(documents: DataFrame, log: DataFrame) -> DataFrame:
    """Searches logged at or after each document's indexing, by prefix sums instead of a theta join: counts of whole hours
    (a list as long as the log's time span, in one task), and within an hour the distinct times of that hour."""
    times = log.groupBy(F.col("created_at").alias("_t")).agg(F.count("*").alias("_c"))
    stamps = documents.select(F.col("indexed_at").alias("_t")).distinct().withColumn("_c", F.lit(0).cast("long"))
    both = times.unionByName(stamps).groupBy("_t").agg(F.sum("_c").alias("_c")).withColumn("_hour", F.date_trunc("hour", "_t"))
    later = Window.orderBy(F.desc("_hour")).rowsBetween(Window.unboundedPreceding, -1)
    hours = both.groupBy("_hour").agg(F.sum("_c").alias("_n")).select("_hour", F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    inside = Window.partitionBy("_hour").orderBy(F.desc("_t")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = both.withColumn("_in", F.sum("_c").over(inside)).join(hours, "_hour")
    return documents.join(after.select(F.col("_t").alias("indexed_at"), (F.col("_in") + F.col("_later")).alias("searches")), "indexed_at")


def what_if(log: DataFrame, current: float, proposed: float) -> DataFrame:
    """Counts refused at the current and a proposed floor, and how many each would gain and lose."""
    low = lambda f: (F.lit(f) > 0) & (F.col("top_score") < F.lit(f))
    now, then = F.coalesce(low(current), F.lit(False)), F.coalesce(low(proposed), F.lit(False))
    return log.agg(F.count("*").alias("searches"), F.count_if(now).alias("refused_now"), F.count_if(then).alias("refused_then"), F.count_if(then & ~now).alias("gained"), F.count_if(now & ~then).alias("lost"))


def band_samples(log: DataFrame, low: float, high: float, n: int = 5) -> DataFrame:
    """The n most asked questions whose best score lies in [low, high)."""
    g = log.filter((F.col("top_score") >= low) & (F.col("top_score") < high)).groupBy("query_norm").agg(F.count("*").alias("asked"), F.max("top_score").alias("best"))
    return g.orderBy(F.desc("asked"), F.desc("best"), "query_norm").limit(n)


def rate_windows(log: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """Fixed windows: count per token and aligned window, and whether the limit is passed."""
    w = log.groupBy("token", F.window("created_at", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("hits"))
    return w.select("token", F.col("w.start").alias("window_start"), "hits", (F.col("hits") > limit).alias("denied"))


def sliding_counts(log: DataFrame, seconds: int) -> DataFrame:
    """For each row the hits of its token in the last `seconds`, itself included (a range frame over the time)."""
    t = F.unix_micros(F.col("created_at").cast("timestamp"))
    w = Window.partitionBy("token").orderBy("_t").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return log.withColumn("_t", t).withColumn("recent", F.count("*").over(w)).drop("_t")


def sessions(log: DataFrame, gap: str = "60 seconds") -> DataFrame:
    """Debounce: rows of a token closer than the gap make one session."""
    s = log.groupBy("token", F.session_window("created_at", gap).alias("s")).agg(F.count("*").alias("n"))
    return s.select("token", F.col("s.start").alias("start_at"), "n")


def keep_newest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest n rows of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def histogram(rows: DataFrame, value: str, labels: list[str], bounds: list[float]) -> DataFrame:
    """Cumulative counts per bound and +Inf, with sum and count; null and non-finite values are dropped."""
    v = F.col(value)
    ok = rows.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    aggs = [F.count_if(v <= b).alias(f"le_{i}") for i, b in enumerate(bounds)]
    return ok.groupBy(*labels).agg(*aggs, F.count("*").alias("le_inf"), F.sum(value).alias("total"))
