"""Retrieval evaluation and floor calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import ranks

FLOOR_LOW, FLOOR_HIGH, FLOOR_STEP = 600, 990, 1000


def heading_matches(actual: Column, expected: Column) -> Column:
    """Equal, or a breadcrumb that ends with the expected heading."""
    return (actual == expected) | actual.endswith(F.concat(F.lit(" > "), expected))


def retrieval_metrics(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """recall@1, recall@5, MRR, mean score of correct hits (null if none), heading recall@5 over rows that name a heading,
    and how many were gated, with an answer among them. rank is 0-based, null if the answer was not found."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    r = F.col("rank")
    aggs = [
        F.count("*").alias("n"),
        share(r < 1).alias("recall_1"),
        share(r < 5).alias("recall_5"),
        F.avg(F.coalesce(1.0 / (r + 1), F.lit(0.0))).alias("mrr"),
        F.avg(F.when(r.isNotNull(), F.col("score"))).alias("correct_score"),
        F.avg(F.when(F.col("heading").isNotNull(), F.when(F.coalesce(F.col("heading_rank") < 5, F.lit(False)), 1.0).otherwise(0.0))).alias("heading_5"),
        F.count_if("gated").alias("gated"),
        F.count_if(F.col("gated") & r.isNotNull()).alias("gated_with_answer"),
    ]
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(*aggs)


def by_tag(rows: DataFrame) -> DataFrame:
    """The metrics per tag; a row counts in each of its tags."""
    return retrieval_metrics(rows.withColumn("tag", F.explode("tags")), ["tag"])


def auc(samples: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    """Area under the ROC curve by the rank sum, ties counting one half. Scores are aggregated to counts first, so the
    ordered step sees one row per distinct score, cell by cell, and no pair is formed."""
    c = samples.groupBy(score).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("n"))
    t = ranks.below(c, score, "n").withColumn("_won", F.col("p") * (F.col("_below") + F.col("n") / 2))
    return t.agg((F.sum("_won") / (F.sum("p") * F.sum("n"))).alias("auc"))


def score_features(hits: DataFrame) -> DataFrame:
    """Per question: the top score, its gap to the second, its spread over the last and its population z-score."""
    g = hits.groupBy("query_id").agg(F.max("score").alias("top"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.min("score").alias("last"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))
    return g.select("query_id", "top", (F.col("top") - F.coalesce("second", F.lit(0.0))).alias("gap"), (F.col("top") - F.col("last")).alias("spread"), F.when(F.col("sd") > 1e-12, (F.col("top") - F.col("mean")) / F.col("sd")).otherwise(0.0).alias("z"))


def grid(spark, low: int = FLOOR_LOW, high: int = FLOOR_HIGH, step: int = 1) -> DataFrame:
    """floor: the steps of the floor grid, in thousandths."""
    return spark.range(low, high + 1, step).select((F.col("id") / F.lit(1000.0)).alias("floor"))


def floor_sweep(samples: DataFrame, floors: DataFrame, kind: str = "kind") -> DataFrame:
    """Per class and floor the share of scores below it. A score is put into its cell of the grid first: the floors
    (a thousand at most) meet the counts of cells, not the samples."""
    per = samples.withColumn("_cell", F.floor(F.col("score") * 1000)).groupBy(kind, "_cell").agg(F.count("*").alias("_n"), F.max("score").alias("_m"))
    total = per.groupBy(kind).agg(F.sum("_n").alias("_total"))
    f = floors.withColumn("_at", F.round(F.col("floor") * 1000).cast("long"))
    joined = F.broadcast(f).join(per, F.col("_cell") < F.col("_at"))
    hit = joined.groupBy(kind, "floor").agg(F.sum("_n").alias("_below"))
    return f.join(total).join(hit, [kind, "floor"], "left").select(kind, "floor", (F.coalesce("_below", F.lit(0)) / F.col("_total")).alias("refused"))


def fit_floor(samples: DataFrame, share: float, low: int = FLOOR_LOW, high: int = FLOOR_HIGH) -> DataFrame:
    """The highest thousandth in [low, high] that refuses at most floor(n * share) samples; 0 if even the first refuses more."""
    cells = samples.withColumn("c", F.greatest(F.least(F.floor(F.col("score") * 1000), F.lit(high)), F.lit(low - 1))).groupBy("c").agg(F.count("*").alias("n"))
    floors = samples.sparkSession.range(low, high + 1).select(F.col("id").alias("c"), F.lit(0).cast("long").alias("n"))
    both = cells.unionByName(floors).groupBy("c").agg(F.sum("n").alias("n"))
    w = Window.orderBy("c")
    run = both.withColumn("below", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("n").over(Window.partitionBy()))
    ok = run.filter((F.col("c") >= low) & (F.col("below") <= F.floor(F.col("total") * share)))
    return ok.agg(F.coalesce(F.max("c") / F.lit(1000.0), F.lit(0.0)).alias("floor"))


def drop_ratio(hits: DataFrame, ratio: float) -> DataFrame:
    """How many hits a trim below ratio times the question's top score keeps and loses, in all and of the relevant ones."""
    w = Window.partitionBy("query_id").orderBy("rank")
    h = hits.withColumn("_top", F.first("score").over(w)).withColumn("_keep", F.col("score") >= F.col("_top") * ratio)
    return h.agg(F.count_if("_keep").alias("kept"), F.count_if(~F.col("_keep")).alias("lost"), F.count_if(F.col("_keep") & F.col("relevant")).alias("relevant_kept"), F.count_if(~F.col("_keep") & F.col("relevant")).alias("relevant_lost"))


def regressions(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Keys in the top five before, of unchanged fingerprint, that are not there now."""
    j = previous.select("key", "fp", F.col("rank").alias("was")).join(current.select("key", "fp", F.col("rank").alias("now")), ["key", "fp"])
    return j.filter((F.col("was") < 5) & ~F.coalesce(F.col("now") < 5, F.lit(False)))


def fingerprint(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts as a JSON array."""
    return F.substring(F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256), 1, 16)


def slice_gate(off: DataFrame, on: DataFrame, tag: str, per_mille: int) -> DataFrame:
    """One row that compares two runs (key, rank from 0 or null, below_floor, tags) of the same questions: for the rows that carry
    the tag (slice_) and for all others (rest_) the questions, hits in the top five without and with the change, how many entered
    and left it, and the hits that are past the floor; slice_passed where more than `per_mille` of the slice are hit, passed where
    besides no other question was lost, whatever was gained. fault: what makes the runs no one measurement apart (null: nothing);
    such runs never pass. Tags are those of the first run."""

    def arm(run: DataFrame, p: str) -> DataFrame:
        hit = F.coalesce(F.col("rank") < 5, F.lit(False))
        r = run.groupBy("key").agg(F.count("*").alias(f"{p}n"), F.max(hit).alias(f"{p}hit"), F.max(F.coalesce("below_floor", F.lit(False))).alias(f"{p}low"), F.first("tags").alias(f"{p}tags"))
        return r.withColumnRenamed("key", f"{p}key")

    j = arm(off, "a_").join(arm(on, "b_"), F.col("a_key").eqNullSafe(F.col("b_key")), "full_outer")
    inside = F.coalesce(F.array_contains("a_tags", tag), F.lit(False))
    a, b = F.coalesce("a_hit", F.lit(False)), F.coalesce("b_hit", F.lit(False))
    aggs = []
    for name, where in (("slice", inside), ("rest", ~inside)):
        aggs += [
            F.count_if(where).alias(f"{name}_questions"),
            F.count_if(where & a).alias(f"{name}_off_hits"),
            F.count_if(where & b).alias(f"{name}_on_hits"),
            F.count_if(where & b & ~a).alias(f"{name}_gained"),
            F.count_if(where & a & ~b).alias(f"{name}_lost"),
            F.count_if(where & a & ~F.coalesce("a_low", F.lit(False))).alias(f"{name}_off_past_floor"),
            F.count_if(where & b & ~F.coalesce("b_low", F.lit(False))).alias(f"{name}_on_past_floor"),
        ]
    r = j.agg(*aggs, F.count_if(F.col("a_n").isNull() | F.col("b_n").isNull()).alias("_odd"), F.count_if((F.col("a_n") > 1) | (F.col("b_n") > 1)).alias("_twice"))
    fault = F.when(F.col("_odd") > 0, "other questions").when(F.col("_twice") > 0, "repeated questions")
    good = (F.col("slice_questions") > 0) & (F.col("slice_on_hits") * 1000 > F.col("slice_questions") * per_mille)
    r = r.withColumn("fault", fault).withColumn("slice_passed", good & F.col("fault").isNull())
    return r.withColumn("passed", F.col("slice_passed") & (F.col("rest_lost") == 0)).drop("_odd", "_twice")


def probe_floor(samples: DataFrame, probe: Column, by: list[str], score: str = "score") -> DataFrame:
    """by, kind, floor, n, refused: the floor of each group is the highest score among its probes (questions that it cannot answer);
    refused is the share of the other rows of each kind below it. A group without probes has no floor and refuses nothing."""
    s = samples.withColumn("_probe", F.coalesce(probe, F.lit(False)))
    floors = s.filter("_probe").groupBy(*by).agg(F.max(score).alias("floor"))
    rest = s.filter(~F.col("_probe")).groupBy(*by, "kind", score).agg(F.count("*").alias("_n"))
    j = rest.join(floors, by, "left")
    low = F.sum(F.when(F.col(score) < F.col("floor"), F.col("_n")).otherwise(0))
    return j.groupBy(*by, "kind").agg(F.first("floor").alias("floor"), F.sum("_n").alias("n"), (low / F.sum("_n")).alias("refused"))


def feature_thresholds(samples: DataFrame, features: list[str], by: list[str]) -> DataFrame:
    """by, feature, threshold, n, caught: for each feature the largest threshold that refuses no answerable row (truth 1) of all groups
    together, and the share of the rows with truth 0 that it catches in each group. Values that are null or not a number take no
    part in the threshold and are not caught. Both passes aggregate before they shuffle; the thresholds are one row."""
    real = lambda f: F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double"))
    least = samples.filter("truth = 1").agg(*[F.min(real(f)).alias(f"_{f}") for f in features])
    j = samples.filter("truth = 0").join(F.broadcast(least))
    a = j.groupBy(*by).agg(F.count("*").alias("n"), *[F.first(f"_{f}").alias(f"_t_{f}") for f in features], *[F.count_if(F.coalesce(real(f) < F.col(f"_{f}"), F.lit(False))).alias(f"_c_{f}") for f in features])
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_t_{f}").alias("threshold"), (F.col(f"_c_{f}") / F.col("n")).alias("caught")) for f in features])
    return a.select(*by, "n", F.inline(rows))


def gate_verdict(metrics: DataFrame, floors: dict[str, float]) -> DataFrame:
    """metrics plus, for each floor, <metric>_ok: measured and at or above it."""
    return metrics.withColumns({f"{m}_ok": F.coalesce(F.col(m) >= v, F.lit(False)) for m, v in floors.items()})


def expected_known(golden: DataFrame, documents: DataFrame) -> DataFrame:
    """golden (project, expect_file and more) plus scorable: whether the project holds the expected document (project, relative_path)."""
    d = documents.select(F.col("project").alias("_p"), F.col("relative_path").alias("_f")).distinct()
    j = golden.join(d, (F.col("project") == F.col("_p")) & (F.col("expect_file") == F.col("_f")), "left")
    return j.withColumn("scorable", F.col("_f").isNotNull()).drop("_p", "_f")
