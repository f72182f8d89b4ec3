"""Golden sets, audit and run records, timers and storage figures of a service, as operators on tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators import analytics

GOLDEN_MOST = 1000


def replace_golden(current: DataFrame, new: DataFrame, project: str, most: int = GOLDEN_MOST) -> DataFrame:
    """The golden rows after a project's set is replaced as a whole: refused if keys repeat or there are too many."""
    fault = F.when(F.col("_all") > most, F.concat(F.lit("too many questions: "), F.col("_all").cast("string"))).when(F.col("_n") > 1, F.concat(F.lit("repeated key: "), "key"))
    counted = new.select("key", "question").groupBy("key").agg(F.count("*").alias("_n"), F.min("question").alias("question"))
    total = counted.agg(F.sum("_n").alias("_all"))
    sound = counted.join(F.broadcast(total)).withColumn("_fault", fault).filter(F.assert_true(F.col("_fault").isNull(), F.coalesce("_fault", F.lit(""))).isNull())
    rows = sound.select(F.lit(project).alias("project"), "key", "question")
    return current.filter(F.col("project") != project).select("project", "key", "question").unionByName(rows)


def golden_lines(rows: DataFrame) -> DataFrame:
    """One JSON line for each golden row, in key order within its project; null fields are left out."""
    return rows.select("project", F.to_json(F.struct("key", "question")).alias("line"))


def append_audit(entries: DataFrame, path: str) -> bool:
    """Append audit rows; a failure is told but never stops the action that is audited."""
    try:
        entries.write.mode("append").parquet(path)
    except Exception as e:  # noqa: BLE001 - whatever the store says, the action goes on
        entries.sparkSession.sparkContext._jvm.org.slf4j.LoggerFactory.getLogger("quern").warn(f"audit row lost: {e}")
        return False
    return True


def record_run(history: DataFrame, run: DataFrame, by: list[str], at: str, keep: int) -> DataFrame:
    """History with a new run, the newest `keep` of each group (20 index runs, 10 floor suggestions, 100 evaluations). Runs of one
    time follow each other by all their other columns, so that a rerun keeps the same."""
    rest = [F.col(c) for c in history.columns if c not in (*by, at)]
    return analytics.keep_newest(history.unionByName(run), by, [F.desc(at), *rest], keep)


def first_due(sources: DataFrame, interval: str, now: Column, seed: int = 7) -> DataFrame:
    """sources plus first_due: now and a random part of the source's interval in seconds, so that sources made together
    do not fall due together. The part comes from a hash of the source (32 bits of an MD5 digest): a rerun gives the same."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("")))), 1, 8)
    share = F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 32))
    return sources.withColumn("first_due", F.timestamp_micros((F.unix_micros(now) + share * F.col(interval) * 1_000_000).cast("long")))


def queue_order(triggers: DataFrame) -> DataFrame:
    """position of every pending run of a project: interactive before scheduled, then by time of asking; a project that is
    asked for in both lanes runs once, promoted to the interactive one. Runs of one project wait for each other."""
    best = triggers.groupBy("project", "key").agg(F.min(F.when(F.col("lane") == "interactive", 0).otherwise(1)).alias("_lane"), F.min("asked_at").alias("asked_at"))
    w = Window.partitionBy("project").orderBy("_lane", "asked_at", "key")
    return best.select("project", "key", F.when(F.col("_lane") == 0, "interactive").otherwise("scheduled").alias("lane"), F.row_number().over(w).alias("position"))


def drain_batches(rows: DataFrame, key: str, work, schema: str, size: int = 20) -> DataFrame:
    """work(pandas frame of at most `size` rows, in key order within a partition) -> frame; nothing is held beyond a batch."""

    def run(frames):
        rest = None
        for f in frames:
            rest = f if rest is None else pd.concat([rest, f])
            while len(rest) >= size:
                yield work(rest.iloc[:size])
                rest = rest.iloc[size:]
        if rest is not None and len(rest):
            yield work(rest)

    return rows.sortWithinPartitions(key).mapInPandas(run, schema)


def evaluation_history(runs: DataFrame, results: DataFrame) -> DataFrame:
    """Per run: questions, recall@5 (rank from 0, null: missed) and mean reciprocal rank, newest first by its caller."""
    r = results.groupBy("run_id").agg(
        F.count("*").alias("questions"),
        F.avg(F.when(F.col("rank") < 5, 1.0).otherwise(0.0)).alias("recall_at_5"),
        F.avg(F.coalesce(F.lit(1.0) / (F.col("rank") + 1), F.lit(0.0))).alias("mrr"),
    )
    return runs.join(r, "run_id", "left")


def query_summary(log: DataFrame) -> DataFrame:
    """Five figures (searches, distinct questions, empty, refused, average best score) of the default configuration: the
    most queried, then the most recent. Configurations are few: they are ordered after aggregation."""
    refused = (F.col("floor") > 0) & (F.col("top_score") < F.col("floor"))
    per = log.groupBy("model", "generation", "floor").agg(
        F.count("*").alias("searches"),
        F.count_distinct("query_norm").alias("questions"),
        F.count_if(F.col("hit_count") == 0).alias("empty"),
        F.count_if(refused).alias("refused"),
        F.avg("top_score").alias("avg_score"),
        F.max("created_at").alias("last_at"),
    )
    return per.orderBy(F.desc("searches"), F.desc("last_at")).limit(1)


def apply_floor(projects: DataFrame, suggestion: DataFrame) -> DataFrame:
    """projects with the suggested floor where the project's model and generation are still those it was made for;
    fault says why it was refused elsewhere."""
    s = suggestion.select("project", F.col("model").alias("_m"), F.col("generation").alias("_g"), F.col("floor").alias("_f"))
    j = projects.join(s, "project", "left")
    same = F.col("_m").eqNullSafe(F.col("model")) & F.col("_g").eqNullSafe(F.col("generation"))
    fault = F.when(F.col("_f").isNotNull() & (F.col("_m") != F.col("model")), "model moved").when(F.col("_f").isNotNull() & (F.col("_g") != F.col("generation")), "generation moved")
    return j.select("project", "model", "generation", F.when(F.col("_f").isNotNull() & same, F.col("_f")).otherwise(F.col("floor")).alias("floor"), fault.alias("fault"))


def findings_page(findings: DataFrame, rule: str | None, after: tuple[str, int] | None, limit: int) -> DataFrame:
    """Findings by document and start beyond a cursor, of one rule or of all."""
    f = findings if rule is None else findings.filter(F.col("rule") == rule)
    if after is not None:
        f = f.filter((F.col("key") > after[0]) | ((F.col("key") == after[0]) & (F.col("start") > after[1])))
    return f.orderBy("key", "start").limit(limit)


def directory_bytes(spark: SparkSession, root: str, skip: list[str]) -> DataFrame:
    """dir, bytes, files below a root, each file counted in every directory above it; directories named in skip are left
    out. Only file headers are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    base = F.regexp_replace("path", "^[a-z0-9]+:/*", "/")
    parts = F.split(F.substring(base, len(root.rstrip("/")) + 2, 1_000_000), "/")
    f = files.withColumn("_p", parts).withColumn("_d", F.slice("_p", F.lit(1), F.size("_p") - 1))
    f = f.filter(~F.arrays_overlap("_d", F.array(*[F.lit(s) for s in skip])) if skip else F.lit(True))
    above = F.transform(F.sequence(F.lit(0), F.size("_d")), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice("_d", F.lit(1), F.greatest(n, F.lit(1))), "/")))
    return f.select(F.explode(above).alias("dir"), "length").groupBy("dir").agg(F.sum("length").alias("bytes"), F.count("*").alias("files"))


def synthetic_vectors(spark: SparkSession, n: int, dim: int, seed: int = 1, anchor: list[float] | None = None, cosine: float = 0.0, partitions: int = 8) -> DataFrame:
    """vec_id and unit vectors of a seeded Gaussian; with an anchor (unit), all at exactly that cosine from it."""

    def run(frames):
        for f in frames:
            out = []
            for i in f["id"]:
                x = np.random.default_rng([seed, int(i)]).normal(size=dim)
                if anchor is not None:
                    a = np.array(anchor)
                    x -= (x @ a) * a
                    x = cosine * a + np.sqrt(1 - cosine * cosine) * x / np.linalg.norm(x)
                out.append((x / np.linalg.norm(x)).tolist())
            yield pd.DataFrame({"vec_id": f["id"], "embedding": out})

    return spark.range(0, n, 1, partitions).mapInPandas(run, "vec_id long, embedding array<double>")


# The two prompts' texts for a model.
PROMPTS = {
    "answer": "Answer the question from the documentation. Search first, read what you cite, and say so if nothing fits.\n\nQuestion: {question}",
    "explore": "Explore the documentation on a topic. List what there is, read the most relevant documents, and sum them up.\n\nTopic: {question}",
}


def prompt(kind: str, text: str | Column) -> Column:
    """The prompt of a kind with the text put in."""
    before, after = PROMPTS[kind].split("{question}")
    return F.concat(F.lit(before), F.col(text) if isinstance(text, str) else text, F.lit(after))
