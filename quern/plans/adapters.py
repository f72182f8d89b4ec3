"""The driver's tables read as the relations of a retrieval service: documents with paths, line chunks, a query log
with ranked hits, and labelled scores. Each adapter has a SQL twin (a WITH clause) for the checking engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import lexical
from quern.session import spread, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project (lang), generation, source, doc_id, relative_path, content, indexed_at."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("lang").alias("project"),
        F.lit(1).alias("generation"),
        "source",
        "doc_id",
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"),
        F.col("text").alias("content"),
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(doc_id % 600 as int), cast(doc_id % 7 as int), 0)").alias("indexed_at"),
    )


DOCUMENTS = """docs AS (SELECT lang AS project, 1 AS generation, source, doc_id, source || '/' || doc_id || '.md' AS relative_path, text AS content,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours((doc_id % 600)::INT) + to_minutes((doc_id % 7)::INT) AS indexed_at FROM documents)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line of a document: project, source, doc_id, config, chunk_index (from 0, dense), content, tokens."""
    d = spread(table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "text"))
    c = d.select(F.col("lang").alias("project"), "source", "doc_id", F.col("lang").alias("config"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content"))
    return c.withColumn("tokens", lexical.tokens(F.col("content")))


CHUNKS = r"""lines AS (SELECT lang, source, doc_id, string_split(text, chr(10)) AS l FROM documents),
chunks AS (SELECT lang AS project, source, doc_id, lang AS config, (i - 1)::INT AS chunk_index, l[i] AS content,
  regexp_extract_all(lower(l[i]), '[\p{L}\p{N}_]+') AS tokens FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM lines))"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged searches."""
    return spark.sql(f"SELECT {_LOG} FROM {{events}}", events=table(spark, sf_dir, "events"))


_LOG = """event_id AS query_id, ts AS created_at, user_id AS token, CASE WHEN event_type = 'error' THEN 'dashboard' ELSE 'mcp' END AS actor,
  CASE WHEN user_id % 3 = 0 THEN 'small' ELSE 'base' END AS model, CAST(1 + user_id % 2 AS INT) AS generation,
  CASE WHEN user_id % 5 = 0 THEN CAST(NULL AS DOUBLE) ELSE 0.02 END AS floor,
  CONCAT('question ', regexp_extract(props, '([0-9]+)', 1)) AS query_norm,
  CONCAT(CASE WHEN event_id % 2 = 0 THEN 'Question ' ELSE 'question ' END, regexp_extract(props, '([0-9]+)', 1)) AS query_text,
  CASE WHEN event_id % 37 = 0 THEN CAST(NULL AS DOUBLE) ELSE value / 500 END AS top_score,
  CASE WHEN event_id % 37 = 0 THEN 0 ELSE CAST(1 + event_id % 4 AS INT) END AS hit_count"""
LOG = f"log AS (SELECT {_LOG} FROM events)"


def query_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank (from 1), doc_id, chunk_index, score of the logged hits."""
    log = query_log(spark, sf_dir).filter("hit_count > 0")
    h = log.select("query_id", "top_score", F.explode(F.sequence(F.lit(1), F.col("hit_count"))).alias("rank"))
    return h.select("query_id", "rank", F.expr("(query_id * 7 + rank * 13) % 150").alias("doc_id"), F.expr("cast((query_id + rank) % 3 as int)").alias("chunk_index"), F.expr("top_score / rank").alias("score"))


HITS = """hits AS (SELECT query_id, rank, (query_id * 7 + rank * 13) % 150 AS doc_id, ((query_id + rank) % 3)::INT AS chunk_index, top_score / rank AS score
  FROM (SELECT query_id, top_score, unnest(range(1, hit_count + 1))::INT AS rank FROM log WHERE hit_count > 0))"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with a truth: doc_id, truth, kind, score (a deterministic score in [0, 1))."""
    return spark.sql(f"SELECT {_SAMPLES} FROM {{labels}}", labels=table(spark, sf_dir, "labels"))


_SAMPLES = """doc_id, quality AS truth, CASE WHEN toxic = 1 THEN 'off-domain' ELSE 'absent-feature' END AS kind,
  CAST((doc_id * 7919 % 1000) + 300 * quality AS DOUBLE) / 1300 AS score"""
SAMPLES = f"samples AS (SELECT {_SAMPLES} FROM labels)"
