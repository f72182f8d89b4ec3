"""Search requests with filters: each gets one outcome, and those that can be answered get hits from what they ask for only.

Filters (source, version, path prefix) apply before candidates are cut, to both halves, so that a narrow one still finds as
many as there are. What counts as a common word does not depend on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import lexical, retrieval
from quern.operators.ingest import clean_path
from quern.session import cut, small

#: How a chunk must match what a request asks for; a null of the request asks for nothing.
FILTERS = {"project": "equal", "source": "equal", "version": "equal", "relative_path": "prefix"}


def outcomes(requests: DataFrame, projects: DataFrame, documents: DataFrame, model: str) -> DataFrame:
    """requests plus status, available and relative_path (the clean prefix): the first of project_gone, not_indexed, model_mismatch,
    unknown_source, unknown_version (both with what there is, in order), invalid_path_prefix that holds, or ok.

    requests: query_id, project, source, version, path_prefix; projects: project, model; documents: project, source, version of
    what is indexed. Null filters ask for nothing. An unversioned document has an empty version."""
    held = documents.groupBy("project").agg(F.array_sort(F.collect_set("source")).alias("_sources"), F.array_sort(F.collect_set("version")).alias("_versions"))
    j = requests.join(small(projects.select("project", F.col("model").alias("_model"), F.lit(True).alias("_there"))), "project", "left").join(small(cut(held, "held")), "project", "left")
    prefix = clean_path(F.regexp_replace("path_prefix", "/+$", ""))
    status = (
        F.when(F.col("_there").isNull(), "project_gone")
        .when(F.col("_sources").isNull(), "not_indexed")
        .when(~F.col("_model").eqNullSafe(F.lit(model)), "model_mismatch")
        .when(F.col("source").isNotNull() & ~F.coalesce(F.array_contains("_sources", F.col("source")), F.lit(False)), "unknown_source")
        .when(F.col("version").isNotNull() & ~F.coalesce(F.array_contains("_versions", F.col("version")), F.lit(False)), "unknown_version")
        .when(F.col("path_prefix").isNotNull() & prefix.isNull(), "invalid_path_prefix")
        .otherwise("ok")
    )
    out = j.withColumn("status", status)
    available = F.when(F.col("status") == "unknown_source", F.col("_sources")).when(F.col("status") == "unknown_version", F.col("_versions"))
    return out.withColumn("available", available).withColumn("relative_path", prefix).drop("_there", "_model", "_sources", "_versions")


def search(chunks: DataFrame, asked: DataFrame, order: list, k: int = 50, limit: int = 5, digits: int = 9) -> DataFrame:
    """query_id, position, doc_id, chunk_index, dense_rank, lexical_rank, fused: the page of each request that outcomes() found ok.

    chunks: project, source, version, relative_path, config, doc_id, chunk_index, tokens, embedding; asked: query_id, tokens, embedding,
    config and the filters as outcomes() gives them."""
    dense = retrieval.dense(chunks, asked, k, ("chunk_index", "doc_id"), digits=digits, match=FILTERS)
    terms = cut(lexical.asked_terms(asked), "asked")
    df = cut(lexical.plain_frequencies(chunks, terms.select("config", "term").distinct()), "df")
    kept = cut(lexical.rare(terms.withColumnRenamed("term", "stem"), df, lexical.thresholds(df)), "terms")
    found = terms.select("config", "term", F.col("term").alias("stem")).distinct()
    lists = lexical.ranked(lexical.best(chunks, kept, found, k, match=FILTERS, asked=asked), k).select("query_id", "doc_id", "chunk_index", "lexical_rank")
    fused = retrieval.fuse(dense.drop("cosine"), lists, ["query_id", "doc_id", "chunk_index"])
    return retrieval.page(fused, order, limit=limit).select("query_id", "position", "doc_id", "chunk_index", "dense_rank", "lexical_rank", "fused")
