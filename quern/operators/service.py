"""The user-facing compositions: search with its outcome, topic listing, reading a document, what changed, gap reports."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import chunker
from quern.operators import ingest, logbook


def embed(table: DataFrame, text: Column, provider: Callable[[list[str]], list[list[float]]], prefix: str = "", out: str = "embedding") -> DataFrame:
    """table plus a vector column from a provider that takes lists of texts; passages and questions have their own prefix."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        ok = s.notna()
        vectors = iter(provider([prefix + x for x in s[ok]])) if ok.any() else iter(())
        return pd.Series([next(vectors) if k else None for k in ok], index=s.index)

    return table.withColumn(out, run(text))


def bag_of_words(dim: int = 384) -> Callable[[list[str]], list[list[float]]]:
    """An offline provider: words hashed into `dim` buckets (h = 31 h + code, modulo dim), L2-normalised."""

    def provider(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = 0
                for c in w:
                    h = (h * 31 + ord(c)) % dim
                v[h] += 1
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return provider


def letters(texts: list[str]) -> list[np.ndarray]:
    """An offline provider: how often each of the letters a to z stands in a text, all texts of a batch in one pass."""
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    own = np.repeat(np.arange(len(data)), [len(d) for d in data])
    x = np.frombuffer(b"".join(data), np.uint8).astype(np.int64) - 97
    ok = (x >= 0) & (x < 26)
    return list(np.bincount(own[ok] * 26 + x[ok], minlength=26 * len(data)).reshape(-1, 26).astype(np.float32))


def external_scores(candidates: DataFrame, scorer: Callable[[list[str], list[str]], list[float]], batch: int = 16) -> DataFrame:
    """candidates (question, passage) plus external: a reranker's score, in batches of pairs."""

    @F.pandas_udf("double")
    def run(q: pd.Series, p: pd.Series) -> pd.Series:
        out: list[float] = []
        for i in range(0, len(q), batch):
            out += scorer(list(q[i : i + batch]), list(p[i : i + batch]))
        return pd.Series(out, index=q.index)

    return candidates.withColumn("external", run("question", "passage"))


def list_topics(documents: DataFrame, after: str | None = None, limit: int = 200) -> DataFrame:
    """One page of paths beyond a cursor with the totals of the whole; has_more comes from one row more than asked."""
    total = documents.agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"))
    page = documents.filter(F.col("relative_path") > after) if after else documents
    page = page.select("relative_path", "source").orderBy("relative_path").limit(limit + 1)
    w = Window.orderBy("relative_path")
    numbered = page.withColumn("_i", F.row_number().over(w)).withColumn("has_more", F.count("*").over(Window.partitionBy()) > limit)
    return numbered.filter(F.col("_i") <= limit).drop("_i").join(F.broadcast(total))


def read_documents(chunks: DataFrame, wanted: DataFrame, max_tokens: int = 4000) -> DataFrame:
    """relative_path, content, next_index of a batch of requests (path, optional heading): the exact path, else the only
    path that ends with it; passages in order with overlaps taken once, as many as fit the budget, one at least."""
    paths = chunks.select("relative_path").distinct()
    exact = wanted.join(paths, F.col("path") == F.col("relative_path"))
    rest = wanted.join(exact.select("path"), "path", "left_anti")
    # a suffix is a run of last path segments: exploded, so that the match is an equi-join
    parts = F.split("relative_path", "/")
    ends = paths.select("relative_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))).alias("path"))
    found = rest.join(ends, "path")
    only = found.groupBy("path", "heading").agg(F.count("*").alias("_n"), F.min("relative_path").alias("relative_path")).filter("_n = 1").drop("_n")
    hits = exact.select("path", "heading", "relative_path").unionByName(only)
    h, crumb = F.lower("heading"), F.lower("heading_path")
    picked = chunks.join(hits, "relative_path").filter(F.col("heading").isNull() | (crumb == h) | crumb.endswith(F.concat(F.lit(" > "), h)) | crumb.startswith(F.concat(h, F.lit(" > "))))
    parts_of = picked.groupBy("path", "heading", "relative_path").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))).alias("parts"))

    @F.pandas_udf("content string, next_index int")
    def join(parts: pd.Series) -> pd.DataFrame:
        out = []
        for p in parts:
            texts = [x["content"] for x in p]
            n = chunker.prefix_within(texts, max_tokens)
            text, _ = chunker.truncate_to_tokens(chunker.join_chunks(texts[:n]), max_tokens)
            out.append((text, int(p[n]["chunk_index"]) if n < len(p) else None))
        return pd.DataFrame(out, columns=["content", "next_index"]).astype({"next_index": "Int32"})

    return parts_of.withColumn("_r", join("parts")).select("path", "heading", "relative_path", "_r.content", "_r.next_index")


def whats_new(changes: DataFrame, since: Column, starts: Column, limit: int = 50) -> DataFrame:
    """The newest changes after since, whether the history reaches back that far, and whether more were cut."""
    rows = ingest.classify(ingest.journal(changes), since).withColumn("complete", since >= starts)
    page = rows.orderBy(F.desc("changed_at"), "relative_path").limit(limit + 1)
    w = Window.orderBy(F.desc("changed_at"), "relative_path")
    numbered = page.withColumn("_i", F.row_number().over(w)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > limit)
    return numbered.filter(F.col("_i") <= limit).drop("_i")


def accepted_reports(reports: DataFrame, per_hour: int = 20, text_limit: int = 2000, note_limit: int = 1000, key: str = "report_id") -> DataFrame:
    """Gap reports that a reporter's hourly number accepts (refused ones count for nothing), with text and note cut; the note is
    trimmed and null if nothing is left."""
    r = logbook.within_hourly_cap(reports, per_hour, key)
    note = F.regexp_replace(F.substring("note", 1, note_limit), r"^\s+|\s+$", "")
    return r.select("reporter", F.substring("query", 1, text_limit).alias("query"), F.when(note != "", note).alias("note"), "created_at")
