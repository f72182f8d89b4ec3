"""Batched hybrid retrieval as one logical plan: many questions at once, exact, no index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.best import Best, Filters, few_tasks

RRF_K = 60
CANDIDATES = 50
COMMON_SHARE, COMMON_LEAST = 0.05, 10
PER_DOCUMENT = 2


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def normalise(v: str | Column) -> Column:
    n = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / n)


def rrf(rank: str | Column, k: int = RRF_K) -> Column:
    """1 / (k + rank); an absent rank adds nothing."""
    rank = F.col(rank) if isinstance(rank, str) else rank
    return F.coalesce(F.lit(1.0) / (F.lit(float(k)) + rank), F.lit(0.0))


QUESTION_BLOCK = 4096


def _matrix(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in double precision (a zero vector stays zero) and which rows have a vector."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    ok = np.asarray(col.is_valid())
    n = int(ok.sum())
    flat = np.asarray(col.drop_null().flatten(), np.float64)
    x = flat.reshape(n, -1) if n else np.zeros((0, 0))
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0), ok


def dense(chunks: DataFrame, questions: DataFrame, k: int = CANDIDATES, ids: tuple[str, ...] = ("chunk_id",), digits: int | None = None, match: dict[str, str] | None = None) -> DataFrame:
    """The k chunks nearest to each question by cosine: query_id, ids, dense_rank, cosine. Ties fall to the ids in order.

    Exact: every chunk meets every question, in blocks. Questions are read in blocks of QUESTION_BLOCK, each broadcast
    as one matrix; a batch of chunks is one matrix product, and a task keeps k rows per question of all its batches, so that
    only those are shuffled. digits rounds cosines before they are compared. Rows without a vector take no part.
    match: columns of both sides that must be `equal`, or begin with the question's as a path (`prefix`); a null of the
    question asks for nothing. Chunks that do not match are left out before the k are chosen.
    """
    schema = T.StructType([T.StructField("query_id", questions.schema["query_id"].dataType), *[chunks.schema[c] for c in ids], T.StructField("cosine", T.DoubleType())])
    match = match or {}
    narrow = few_tasks(chunks.select("embedding", *ids, *match))
    slack = 0.0 if digits is None else 10.0**-digits  # what rounding can add
    found, block = None, []

    def near(rows: list) -> DataFrame:
        names = [r[0] for r in rows]
        q, _ = _matrix(pa.array([list(r[1]) for r in rows], pa.list_(pa.float64())))
        shared = chunks.sparkSession.sparkContext.broadcast((names, q, Filters(list(match.values()), [tuple(r[2:]) for r in rows]) if match else None))

        def run(batches):
            asked, m, filters = shared.value
            best, kinds = Best(len(m), k, len(ids)), []
            for b in batches:
                x, ok = _matrix(b.column(0))
                if not len(x):
                    continue
                at = pa.array(np.flatnonzero(ok))
                kinds = [b.schema.field(1 + i).type for i in range(len(ids))]
                keys = [np.asarray(b.column(1 + i).take(at)) for i in range(len(ids))]
                if filters:
                    apart = ~filters.admits([b.column(1 + len(ids) + c).take(at).to_pylist() for c in range(len(match))], len(x))
                for lo in range(0, len(m), 256):
                    s = m[lo : lo + 256] @ x.T
                    if filters:
                        s[apart[filters.of[lo : lo + 256]]] = -np.inf
                    bar = best.bar[lo : lo + 256].copy()
                    new = np.isneginf(bar)
                    if s.shape[1] > k and new.any():
                        bar[new] = np.partition(s[new], -k, axis=1)[:, -k]
                    who, c = np.nonzero((s >= bar[:, None] - slack) & (s > -np.inf))
                    score = s[who, c]
                    best.add(who + lo, score if digits is None else np.round(score, digits), *[key[c] for key in keys])
            if rows := best.rows():
                who, score, *keys = rows
                yield pa.RecordBatch.from_arrays([pa.array(asked).take(pa.array(who)), *[pa.array(c, from_pandas=True).cast(t) for c, t in zip(keys, kinds)], pa.array(score)], names=schema.names)

        return narrow.mapInArrow(run, schema)

    for r in questions.select("query_id", "embedding", *match).filter("embedding IS NOT NULL").toLocalIterator():
        block.append(r)
        if len(block) == QUESTION_BLOCK:
            part = near(block)
            found, block = part if found is None else found.unionByName(part), []
    if block or found is None:
        part = near(block) if block else chunks.sparkSession.createDataFrame([], schema)
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), *ids)
    return found.withColumn("dense_rank", F.row_number().over(w)).filter(F.col("dense_rank") <= k).select("query_id", *ids, "dense_rank", "cosine")


def rows_ahead(rows: DataFrame, questions: DataFrame, key: str, owner: str) -> DataFrame:
    """query_id, ahead: how many rows of other owners are nearer (1 - inner product, exact) than the nearest row of the
    question's own owner. The question's own row is left out; a question whose owner has no other row has none.

    Two passes of block products: one finds the nearest own row of each question, one counts what lies before it.
    """
    narrow = rows.select(key, owner, "embedding").filter("embedding IS NOT NULL")

    def blocks():
        block = []
        for r in questions.select("query_id", owner, "embedding").filter("embedding IS NOT NULL").toLocalIterator():
            block.append(tuple(r))
            if len(block) == QUESTION_BLOCK:
                yield block
                block = []
        yield block

    def products(block, per):
        """per(products of a batch with the block's questions, own mask, other mask) -> a number for each question."""
        ids, owners = np.array([b[0] for b in block]), [b[1] for b in block]
        shared = rows.sparkSession.sparkContext.broadcast((ids, owners, np.array([list(b[2]) for b in block], np.float64)))

        def run(batches):
            for b in batches:
                ids, owners, q = shared.value
                x = np.array(b.column(2).to_pylist(), np.float64)
                k, own = b.column(0).to_numpy(zero_copy_only=False), np.array(b.column(1).to_pylist(), object)
                if not len(x):
                    continue
                where = {o: own == o for o in set(owners)}
                same = np.stack([where[o] for o in owners])
                apart = ids[:, None] != k[None, :]
                v = per(1 - q @ x.T, same & apart, ~same & apart, ids)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(v.astype(np.float64))], names=["query_id", "v"])

        return narrow.mapInArrow(run, "query_id long, v double")

    found = None
    for block in blocks():
        if not block:
            continue
        nearest = products(block, lambda d, same, other, ids: np.where(same, d, np.inf).min(axis=1))
        near = {r[0]: r[1] for r in nearest.groupBy("query_id").agg(F.min("v")).collect() if r[1] < float("inf")}

        def before(d, same, other, ids, near=near):
            bound = np.array([near.get(i, -np.inf) for i in ids.tolist()])
            return (other & (d < bound[:, None])).sum(axis=1)

        part = products([b for b in block if b[0] in near], before) if near else None
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id long, ahead long")
    return found.groupBy("query_id").agg(F.sum("v").cast("long").alias("ahead"))


def common_threshold(chunks: DataFrame, by: str = "project", share: float = COMMON_SHARE, least: int = COMMON_LEAST) -> DataFrame:
    """(by, total, common_at): terms found in that many chunks or more carry no weight."""
    t = chunks.groupBy(by).agg(F.count("*").alias("total"))
    return t.withColumn("common_at", F.greatest(F.ceil(F.col("total") * F.lit(share)), F.lit(least)).cast("long"))


def fuse(dense_list: DataFrame, lexical_list: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of two ranked lists with the reciprocal-rank score of both."""
    both = dense_list.join(lexical_list, keys, "full_outer")
    return both.withColumn("fused", rrf("dense_rank") + rrf("lexical_rank"))


def page(fused: DataFrame, order: list[Column], document: str = "doc_id", cap: int = PER_DOCUMENT, limit: int = 5) -> DataFrame:
    """At most `cap` rows per question and document in the given total order, then the first `limit` of what is left."""
    d = Window.partitionBy("query_id", document).orderBy(*order)
    q = Window.partitionBy("query_id").orderBy(*order)
    capped = fused.withColumn("_in_document", F.row_number().over(d)).filter(F.col("_in_document") <= cap)
    return capped.withColumn("position", F.row_number().over(q)).filter(F.col("position") <= limit).drop("_in_document")


def neighbours(chunks: DataFrame, n: int = 1) -> DataFrame:
    """chunks plus before and after: the text of up to n chunks on either side in the document, in order."""
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    before = F.collect_list("content").over(w.rowsBetween(-n, -1)) if n else F.array()
    after = F.collect_list("content").over(w.rowsBetween(1, n)) if n else F.array()
    return chunks.withColumn("before", F.array_join(before, "\n")).withColumn("after", F.array_join(after, "\n"))


def identifier_shaped(text: str | Column) -> Column:
    """Whether a question looks like an identifier: an underscore, `::`, a dotted name, or a token of four characters or
    more with a digit, a lower-to-upper step or two capitals together."""
    t = F.col(text) if isinstance(text, str) else text
    whole = t.contains("_") | t.contains("::") | t.rlike(r"[A-Za-z0-9]\.[A-Za-z0-9]")
    token = F.exists(F.split(t, r"\s+"), lambda x: (F.length(x) >= 4) & x.rlike(r"[0-9]|[a-z][A-Z]|[A-Z]{2}"))
    return whole | token


def effective_floor(instance: Column, project: Column) -> Column:
    """0 if the instance has none (its master switch), else the project's own, else the instance's."""
    return F.when(F.coalesce(instance, F.lit(0.0)) <= 0, F.lit(0.0)).otherwise(F.coalesce(project, instance))


def verdict(hits: DataFrame, questions: DataFrame, floor: Column) -> DataFrame:
    """query_id, outcome: no_match without hits; below_floor if the first hit's cosine is under a positive floor, unless
    the question is identifier-shaped and some hit was found by its words; else results."""
    h = hits.groupBy("query_id").agg(F.min_by("cosine", "position").alias("top"), F.bool_or(F.col("lexical_rank").isNotNull()).alias("lexical"))
    q = questions.join(h, "query_id", "left").withColumn("_floor", floor)
    below = (F.col("_floor") > 0) & (F.col("top") < F.col("_floor")) & ~(identifier_shaped("text") & F.col("lexical"))
    return q.select("query_id", F.when(F.col("top").isNull(), "no_match").when(below, "below_floor").otherwise("results").alias("outcome"), "top")


def rerank(fused: DataFrame, scores: DataFrame, order: list[Column]) -> DataFrame:
    """fused with an external score: best first, a missing score last, then the fused order (a stable sort)."""
    w = Window.partitionBy("query_id").orderBy(*order)
    f = fused.withColumn("fused_position", F.row_number().over(w)).join(scores, ["query_id", "doc_id", "chunk_index"], "left")
    r = Window.partitionBy("query_id").orderBy(F.col("external").desc_nulls_last(), "fused_position")
    return f.withColumn("reranked", F.row_number().over(r))
