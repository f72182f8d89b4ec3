"""Searches hand on as many rows as questions ask for, whatever they read; results are those of plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import lexical, retrieval
from quern.operators.best import TASKS_A_CORE, Best
from quern.plans import registry


def test_kept_rows_are_the_best_of_all():
    rng = np.random.default_rng(1)
    who, score, a, b = rng.integers(0, 6, 300_000), rng.integers(0, 40, 300_000) / 8, rng.integers(0, 300, 300_000), rng.permutation(300_000)
    best = Best(7, 50, 2)
    for lo in range(0, len(who), 7_000):
        part = slice(lo, lo + 7_000)
        ok = score[part] >= best.bar[who[part]]
        best.add(who[part][ok], score[part][ok], a[part][ok], b[part][ok])
    got = list(zip(*(c.tolist() for c in best.rows())))
    want = sorted(zip(who.tolist(), (-score).tolist(), a.tolist(), b.tolist()))
    assert got == [(w, -s, x, y) for q in range(7) for w, s, x, y in [r for r in want if r[0] == q][:50]]
    assert best.bar[6] == -np.inf and np.isfinite(best.bar[:6]).all()


def exchanged(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(30)]
    rows = [("en" if d % 3 else "de", d, i, [rng.choice(words) for _ in range(rng.randrange(0, 9))]) for d in range(400) for i in range(3)]
    chunks = spark.createDataFrame(rows, "config string, doc_id long, chunk_index int, tokens array<string>").repartition(90)
    asked = [(q, c, f"w{t}", n, 3) for q in range(8) for c in ("en", "de") for n, t in enumerate(rng.sample(range(30), 3))]
    return rows, chunks, asked, spark.createDataFrame(asked, "query_id long, config string, stem string, no int, n long")


@pytest.mark.parametrize("every", [False, True])
def test_a_task_hands_on_k_chunks_a_question(spark, corpus, every, monkeypatch):
    rows, chunks, asked, terms = corpus
    monkeypatch.setattr(lexical, "PAIRS", 5)  # several blocks of questions
    found = terms.select("config", F.col("stem").alias("term"), "stem").distinct()
    handed = lexical.best(chunks, terms, found, 4, every)
    tasks = TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert handed.rdd.getNumPartitions() <= 4 * tasks  # 90 partitions in each of four blocks otherwise
    got = {}
    for r in sorted(lexical.ranked(handed, 4).collect(), key=lambda r: r.lexical_rank):
        got.setdefault((r.query_id, r.config), []).append((r.doc_id, r.chunk_index))
    want, own = {}, {}
    for q, c, t, n, _ in asked:
        own.setdefault((q, c), {})[t] = n
    for (q, c), ts in own.items():
        scored = []
        for config, d, i, tokens in rows:
            at = [(p, ts[t]) for p, t in enumerate(tokens, 1) if t in ts]
            if config != c or not at or (every and len({t for _, t in at}) < 3):
                continue
            holds = [(x, y) for x in range(len(at)) for y in range(x, len(at)) if len({t for _, t in at[x : y + 1]}) == 3]
            least = [h for h in holds if not any(o != h and h[0] <= o[0] and o[1] <= h[1] for o in holds)]
            density = sum(0.1 / (1 + at[y][0] - at[x][0] - (y - x)) for x, y in least) if every else 0.1 * len(at)
            scored.append((-round(density / np.log(len(tokens) + 1), 9), len(tokens), i, d))
        if scored:
            want[q, c] = [(d, i) for _, _, i, d in sorted(scored)[:4]]
    assert got == want


def test_counts_alone_are_shuffled(corpus):
    """Frequencies of stems with several forms: right, and no chunk is named in a shuffle."""
    rows, chunks, _, terms = corpus
    found = terms.select("config", F.col("stem").alias("term"), F.substring("stem", 1, 2).alias("stem")).distinct()
    df = lexical.frequencies(chunks, found, True)
    assert not any("doc_id" in line or "chunk_index" in line for line in exchanged(df))
    forms, want = {(r.config, r.term): r.stem for r in found.collect()}, {}
    for c, _, _, tokens in rows:
        for s in {forms[c, t] for t in tokens if (c, t) in forms} | {""}:
            want[c, s] = want.get((c, s), 0) + 1
    assert {(r.config, r.stem): r.df for r in df.collect()} == want


def test_dense_search_over_many_batches(spark, monkeypatch):
    """The best rows of a task with many batches, in few tasks: each hands on k rows a question."""
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(3000, 4)).round(1), rng.normal(size=(3, 4))
    chunks = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").repartition(90)
    questions = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<double>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        hits = retrieval.dense(chunks, questions, 5, ("id",), digits=9)
        assert f"Coalesce {TASKS_A_CORE * spark.sparkContext.defaultParallelism}" in hits._jdf.queryExecution().executedPlan().toString()
        got = [(r.query_id, r.dense_rank, r.id) for r in hits.orderBy("query_id", "dense_rank").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    cosine = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ (x / np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]).T, 9)
    assert got == [(i, r + 1, int(c)) for i in range(3) for r, c in enumerate(np.lexsort([np.arange(3000), -cosine[i]])[:5])]


def test_rerank_reads_the_fused_list_it_has_written(spark, sf):
    """Both sides of its join come from one search."""
    assert not any("documents" in f for f in registry.queries()["t6_rerank"](spark, sf).inputFiles())


def test_filters_apply_where_chunks_are_scored(spark, corpus):
    """Requests with filters find the k best of what they admit, with no join of scored chunks to their documents."""
    rows, chunks, asked, terms = corpus
    found = terms.select("config", F.col("stem").alias("term"), "stem").distinct()
    wants = {q: (f"s{q % 3}" if q % 2 else None, "a/1" if q % 4 == 0 else None) for q in range(8)}
    requests = spark.createDataFrame([(q, *w) for q, w in wants.items()], "query_id long, source string, path string")
    placed = chunks.withColumn("source", F.expr("concat('s', doc_id % 3)")).withColumn("path", F.expr("concat('a/', doc_id % 20, '/', doc_id)"))
    handed = lexical.best(placed, terms, found, 4, match={"source": "equal", "path": "prefix"}, asked=requests)
    assert not any("hashpartitioning" in line or "Join" in line for line in exchanged(handed))
    got = {}
    for r in sorted(lexical.ranked(handed, 4).collect(), key=lambda r: r.lexical_rank):
        got.setdefault((r.query_id, r.config), []).append((r.doc_id, r.chunk_index))
    want = {}
    for q, c in {(a[0], a[1]) for a in asked}:
        ts, (source, path) = {a[2] for a in asked if a[:2] == (q, c)}, wants[q]
        own = [(d, i, t) for config, d, i, t in rows if config == c and source in (None, f"s{d % 3}") and (path is None or f"a/{d % 20}/{d}".startswith(path + "/"))]
        scored = [(-round(0.1 * sum(w in ts for w in t) / np.log(len(t) + 1), 9), len(t), i, d) for d, i, t in own if ts & set(t)]
        if scored:
            want[q, c] = [(d, i) for _, _, i, d in sorted(scored)[:4]]
    assert got == want and 0 < len(got) < 16  # some admit nothing
