"""An inverted-file index for nearest-neighbour search: seeded k-means cells per tenant, a folder per cell.

Vectors of a tenant are told apart by the nearest of its centroids (by cosine), which are trained on a bounded sample. The
index is a Parquet table partitioned by cell; a search ranks the tenant's centroids for each question, reads only the folders
of the cells that some question probes, and scores exactly there. How many cells to probe is measured, not guessed:
`probes_for` ranks the cells of the true neighbours of a sample of questions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.retrieval import _matrix, dense
from quern.session import cut, small

MAX_CELLS = 1024
SAMPLE_PER_CELL = 64
ROUNDS = 12
FILE_ROWS = 500_000
QUESTION_BLOCK = 4096
#: Centroids of so many bytes are broadcast at once; more are taken tenant by tenant, in blocks of that size.
CENTROID_BYTES = 64 << 20


@dataclass
class Index:
    """path: vectors by cell; centroids: (tenant, cell, centroid), cells numbered across tenants."""

    spark: SparkSession
    path: str
    centroids: DataFrame

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def _cluster(x: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Unit centroids of unit rows: Lloyd rounds from rows drawn far from those before; an empty cell keeps its place."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(x))
    c = x[[rng.integers(len(x))]]
    far = 1 - x @ c[0]
    while len(c) < cells:
        p = np.maximum(far, 0)
        c = np.vstack((c, x[rng.choice(len(x), p=p / p.sum()) if p.sum() > 0 else rng.integers(len(x))]))
        far = np.minimum(far, 1 - x @ c[-1])
    for _ in range(ROUNDS):
        own = np.argmax(x @ c.T, axis=1)
        s = np.zeros_like(c)
        np.add.at(s, own, x)
        n = np.linalg.norm(s, axis=1, keepdims=True)
        c = np.where(n > 0, s / np.where(n > 0, n, 1), c)
    return c


def train(vectors: DataFrame, max_cells: int = MAX_CELLS, sample_per_cell: int = SAMPLE_PER_CELL, seed: int = 7) -> DataFrame:
    """(tenant, cell, centroid) from vectors (tenant, id, embedding): about sqrt(n) cells for a tenant of n vectors, max_cells at
    most, from the sample_per_cell * cells vectors with the smallest hash of their id. Cells are numbered across tenants."""
    n = vectors.filter("embedding IS NOT NULL").groupBy("tenant").agg(F.count("*").alias("_n"))
    want = n.withColumn("_cells", F.least(F.lit(max_cells), F.ceil(F.sqrt("_n"))).cast("int"))
    # a hash below the tenant's share keeps somewhat more than the sample, so that only those are sorted
    share = F.least(F.lit(1.0), 1.5 * F.col("_cells") * sample_per_cell / F.col("_n") + 64 / F.col("_n"))
    h = F.xxhash64("id", F.lit(seed))
    some = vectors.filter("embedding IS NOT NULL").join(small(want), "tenant").withColumn("_h", h).filter((F.pmod("_h", F.lit(1 << 30)) / float(1 << 30)) <= share)
    w = Window.partitionBy("tenant").orderBy("_h", "id")
    some = some.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= F.col("_cells") * sample_per_cell)

    def fit(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("_r").to_numpy())
        x, _ = _matrix(t.column("embedding").take(pa.array(order)))
        c = _cluster(x, t.column("_cells")[0].as_py(), seed)
        return pa.table({"tenant": pa.array([t.column("tenant")[0].as_py()] * len(c), pa.string()), "_k": pa.array(range(len(c)), pa.int32()), "centroid": pa.array(c.tolist(), pa.list_(pa.float64()))})

    made = cut(some.select("tenant", "embedding", "_cells", "_r").groupBy("tenant").applyInArrow(fit, "tenant string, _k int, centroid array<double>"), "centroids")
    first = made.groupBy("tenant").agg(F.count("*").alias("_c")).withColumn("_from", F.coalesce(F.sum("_c").over(Window.orderBy("tenant").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return cut(made.join(small(first.select("tenant", "_from")), "tenant").select("tenant", (F.col("_from") + F.col("_k")).cast("int").alias("cell"), "centroid"), "centroids")


def _blocks(centroids: DataFrame):
    """{tenant: (cells, matrix)} of tenants after tenants, each block of about CENTROID_BYTES."""
    block, size, names, cells, rows = {}, 0, None, [], []

    def close():
        if names is not None:
            block[names] = (np.array(cells), np.array(rows, np.float64))

    for r in centroids.orderBy("tenant", "cell").toLocalIterator():
        if r.tenant != names:
            close()
            if size >= CENTROID_BYTES:
                yield block
                block, size = {}, 0
            names, cells, rows = r.tenant, [], []
        cells.append(r.cell)
        rows.append(list(r.centroid))
        size += 8 * len(r.centroid)
    close()
    if block:
        yield block


def _nearest(rows: DataFrame, centroids: DataFrame, keep: list[str], p: int) -> DataFrame:
    """keep, cell, place (from 0): the p nearest cells of each row of (tenant, embedding, keep). Rows of a tenant without cells
    and rows without a vector give none."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    out = None
    for block in _blocks(centroids):
        shared = rows.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            for b in batches:
                tenants = np.array(b.column(0).to_pylist(), object)
                x, ok = _matrix(b.column(1))
                at = np.flatnonzero(ok)
                where, cell, place = [], [], []
                for t in sorted({t for t in tenants[at].tolist() if t in shared.value}):
                    ids, m = shared.value[t]
                    own = np.flatnonzero(tenants[at] == t)
                    best = np.argsort(-(x[own] @ m.T), axis=1, kind="stable")[:, :p]
                    where.append(np.repeat(at[own], best.shape[1]))
                    cell.append(ids[best.reshape(-1)])
                    place.append(np.tile(np.arange(best.shape[1]), len(own)))
                if where:
                    i = pa.array(np.concatenate(where))
                    yield pa.RecordBatch.from_arrays([*[b.column(2 + k).take(i) for k in range(len(keep))], pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(place), pa.int32())], names=[*keep, "cell", "place"])

        own = rows.filter(F.col("tenant").isin(list(block))) if len(block) <= 1000 else rows
        part = own.select("tenant", "embedding", *keep).mapInArrow(run, f"{fields}, cell int, place int")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows.sparkSession.createDataFrame([], f"{fields}, cell int, place int")


def build(vectors: DataFrame, path: str, **options) -> Index:
    """The index of vectors (tenant string, id, embedding), written to `path`. Null, empty and zero vectors are left out; repeated
    ids stand as often as they are given. A cell of many vectors is written by several tasks, FILE_ROWS rows each."""
    v = vectors.select(F.col("tenant").cast("string").alias("tenant"), "id", "embedding").filter(F.exists("embedding", lambda x: x != 0))
    centroids = train(v, **options)
    placed = _nearest(v, centroids, ["tenant", "id", "embedding"], 1).drop("place")
    placed = cut(placed, "index-cells")
    tasks = placed.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("_t"))
    dealt = placed.join(small(tasks), "cell").withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_t")))
    dealt.repartition("cell", "_part").select("tenant", "id", "embedding", "cell").write.partitionBy("cell").parquet(path)
    return Index(vectors.sparkSession, path, centroids)


def search(index: Index, questions: DataFrame, k: int, probes: int, digits: int | None = None) -> DataFrame:
    """(query_id, id, rank, cosine): the k best of the `probes` cells of its tenant that are nearest to each question (query_id,
    tenant, embedding). Only the folders of probed cells are read. Ties fall to the smaller id."""
    schema = f"query_id {questions.schema['query_id'].dataType.simpleString()}, id {index.vectors().schema['id'].dataType.simpleString()}, cosine double"
    q = questions.select("query_id", F.col("tenant").cast("string").alias("tenant"), "embedding").filter(F.exists("embedding", lambda x: x != 0))
    probed = _nearest(q, index.centroids, ["query_id", "embedding"], probes).groupBy("query_id", "embedding").agg(F.collect_list("cell").alias("cells"))
    found, block = None, []

    def within(rows: list) -> DataFrame:
        names = [r[0] for r in rows]
        m, _ = _matrix(pa.array([list(r[1]) for r in rows], pa.list_(pa.float64())))
        asked: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            for c in r[2]:
                asked.setdefault(c, []).append(i)
        shared = index.spark.sparkContext.broadcast((names, m, asked))

        def run(batches):
            for b in batches:
                names, m, asked = shared.value
                x, _ = _matrix(b.column(1))
                cells, ids = b.column(2).to_numpy(), np.asarray(b.column(0))
                out_q, out_i, out_s = [], [], []
                for c in np.unique(cells).tolist():
                    at = np.flatnonzero(cells == c)
                    s = m[asked[c]] @ x[at].T
                    if digits is not None:
                        s = np.round(s, digits)
                    for row, i in enumerate(asked[c]):
                        best = np.lexsort((ids[at], -s[row]))[:k]
                        out_q += [names[i]] * len(best)
                        out_i.append(at[best])
                        out_s.append(s[row][best])
                yield pa.RecordBatch.from_arrays([pa.array(out_q), b.column(0).take(pa.array(np.concatenate(out_i))), pa.array(np.concatenate(out_s))], names=["query_id", "id", "cosine"])

        # the list is bounded by the block of questions and their probes; as a filter on the folder it prunes them
        return index.vectors().filter(F.col("cell").isin(sorted(asked))).select("id", "embedding", "cell").mapInArrow(run, schema)

    for r in probed.toLocalIterator():
        block.append(r)
        if len(block) == QUESTION_BLOCK:
            part = within(block)
            found, block = part if found is None else found.unionByName(part), []
    if block:
        part = within(block)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = index.spark.createDataFrame([], schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "id", "rank", "cosine")


def folders_read(index: Index, questions: DataFrame, probes: int) -> DataFrame:
    """(read, all): files a search of these questions opens, and files of the index."""
    q = questions.select("query_id", F.col("tenant").cast("string").alias("tenant"), "embedding").filter(F.exists("embedding", lambda x: x != 0))
    cells = _nearest(q, index.centroids, ["query_id"], probes).select("cell").distinct()
    files = index.vectors().select("cell", F.col("_metadata.file_path").alias("_f")).distinct()
    return files.join(small(cells.withColumn("_asked", F.lit(True))), "cell", "left").agg(F.count("_asked").alias("read"), F.count("*").alias("all"))


def probes_for(index: Index, questions: DataFrame, k: int, target: float = 0.95) -> int:
    """The fewest cells to probe that hold `target` of the true neighbours of these questions (a bounded sample; each is scanned
    for exactly): the cells of all true neighbours are ranked by nearness to their question."""
    v = index.vectors().select("tenant", "id", "embedding", "cell")
    q = questions.select("query_id", F.col("tenant").cast("string").alias("tenant"), "embedding").filter(F.exists("embedding", lambda x: x != 0))
    q = cut(q, "index-sample")
    truth = None
    for t in [r[0] for r in q.select("tenant").distinct().toLocalIterator()]:
        own = dense(v.filter(F.col("tenant") == t), q.filter(F.col("tenant") == t), k, ("id", "cell")).select("query_id", "cell")
        truth = own if truth is None else truth.unionByName(own)
    if truth is None:
        return 1
    order = _nearest(q, index.centroids, ["query_id"], 1 << 20)
    met = truth.join(order, ["query_id", "cell"]).groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()
    total, upto = sum(r.n for r in met), 0
    for r in met:
        upto += r.n
        if upto >= target * total:
            return r.place + 1
    return 1
