"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables.

In each of TABLES tables a fast pseudo-rotation (three rounds of seeded sign flips and a Hadamard transform) turns a
unit vector, whose hash is the signed axis nearest to it. A query probes, in every table, the PROBES of 128 axes it is
nearest to (the same share of more axes, and more where k is a larger share of all rows, since the last of the k is then
hardly nearer than the rest: PROBES * (1 + PER_SHARE * k / rows)); what it meets there is scored exactly on the original vectors. If vectors
differ in length, the largest inner product is brought to the sphere first: rows are split into bands of squared length
between two powers of two, and get one more component that fills them up to the end of their band; a query probes
every band. A query that meets fewer than k rows (or all candidates, if they are fewer) is scored against all rows.

The axes of a table fall into GROUPS groups. A row travels once for each table and a query once for each group of axes it
probes, with the buckets it asks for there; vectors keep the source's number type. A group can hold any number of rows:
it is cut into chunks of bounded size by a hash of the id, and so are the queries that probe it; each (chunk of rows,
chunk of queries) is one block, where each bucket is scored against the queries that ask for it by one matrix product,
and which is reduced to k rows a query at once. Every row of every probed bucket is scored, whatever its size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quern.session import cut, small

TABLES = 2
PROBES = 48
PER_SHARE = 20
GROUPS = 4
ROUNDS = 3
MIN_BLOCK, MAX_ROWS, MAX_QUERIES = 512, 16_384, 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of the rows; their length is a power of two."""
    n = x.shape[1]
    h = 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def axes(x: np.ndarray, table: int, seed: int, top: int) -> np.ndarray:
    """The `top` nearest signed axes of each row after the table's rotation; axis i and its opposite are i and i + n."""
    n = 1 << max(1, math.ceil(math.log2(max(2, x.shape[1]))))
    rng = np.random.default_rng([seed, table, n])
    y = np.zeros((len(x), n))
    y[:, : x.shape[1]] = x
    for _ in range(ROUNDS):
        y = hadamard(y * rng.choice([-1.0, 1.0], n))
    both = np.concatenate([y, -y], axis=1)
    if top == 1:
        return both.argmax(axis=1)[:, None]
    return np.argsort(-both, axis=1, kind="stable")[:, :top]


def _matrix(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each dimension among the rows that take part."""
    by: dict[int, tuple[list, list]] = {}
    for i, v in enumerate(col.to_numpy(zero_copy_only=False)):
        if v is None or len(v) == 0:
            continue
        v = np.asarray(v, np.float64)  # a null component becomes NaN
        if np.isfinite(v).all() and v.any():
            rows, vs = by.setdefault(len(v), ([], []))
            rows.append(i)
            vs.append(v)
    return [(np.array(r), np.stack(v)) for r, v in by.values()]


def neighbours(table: DataFrame, k: int = 20, every: int = 20, tables: int = TABLES, probes: int = PROBES, seed: int = 13, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every row whose key is divisible by `every`.

    Rows with a null key, or a vector that is null, empty, zero or has null or non-finite components take no part.
    Only vectors of the query's own dimension are compared. Equal scores: the smaller key first. A repeated key counts
    once, with its best score; the query's own key is left out. Products beyond the range of doubles are what their sum
    gives, and not returned where that is no number. Other columns are ignored. Empty table: no rows.
    """
    source = table.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    low, high, members = source.filter(finite & F.exists("v", lambda x: x != 0)).agg(F.min(length), F.max(length), F.count("*")).first()
    schema = "id long, dim int, band int, vec binary, hash array<int>, probe array<array<int>>"
    if low is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    probes = probes * (1 + PER_SHARE * k / members)
    # squares beyond the range of doubles count as uneven: lengths are then taken from the exponents
    uneven = not (low > 0 and high < math.inf and high <= low * (1 + 1e-4))
    number = np.float32 if isinstance(table.schema[vector].dataType.elementType, FloatType) else np.float64

    def index(batches):
        for b in batches:
            ids = b.column(0).to_numpy()
            for rows, x in _matrix(b.column(1)):
                top = np.abs(x).max(axis=1, keepdims=True)
                small, power = np.frexp(top)  # top = small * 2**power
                data = x / top
                n2 = (data * data).sum(axis=1, keepdims=True)
                asked = data = data / np.sqrt(n2)
                band = np.zeros(len(x), np.int64)
                if uneven:
                    share, more = np.frexp(n2 * small * small)  # squared length = share * 2**(more + 2 power), share in [0.5, 1)
                    band = (more + 2 * power)[:, 0]
                    data = np.concatenate([data * np.sqrt(share), np.sqrt(1 - share)], axis=1)
                    asked = np.concatenate([asked, np.zeros((len(x), 1))], axis=1)
                wide = 2 << max(1, math.ceil(math.log2(max(2, data.shape[1]))))  # signed axes
                many = min(wide, math.ceil(probes * max(1, wide / 128)))
                own = np.concatenate([axes(data, t, seed, 1) for t in range(tables)], axis=1)
                probe: list = [None] * len(rows)
                q = np.flatnonzero(ids[rows] % every == 0)
                if len(q):
                    want = [axes(asked[q], t, seed, many) for t in range(tables)]
                    for n, i in enumerate(q.tolist()):
                        probe[i] = [w[n][w[n] * GROUPS // wide == g].tolist() for w in want for g in range(GROUPS)]
                # the group stands above the bucket: a reader needs no width
                own += (own * GROUPS // wide) << 24
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[rows]), pa.array(np.full(len(rows), x.shape[1]), pa.int32()), pa.array(band, pa.int32()), pa.array([r.tobytes() for r in x.astype(number)], pa.binary()), pa.array(own.tolist(), pa.list_(pa.int32())), pa.array(probe, pa.list_(pa.list_(pa.int32())))],
                    names=["id", "dim", "band", "vec", "hash", "probe"],
                )

    ix = cut(source.mapInArrow(index, schema), "ann-index")
    n = ix.count()
    row_block, query_block = (int(min(most, max(MIN_BLOCK, n // parts))) for most, parts in ((MAX_ROWS, 8), (MAX_QUERIES, 64)))
    at = ["dim", "tbl", "grp"]
    rows = ix.select("id", "dim", "band", "vec", F.posexplode("hash").alias("tbl", "_b"))
    rows = rows.select("id", "dim", "band", "vec", "tbl", F.shiftright("_b", 24).alias("grp"), F.array(F.col("_b").bitwiseAND(F.lit((1 << 24) - 1))).alias("buckets"))
    asks = ix.filter("probe IS NOT NULL").select("id", "dim", "vec", F.posexplode("probe").alias("_p", "buckets")).filter(F.size("buckets") > 0)
    asks = asks.select("id", "dim", "vec", F.floor(F.col("_p") / GROUPS).cast("int").alias("tbl"), (F.col("_p") % GROUPS).alias("grp"), "buckets")
    held = rows.groupBy(*at, "band").agg(F.ceil(F.count("*") / F.lit(row_block)).cast("int").alias("_rc"))
    asked = asks.groupBy(*at).agg(F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("_qc"))
    shape = cut(held.join(asked, at), "ann-shape")  # a group that nobody probes is left out
    part = lambda m: F.pmod(F.xxhash64("id"), F.col(m)).cast("int")
    spread = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    r = rows.join(small(shape), [*at, "band"]).select(*at, "band", part("_rc").alias("rc"), spread("_qc").alias("qc"), F.lit(False).alias("ask"), "id", "vec", "buckets")
    q = asks.join(small(shape), at).select(*at, "band", spread("_rc").alias("rc"), part("_qc").alias("qc"), F.lit(True).alias("ask"), "id", "vec", "buckets")

    def search(t: pa.Table) -> pa.Table:
        ask = t.column("ask").to_numpy(zero_copy_only=False).astype(bool)
        ids = t.column("id").to_numpy()
        x = np.frombuffer(b"".join(t.column("vec").to_pylist()), number).reshape(len(ids), -1).astype(np.float64)
        buckets = t.column("buckets").to_pylist()
        qi, qx, ri, rx = ids[ask], x[ask], ids[~ask], x[~ask]
        del x
        own = np.array([b[0] for b, a in zip(buckets, ask) if not a], np.int64)
        names, own = np.unique(own, return_inverse=True)
        order = np.argsort(own, kind="stable")
        ri, rx, ends = ri[order], rx[order], np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(names)))))
        place = {b: k for k, b in enumerate(names.tolist())}
        want = np.zeros((len(qi), len(names)), bool)
        for i, bs in enumerate(b for b, a in zip(buckets, ask) if a):
            want[i, [place[b] for b in bs if b in place]] = True
        out: list[list] = [[], [], []]
        for lo in range(0, len(qi), 256):
            s = np.full((len(qi[lo : lo + 256]), len(ri)), -np.inf)
            for k in range(len(names)):
                some = np.flatnonzero(want[lo : lo + 256, k])
                if len(some):
                    s[some, ends[k] : ends[k + 1]] = qx[lo + some] @ rx[ends[k] : ends[k + 1]].T
            s[(qi[lo : lo + 256, None] == ri[None, :]) | np.isnan(s)] = -np.inf
            kth = np.partition(s, -k_, axis=1)[:, -k_] if s.shape[1] > k_ else np.full(len(s), -np.inf)
            for i in range(len(s)):
                c = np.flatnonzero((s[i] >= kth[i] - 1e-9 * max(1.0, abs(kth[i]) if np.isfinite(kth[i]) else 1.0)) & (s[i] > -np.inf))
                exact = (rx[c] * qx[lo + i]).sum(axis=1)
                best = np.lexsort((ri[c], -exact))[:k_]
                out[0].append(np.full(len(best), qi[lo + i]))
                out[1].append(ri[c][best])
                out[2].append(exact[best])
        cols = [np.concatenate(o) if o else np.zeros(0) for o in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    k_ = k
    found = "query_id long, vec_id long, score double"

    def ranked(met: DataFrame) -> DataFrame:
        best = met.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    top = cut(ranked(r.unionByName(q).groupBy(*at, "band", "rc", "qc").applyInArrow(search, found)), "ann-top")
    # queries that met too few rows are scored against all of their dimension: one bucket, number 0
    size = ix.groupBy("dim").agg(F.count_distinct("id").alias("_ids"), F.ceil(F.count("*") / F.lit(row_block)).cast("int").alias("_rc"))
    queries = ix.filter("probe IS NOT NULL").select("id", "dim").distinct().join(top.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("_n")), "id", "left")
    short = cut(queries.join(small(size), "dim").filter(F.coalesce("_n", F.lit(0)) < F.least(F.lit(k), F.col("_ids") - 1)).select("id", "dim"), "ann-short")
    if short.isEmpty():
        return top
    every_row = small(cut(size.join(short.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(query_block)).cast("int").alias("_qc")), "dim"), "ann-all"))
    left = ix.filter("probe IS NOT NULL").join(short, ["id", "dim"], "left_semi").select("id", "dim", "vec")
    one = F.array(F.lit(0)).alias("buckets")
    r = ix.select("id", "dim", "vec").join(every_row, "dim").select("dim", part("_rc").alias("rc"), spread("_qc").alias("qc"), F.lit(False).alias("ask"), "id", "vec", one)
    q = left.join(every_row, "dim").select("dim", spread("_rc").alias("rc"), part("_qc").alias("qc"), F.lit(True).alias("ask"), "id", "vec", one)
    more = r.unionByName(q).groupBy("dim", "rc", "qc").applyInArrow(search, found)
    return ranked(top.select("query_id", "vec_id", "score").unionByName(more))
