"""Near duplicates by exact Jaccard similarity of word-shingle sets; candidates come from bands of circulant MinHash, in the
pipeline's stage from multi-index hashing of 64-bit fingerprints too.

A text is the set of its shingles (a text of fewer words is one shingle). Two texts link if 100 * intersection >= 80 *
union, in whole numbers. Candidates share a band of ROWS coordinates in one of BANDS bands: a pair at 0.8 is missed with
probability (1 - 0.8**4)**28 = 4e-7, one above it less often. Fingerprints (majority votes of a set's hashes) within two
bits are candidates as well; they reach almost equal texts only. Every candidate is verified on the complete sets.

Texts of equal sets are one node. In each bucket all nodes are first compared with its smallest one, which is linear
and joins most members of a large group. Where the others of a bucket are still more than one component, they are then
compared pair by pair in blocks of bounded size (the smallest one has met them all); a block returns a spanning forest of
its links, so rows grow with members, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import simhash
from quern.llm import textkernel as tk
from quern.llm.circulant import band_keys
from quern.llm.components import components
from quern.session import cut, small

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 28, 4
SEED = 42
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 500_000


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE):
    """Per piece: the first row, all shingle hashes, and their offsets per text (none for a text without words)."""
    for i, _, data, off in tk.pieces(texts):
        low = tk.LOWER[data]
        s, e, wo = tk.spans(low, off, tk.NOT_SPACE)
        h = tk.word_hashes(low, s, e)
        g, at = tk.grams(h, wo, shingle)
        count = np.diff(wo)
        short = np.flatnonzero((count > 0) & (count < shingle))
        if len(short):
            own = np.zeros(len(short), np.uint64)
            for n, k in enumerate(short.tolist()):
                own[n] = xxhash.xxh64_intdigest(h[wo[k] : wo[k + 1]].tobytes(), SEED)
            g, at = np.concatenate([g, own]), np.concatenate([at, wo[short]])
            order = np.argsort(at, kind="stable")
            g, at = g[order], at[order]
        yield i, g, np.searchsorted(at, wo)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int, votes: bool = False) -> DataFrame:
    """_h, doc_id, _node (hash of the set, 0 for an empty one), n (its size), bands and _fp of every row: the fingerprint of
    the set if votes are asked for, else 0."""

    def run(batches):
        for batch in batches:
            node, size, fp = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            keys = np.zeros((batch.num_rows, bands), np.int64)
            for i, g, off in shingle_sets(batch.column(2), shingle):
                some = np.flatnonzero(np.diff(off))
                if len(some):
                    keys[i + some] = band_keys(g, off[some], bands, rows).view(np.int64)
                for k in some.tolist():
                    own = np.unique(g[off[k] : off[k + 1]])
                    size[i + k] = len(own)
                    node[i + k] = np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64)
                    if votes:
                        fp[i + k] = np.uint64(simhash.fingerprint(own)).view(np.int64)
            flat = pa.ListArray.from_arrays(np.arange(0, (batch.num_rows + 1) * bands, bands, dtype=np.int32), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node), pa.array(size), flat, pa.array(fp)], names=["_h", "doc_id", "_node", "n", "bands", "_fp"])

    return docs.select("_h", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "_h long, doc_id long, _node long, n long, bands array<long>, _fp long")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    """_node and its sorted set, from rows (_node, text)."""

    def run(batches):
        for batch in batches:
            out = [b""] * batch.num_rows
            for i, g, off in shingle_sets(batch.column(1), shingle):
                for k in np.flatnonzero(np.diff(off)).tolist():
                    out[i + k] = np.unique(g[off[k] : off[k + 1]]).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["_node", "set"])

    return docs.select("_node", "text").mapInArrow(run, "_node long, set binary")


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Jaccard similarity of two sorted sets is `percent` of a hundred or more."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def forest(sets: list[np.ndarray], part: np.ndarray, label: list, percent: int) -> list[tuple[int, int]]:
    """Links that join what similar pairs join, beyond equal labels; pairs lie within one part or, if there are two, across."""
    names: dict = {}
    comp = np.array([names.setdefault(x, len(names)) for x in label])
    size = np.array([len(s) for s in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    start = np.concatenate(([0], np.cumsum(size)))
    mark = np.zeros(int(ids.max()) + 1, bool)
    cross = len(np.unique(part)) > 1
    out = []
    for i in range(len(sets)):
        own = ids[start[i] : start[i + 1]]
        away = comp != comp[i]
        away &= (part > part[i]) if cross else (np.arange(len(sets)) > i)
        away &= 100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i])
        j = np.flatnonzero(away)
        if not len(j):
            continue
        mark[own] = True
        at = np.repeat(start[j] - np.concatenate(([0], np.cumsum(size[j])[:-1])), size[j]) + np.arange(int(size[j].sum()))
        both = np.add.reduceat(mark[ids[at]].astype(np.int64), np.concatenate(([0], np.cumsum(size[j])[:-1])))
        mark[own] = False
        for k in j[100 * both >= percent * (size[i] + size[j] - both)].tolist():
            if comp[k] != comp[i]:
                comp[comp == comp[k]] = comp[i]
                out.append((i, k))
    return out


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: nodes (_node, _fp) whose fingerprints differ in two bits at most, by multi-index hashing. The smallest node
    stands for all of one fingerprint and is paired with each of them, so rows grow with nodes, not pairs."""
    fps = cut(nodes.groupBy("_fp").agg(F.min("_node").alias("_rep")), "nd-fps")
    equal = nodes.join(fps, "_fp").filter("_node <> _rep").select(F.col("_rep").alias("a"), F.col("_node").alias("b"))
    ends = [fps.select(F.col("_fp").alias(k), F.col("_rep").alias(f"_{k}")) for k in ("a", "b")]
    near = simhash.links(fps.select("_fp")).join(ends[0], "a").join(ends[1], "b")
    return equal.unionByName(near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")))


def undecided(others: DataFrame, label: DataFrame) -> DataFrame:
    """t, key, _node, root, _m (parts that its bucket is dealt into): the rows (t, key, _node, n) of the buckets that are more than
    one component. The smallest node of a bucket, which has met all others, is not among the rows."""
    named = others.select("t", "key", "_node", "n").join(label, "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    chunks = F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int")
    mixed = named.groupBy("t", "key").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi"), chunks.alias("_m")).filter("_lo <> _hi").select("t", "key", "_m")
    return named.join(mixed, ["t", "key"]).select("t", "key", "_node", "root", "_m")


def similar_nodes(rows: DataFrame, docs: DataFrame, shingle: int, percent: int, votes: bool = False) -> DataFrame:
    """(node, root) of the nodes that have a link; rows as signatures() gives them, docs with _h and text. votes: nodes with
    near fingerprints are compared too."""
    first = [F.first(c).alias(c) for c in ("n", "bands", "_fp")]
    nodes = cut(rows.filter("n > 0").groupBy("_node").agg(F.min("_h").alias("_h"), *first), "nd-nodes")
    keys = nodes.select("_node", "n", F.posexplode("bands").alias("t", "key"))
    held = keys.groupBy("t", "key").agg(F.min("_node").alias("hub"), F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    met = cut(keys.join(held, ["t", "key"]), "nd-met")
    others = met.filter("_node <> hub")
    star = others.select(F.col("hub").alias("a"), F.col("_node").alias("b"))
    star = cut((star.unionByName(fingerprint_pairs(nodes.select("_node", "_fp"))) if votes else star).distinct(), "nd-star")
    paired = star.select(F.col("a").alias("_node")).union(star.select("b")).distinct()
    wanted = nodes.join(paired, "_node", "left_semi").select("_node", "_h")
    sets = cut(_sets(docs.select("_h", "text").join(wanted, "_h"), shingle).groupBy("_node").agg(F.first("set").alias("set")), "nd-sets")

    def verify(batches):
        for b in batches:
            ok = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3))]
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    pairs = star.join(sets.select(F.col("_node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("_node").alias("b"), F.col("set").alias("y")), "b")
    first = cut(pairs.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long"), "nd-links")
    label = components(first).select(F.col("node").alias("_node"), "root")

    parts = undecided(others, label).withColumn("part", F.pmod(F.xxhash64("_node"), F.col("_m")).cast("int"))
    parts = parts.select("t", "key", "_node", "root", "part", F.explode(F.sequence(F.lit(0), F.col("_m") - 1)).alias("_o"))
    blocks = parts.select("t", "key", F.least("part", "_o").alias("i"), F.greatest("part", "_o").alias("j"), "_node", "root", "part").join(sets, "_node")

    def search(t: pa.Table) -> pa.Table:
        ids = t.column("_node").to_pylist()
        part = t.column("part").to_numpy()
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        found = []
        if i == j or len(np.unique(part)) > 1:
            found = forest([np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("set")], part, t.column("root").to_pylist(), percent)
        return pa.table({"a": pa.array([ids[x] for x, _ in found], pa.int64()), "b": pa.array([ids[y] for _, y in found], pa.int64())})

    rest = cut(blocks.groupBy("t", "key", "i", "j").applyInArrow(search, "a long, b long"), "nd-links")
    return components(first.unionByName(rest))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles (size of the set), component_id (smallest doc_id that links reach), kept (doc_id = component_id): one
    row for each row of docs.

    Texts without words, null texts too, are linked with nothing: each is its own component. Rows are told apart by doc_id
    and text, so rows that share an id are nodes of their own, and rows without an id take part; they get their component's
    smallest id, null if it has none, and are never kept. Equal rows are linked unless they have no words. Empty table: no
    rows. Other columns are ignored.
    """
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", F.xxhash64(F.isnull("doc_id"), "doc_id", F.isnull("text"), "text"))
    found = cut(signatures(hashed, shingle, bands, rows), "nd-rows")
    label = similar_nodes(found, hashed, shingle, percent).select(F.col("node").alias("_node"), "root")
    nodes = found.filter("n > 0").groupBy("_node").agg(F.min("doc_id").alias("_first")).join(label, "_node", "left").withColumn("root", F.coalesce("root", "_node"))
    nodes = cut(nodes, "nd-named")
    first = nodes.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = cut(nodes.select("_node", "root").join(first, "root").select("_node", "component_id"), "nd-ids")
    some = found.filter("n > 0").join(named, "_node").select("doc_id", "n", "component_id")
    none = found.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, that are kept: one row of each component, that with the smallest doc_id (null last).

    Rows are told apart by all their columns, not by doc_id: rows that share an id, or have none, take part like others.
    Texts without words are one component. Columns may have any names. Empty table: empty result.
    """
    plain = [F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(docs.columns)]
    own = [f"k_{i}" for i in range(len(plain))]
    hashed = docs.select(*plain, F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", F.xxhash64(*[F.isnull(c) for c in own], *own))
    rows = cut(signatures(hashed, shingle, BANDS, ROWS, votes=True), "nd-rows")
    label = similar_nodes(rows, hashed, shingle, percent, votes=True).select(F.col("node").alias("_node"), "root")
    # equal rows share _h: how often it stands tells whether the kept row must be cut to one
    same = rows.groupBy("_h", "doc_id", "_node").agg(F.count("*").alias("_c"))
    best = same.join(label, "_node", "left").groupBy(F.coalesce("root", "_node").alias("_root")).agg(F.min(F.struct(F.isnull("doc_id").alias("_none"), "doc_id", "_h", "_c")).alias("_k"))
    kept = cut(best.select("_k._h", "_k._c"), "nd-kept")
    once = hashed.join(small(kept.filter("_c = 1").select("_h")), "_h", "left_semi")
    often = hashed.join(small(kept.filter("_c > 1").select("_h")), "_h", "left_semi").dropDuplicates(["_h"])
    return once.unionByName(often).select(*[F.col(k).alias(c) for k, c in zip(own, docs.columns)])
