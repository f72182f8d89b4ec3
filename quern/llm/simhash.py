"""SimHash near-duplicates by multi-index hashing.

A text's 64-bit fingerprint is the majority vote, bit by bit, over the XXH64 hashes of its word shingles. Two
fingerprints link at Hamming distance `radius` (2) or less. They are cut into two segments of 32 bits; by the
pigeonhole principle two that link either differ in at most one bit of the upper segment or agree in the lower.
Each fingerprint therefore looks up the small ball of radius 1 around its upper segment, and its lower segment
itself, in tables of segment values, and complete distances decide. A pair whose segments differ in one bit is
found from the side that has a 0 there, so only such flips are probed.

Segment values held by more than HOT_BUCKET fingerprints (many near copies of one text) would yield all pairs of
a group. For the fingerprints that hold or probe such a value the lookup goes on inside the other segment: the
key is then a complete fingerprint, own or with one bit flipped. Two fingerprints share such a key exactly if
they differ in two bits at most, a key has at most 65 of them, and linking each to the smallest keeps every
component whole with one row per key. No pair is dropped on either way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textkernel as tk
from quern.llm.components import components
from quern.session import cut

SHINGLE = 3
SEED = 42
HOT_BUCKET = 16
_VOTES = 1 << 15


def fingerprint(shingles: list[int] | np.ndarray) -> int:
    """Majority of each bit over hashes; 0 for none. Exactly half of them set: the bit is 0."""
    if not len(shingles):
        return 0
    n, votes = len(shingles), np.zeros(64, np.int64)
    h = np.array(shingles, np.uint64)
    for i in range(0, n, _VOTES):
        bits = np.unpackbits(h[i : i + _VOTES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _joined(data: np.ndarray, off: np.ndarray):
    """Lower-cased bytes in which each word is followed by one space; the starts of words there, and words per text."""
    s, e, wo = tk.spans(data, off, tk.NOT_SPACE)
    if len(s) == 0:
        return b"", np.zeros(1, np.int64), wo
    keep = tk.NOT_SPACE[data]
    length = e - s
    start = np.zeros(len(s) + 1, np.int64)
    np.cumsum(length + 1, out=start[1:])
    out = np.full(int(start[-1]), 0x20, np.uint8)
    # word i begins at start[i]: its bytes are the kept bytes so far plus one space per earlier word
    at = np.arange(int(length.sum())) + np.repeat(np.arange(len(s)), length)
    out[at] = tk.LOWER[data[keep]]
    return out.tobytes(), start, wo


def fingerprints(texts: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The signed 64-bit fingerprint of each text."""
    out = np.zeros(len(texts), np.int64)
    xxh = xxhash.xxh64_intdigest
    for i, _, data, off in tk.pieces(texts):
        buf, start, wo = _joined(data, off)
        begin, end = start.tolist(), (start - 1).tolist()
        for k in range(len(off) - 1):
            a, b = int(wo[k]), int(wo[k + 1])
            if a == b:
                continue
            m = max(1, b - a - shingle + 1)
            width = min(shingle, b - a)
            hashes = [xxh(buf[x:y], seed) for x, y in zip(begin[a : a + m], end[a + width : a + width + m])]
            v = fingerprint(hashes)
            out[i + k] = v - (1 << 64) if v >= 1 << 63 else v
    return out


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and _fp of every row, repeated and null ids included; a null or empty text has fingerprint 0."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fingerprints(b.column(1), shingle, seed))], names=["doc_id", "_fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(run, "doc_id long, _fp long")


def links(fps: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(a, b) over distinct fingerprints (_fp): enough of the pairs at distance 1 or 2 to keep every component whole;
    all of them but those between members of hot buckets, which are linked through shared keys."""
    half = (1 << 32) - 1
    upper = F.shiftrightunsigned("_fp", 32)
    lower = F.col("_fp").bitwiseAND(F.lit(half))
    bits32 = F.sequence(F.lit(0), F.lit(31))
    # the upper table's keys are even, the lower table's odd
    entries = fps.select("_fp", F.explode(F.array(upper * 2, lower * 2 + 1)).alias("key"))
    flips = F.transform(F.filter(bits32, lambda i: F.expr("shiftrightunsigned(_fp, 32)").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) == 0), lambda i: (F.expr("shiftrightunsigned(_fp, 32)") + F.call_function("shiftleft", F.lit(1).cast("long"), i)) * 2)
    probes = fps.select("_fp", F.explode(F.concat(F.array(upper * 2, lower * 2 + 1), flips)).alias("key"))
    held = entries.groupBy("key").agg(F.count("*").alias("_n"))
    hot = cut(held.filter(F.col("_n") > hot_bucket).select("key"), "mih-hot")
    cold = entries.join(hot, "key", "left_anti")
    near = (
        probes.withColumnRenamed("_fp", "a").join(cold.withColumnRenamed("_fp", "b"), "key").filter("a <> b AND bit_count(a ^ b) <= 2").select("a", "b")
    )
    dense = probes.join(hot, "key", "left_semi").select("_fp").distinct()
    whole = F.concat(F.array("_fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("_fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    keyed = dense.select("_fp", F.explode(whole).alias("key"))
    hub = keyed.groupBy("key").agg(F.collect_set("_fp").alias("_m")).filter(F.size("_m") > 1)  # 65 at most
    star = hub.select(F.array_min("_m").alias("a"), F.explode("_m").alias("b")).filter("a <> b")
    return near.unionByName(star)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id that links reach).

    Texts without words have fingerprint zero and link like others. Rows without a doc_id take part and get their
    component's smallest id, null if it has none. Empty table: no rows. Other columns are ignored.
    """
    rows = cut(with_fingerprints(docs, shingle, seed), "simhash")
    fps = cut(rows.groupBy("_fp").agg(F.min("doc_id").alias("_first")), "simhash-fps")
    label = components(links(fps.select("_fp"), hot_bucket)).select(F.col("node").alias("_fp"), "root")
    named = fps.join(label, "_fp", "left").withColumn("root", F.coalesce("root", "_fp"))
    ids = named.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = cut(named.join(ids, "root").select("_fp", "component_id"), "simhash-ids")
    out = rows.join(named, "_fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
