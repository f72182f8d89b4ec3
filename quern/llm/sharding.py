"""Sharding by proportional stratified interleaving, in DataFrame operations only.

Every row gets a seeded pseudo-random key. Within its source it is ranked by that key; its fractional rank is
(rank + offset of the source) / rows of the source, so each source is spread evenly over [0, 1). All rows are
then put in order of fractional rank and cut into runs of equal length: each shard holds each source in the
corpus's own proportion, and shard sizes differ by one row at most (law "rows").

Neither ranking sorts a whole source or the whole table in one task. Ranks come from counts per hash bucket
(partial aggregation, prefix sums over the counts) plus a row number inside one small bucket. The number of
buckets follows the number of rows, so a bucket holds about ROWS_PER_BUCKET rows at every scale, also for a
source with a third of the corpus. Texts are never shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.equalrows import crowded, numbered
from quern.session import cut

ROWS_PER_BUCKET = 64
MAX_BUCKETS = 1 << 20
HASH_BITS = 60


def seeded(seed: int, text):
    """60 uniform bits of a text: the first 15 hex digits of an MD5 digest, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), text)), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(counts: DataFrame, by: list[str], bucket: str, blocks: int) -> DataFrame:
    """Exclusive prefix sums of n over bucket, within by. Two levels: sums of blocks, then inside each block,
    so that no window spans more than about sqrt(buckets) rows."""
    coarse = counts.withColumn("_blk", F.floor(F.col(bucket) / blocks))
    sums = coarse.groupBy(*by, "_blk").agg(F.sum("n").alias("_bn"))
    w = Window.partitionBy(*by).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "_blk", F.coalesce(F.sum("_bn").over(w), F.lit(0)).alias("_base"))
    v = Window.partitionBy(*by, "_blk").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    fine = coarse.withColumn("_in", F.coalesce(F.sum("n").over(v), F.lit(0)))
    return fine.join(sums, [*by, "_blk"]).select(*by, bucket, (F.col("_base") + F.col("_in")).alias("_before"))


def interleave(rows: DataFrame, n_shards: int, seed: int = 17, source: str = "source", key: str = "doc_id", tie: str | None = None) -> DataFrame:
    """rows plus shard (int, from 0) and slot (long, gapless from 0 in its shard).

    A null source is a stratum of its own; a null or repeated key is allowed (ties fall to `tie`, then between
    equal rows either may come first, which leaves the result's values the same). Fewer rows than shards: the
    rest stay empty. An empty table gives an empty table. `rows` should be narrow: it is written out once. Rows are
    hashed by key and tie; where many are equal in both (null keys, a key with a third of all rows), each also by its
    number among them, so that no bucket grows with a key.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    tie = tie or key
    kept = rows.columns
    base = cut(
        rows.withColumn("_src", F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))).withColumn(
            "_h", seeded(seed, F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.col(tie).cast("string")))
        ),
        "shard",
    )
    base = numbered(base, ["_src", "_h"], crowded(base, ["_src", "_h"]))
    base = base.withColumn("_h", F.when(F.col("_no").isNull(), F.col("_h")).otherwise(seeded(seed, F.concat_ws(":", "_h", "_no")))).drop("_no")
    total = base.count()
    if total == 0:
        return base.select(*kept, F.lit(0).cast("int").alias("shard"), F.lit(0).cast("long").alias("slot"))
    bits = max(1, min(int(math.log2(MAX_BUCKETS)), math.ceil(math.log2(max(2, total / ROWS_PER_BUCKET)))))
    buckets, blocks = 1 << bits, 1 << max(1, bits // 2)
    base = base.withColumn("_b", F.shiftright("_h", HASH_BITS - bits))

    counts = base.groupBy("_src", "_b").agg(F.count("*").alias("n"))
    per_source = counts.groupBy("_src").agg(F.sum("n").alias("_n_src"))
    before = _prefix(counts, ["_src"], "_b", blocks).join(per_source, "_src")
    w = Window.partitionBy("_src", "_b").orderBy("_h", key, tie)
    ranked = base.withColumn("_i", F.row_number().over(w) - 1).join(before, ["_src", "_b"])
    offset = seeded(seed, F.col("_src")) / float(1 << HASH_BITS)
    frac = (F.col("_before") + F.col("_i") + offset) / F.col("_n_src")
    placed = cut(
        ranked.withColumn("_f", frac).withColumn("_c", F.least(F.floor(F.col("_f") * buckets), F.lit(buckets - 1))).drop("_before", "_i", "_n_src", "_b"),
        "shard",
    )
    order = placed.groupBy("_c").agg(F.count("*").alias("n")).withColumn("_all", F.lit(1))
    before = _prefix(order, ["_all"], "_c", blocks).drop("_all")
    w = Window.partitionBy("_c").orderBy("_f", "_src", "_h", key, tie)
    out = placed.withColumn("_j", F.row_number().over(w) - 1).join(before, "_c").withColumn("_p", F.col("_before") + F.col("_j"))
    # row p of N goes to shard floor(p * k / N); shard i starts at row ceil(i * N / k)
    shard = F.expr(f"(_p * {n_shards}) div {total}")
    start = F.expr(f"(shard * {total} + {n_shards - 1}) div {n_shards}")
    return out.withColumn("shard", shard).withColumn("slot", F.col("_p") - start).select(*kept, F.col("shard").cast("int"), F.col("slot").cast("long"))


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 17) -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text, null: none, plus 16), text_crc32, law "rows", shard, slot and
    grown_shard (null under this law). Null texts have size 16 and the checksum of no bytes (0); null and repeated ids,
    repeated rows and null sources take part like others; other columns are ignored. Empty table: no rows. The law "rows"
    makes counts equal to one row, so equal texts are dealt over all shards, not kept together."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    out = interleave(narrow, n_shards, seed, tie="text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
