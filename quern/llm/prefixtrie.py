"""The prefix trie of conversations by prefix-doubling naming.

Turns are named first: equal turns (role, text) get one dense number. In round k the numbers of two neighbouring blocks of
2**(k-1) turns make a pair, and equal pairs get one dense number: the name of a block of 2**k turns. Only blocks that begin
at a multiple of their length are named, so a round joins half the rows of the round before, and as many rounds are needed
as the longest conversation has binary digits. A prefix of d turns is made of one block for each binary digit of d; their
names, side by side, are the name of the prefix, and conversations that share it are the members of one node.

A node is known by its smallest member and its depth, and that member's path below the node belongs to the node's subtree.
Each node therefore counts once in the sums of one conversation: sums over a subtree are sums over the members of a node of
what their own conversation counts from that depth on, so no pair of ancestor and descendant is ever listed.

No task holds a conversation: turns are put in order over range partitions, sums along a conversation are taken in
stretches of SPAN turns. Names that many conversations share make heavy joins, which are written at once, so that adaptive
execution splits them. The digest of a node's ends reads its ids in order as a stream of joined pieces.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut

WORD = r"[^\x20\x09-\x0D]+"
SHARE, HEAD_TURNS = 20, 4
SPAN = 4096
PIECE_IDS = 8192
#: Sampled for the range partitions in place of whole texts; texts are compared in full within a partition.
ORDER_CHARS = 32
_IDX = (1 << 33) - 1


def _part(g: str = "_g") -> Column:
    return F.shiftright(g, 33)


def ordered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, key, words): the turns of each conversation from 0, by turn (null first), role, text; key is the
    SHA-256 of role and text. Null role or text: empty. Turns without a conv_id take no part."""
    t = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    at = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    t = t.repartitionByRange(*at, F.substring("text", 1, ORDER_CHARS)).sortWithinPartitions(*at, "text")
    key = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    t = cut(t.select("conv_id", key.alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("_g")), "trie-turns")
    held = t.groupBy("conv_id", _part().alias("_pid")).agg(F.min("_g").alias("_lo"), F.count("*").alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    held = cut(held.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).select("conv_id", "_pid", (F.col("_from") - F.col("_lo")).alias("_shift")), "trie-parts")
    return cut(t.withColumn("_pid", _part()).join(held, ["conv_id", "_pid"]).select("conv_id", (F.col("_g") + F.col("_shift")).alias("pos"), "key", "words"), "trie-placed")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, pos, key, words, len) of the rebuilt conversations, and (conv_id, len) of all of them, turnless ones too.

    Conversation c takes the first h turns of conversation c - c % 20 and its own turns after its first h, h = crc32(c) % 4."""
    t = ordered(turns)
    convs = t.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = cut(convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARE).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % HEAD_TURNS), "trie-convs")
    base = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("_base"))
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("_base", F.lit(0))))
    convs = cut(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "trie-convs")
    heads = t.filter(F.col("pos") < HEAD_TURNS - 1).withColumnRenamed("conv_id", "base")
    first = convs.join(heads, "base").filter("pos < h").select("conv_id", "pos", "key", "words", "len")
    rest = t.join(convs, "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "words", "len")
    return cut(first.unionByName(rest), "trie-rebuilt"), convs.select("conv_id", "len")


def dense(rows: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """The distinct values of `by`, numbered from 0 without gaps."""
    d = cut(rows.select(*by).distinct().withColumn("_g", F.monotonically_increasing_id()), "trie-names")
    counts = d.groupBy(_part().alias("_pid")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    start = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    return d.withColumn("_pid", _part()).join(F.broadcast(start), "_pid").select(*by, (F.col("_from") + F.col("_g").bitwiseAND(F.lit(_IDX))).alias(name))


def block_names(turns: DataFrame, longest: int) -> list[DataFrame]:
    """For each k with 2**k <= longest: (conv_id, j, name, len), the names of the blocks of turns j * 2**k to (j+1) * 2**k - 1.
    The first also has words."""
    level = cut(turns.join(dense(turns, ["key"]), "key").select("conv_id", F.col("pos").alias("j"), "name", "len", "words"), "trie-blocks")
    levels = [level]
    while 2 ** len(levels) <= longest:
        side = lambda odd: F.max(F.when(F.col("j") % 2 == odd, F.col("name")))
        pairs = level.groupBy("conv_id", F.shiftright("j", 1).alias("half")).agg(side(0).alias("a"), side(1).alias("b"), F.max("len").alias("len"))
        pairs = cut(pairs.filter("a IS NOT NULL AND b IS NOT NULL"), "trie-pairs")
        level = cut(pairs.join(dense(pairs, ["a", "b"]), ["a", "b"]).select("conv_id", F.col("half").alias("j"), "name", "len"), "trie-blocks")
        levels.append(level)
    return levels


def prefixes(levels: list[DataFrame]) -> tuple[DataFrame, list[str]]:
    """(conv_id, d, words of the d-th turn, len, names): every prefix of one turn or more; names[k] is that of the block for
    binary digit k of d, -1 if the digit is 0."""
    parts = []
    for k, level in enumerate(levels):
        if k == 0:
            own = level.select("conv_id", (F.col("j") + 1).alias("d"), F.lit(0).alias("k"), F.when(F.col("j") % 2 == 0, F.col("name")).alias("name"), "len", "words")
        else:  # a block at an even place is the last but smaller ones of every d up to the end of its right neighbour
            upto = F.least((F.col("j") + 2) * 2**k - 1, F.col("len"))
            own = level.filter("j % 2 = 0").select("conv_id", F.explode(F.sequence((F.col("j") + 1) * 2**k, upto)).alias("d"), F.lit(k).alias("k"), "name", "len", F.lit(None).cast("long").alias("words"))
        parts.append(own)
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    names = [f"b{k}" for k in range(len(levels))]
    which = [F.coalesce(F.max(F.when(F.col("k") == k, F.col("name"))), F.lit(-1)).alias(b) for k, b in enumerate(names)]
    return cut(rows.groupBy("conv_id", "d").agg(F.max("words").alias("words"), F.max("len").alias("len"), *which), "trie-prefixes"), names


def end_digests(ends: DataFrame) -> DataFrame:
    """(m, d, ends_sha256) of rows (m, d, conv_id): SHA-256 of each node's ids in ascending order, joined by commas.

    Ids are put in order over range partitions and joined in pieces of PIECE_IDS there; a digest then reads the pieces of a
    node one after the other and holds none of them (SHA-256 is sequential: that is as far as it can be dealt out)."""

    def pieces(batches):
        for b in batches:
            m, d, c = (b.column(k).to_pylist() for k in range(3))
            out, i = [], 0
            while i < len(m):
                j = i + 1
                while j < len(m) and j - i < PIECE_IDS and m[j] == m[i] and d[j] == d[i]:
                    j += 1
                out.append((m[i], d[i], c[i], ",".join(map(str, c[i:j]))))
                i = j
            yield pa.RecordBatch.from_arrays([*[pa.array([x[k] for x in out], pa.int64()) for k in range(3)], pa.array([x[3] for x in out], pa.string())], names=["m", "d", "first", "ids"])

    def digests(batches):
        node, state = None, None
        for b in batches:
            out = []
            for m, d, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist()):
                if (m, d) == node:
                    state.update(b"," + ids.encode())
                else:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (m, d), hashlib.sha256(ids.encode())
            yield _digest_batch(out)
        if node is not None:
            yield _digest_batch([(*node, state.hexdigest())])

    joined = ends.repartitionByRange("m", "d", "conv_id").sortWithinPartitions("m", "d", "conv_id").mapInArrow(pieces, "m long, d long, first long, ids string")
    return joined.repartition("m", "d").sortWithinPartitions("m", "d", "first").mapInArrow(digests, "m long, d long, ends_sha256 string")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["m", "d", "ends_sha256"])


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.

    Repeated turns stand as often as they are given; turns with equal numbers follow each other by role, then text. Turns
    without a conv_id take no part. Empty table: no rows, not even a root. Other columns are ignored.
    """
    rows, convs = rebuilt(turns)
    found = convs.agg(F.min("conv_id").alias("root"), F.max("len").alias("longest"), F.count("*").alias("n")).first()
    top = turns.sparkSession.range(1 if found.n else 0).select(F.lit(found.root).cast("long").alias("m"), F.lit(0).cast("long").alias("d"), F.lit(found.n).alias("n"), *[F.lit(0).cast("long").alias(c) for c in ("saved", "leaves", "children")], F.lit(None).cast("long").alias("parent"))
    root = F.lit(found.root).cast("long")
    if not found.n or not found.longest:
        counted, ends = top, convs.select(root.alias("m"), F.lit(0).cast("long").alias("d"), "conv_id")
    else:
        p, names = prefixes(block_names(rows, found.longest))
        nodes = cut(p.groupBy("d", *names).agg(F.min("conv_id").alias("m"), F.count("*").alias("n"), F.max("len").alias("deepest")), "trie-nodes")
        w = cut(p.join(nodes, ["d", *names]).select("conv_id", "d", "m", "n", "words", "len", "deepest"), "trie-members")
        ends = w.filter("d = len").select("m", "d", "conv_id").unionByName(convs.filter("len = 0").select(root.alias("m"), F.lit(0).cast("long").alias("d"), "conv_id"))
        counted = top.unionByName(_subtrees(w, root))
    sums = counted.groupBy("m", "d").agg(F.max("n").alias("n_convs"), F.max("parent").alias("parent_conv_id"), *[F.sum(c).alias(c) for c in ("children", "leaves", "saved")])
    out = sums.join(cut(end_digests(ends), "trie-ends"), ["m", "d"], "left")
    none = hashlib.sha256(b"").hexdigest()
    leaves = F.when(F.col("children") == 0, F.lit(1)).otherwise(F.col("leaves"))
    return out.select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", F.col("children").alias("n_children"),
        leaves.cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def _subtrees(w: DataFrame, root: Column) -> DataFrame:
    """(m, d, n, saved, leaves, children, parent): what each member row adds to its node, and to the node above it."""
    w = w.withColumn("_v", F.when(F.expr("conv_id = m"), (F.col("n") - 1) * F.col("words")).otherwise(0)).withColumn("_l", F.when(F.expr("conv_id = m AND deepest = d"), 1).otherwise(0).cast("long"))
    w = w.withColumn("_blk", F.floor((F.col("d") - 1) / SPAN))
    blocks = w.groupBy("conv_id", "_blk").agg(F.sum("_v").alias("_v"), F.sum("_l").alias("_l"), F.max("m").alias("_m"))
    along = Window.partitionBy("conv_id").orderBy("_blk")
    after, before = along.rowsBetween(1, Window.unboundedFollowing), along.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "_blk", F.coalesce(F.sum("_v").over(after), F.lit(0)).alias("_va"), F.coalesce(F.sum("_l").over(after), F.lit(0)).alias("_la"), F.max("_m").over(before).alias("_mb"))
    down = Window.partitionBy("conv_id", "_blk").orderBy(F.col("d").desc())
    x = w.join(blocks, ["conv_id", "_blk"])
    x = x.withColumn("saved", F.sum("_v").over(down) + F.col("_va")).withColumn("leaves", F.sum("_l").over(down) + F.col("_la"))
    # the smallest member can only grow with depth, so that of the last turn before this stretch is the largest so far
    x = x.withColumn("parent", F.coalesce(F.lead("m").over(down), "_mb", root))
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    own = F.struct("m", "d", "n", "saved", "leaves", zero.alias("children"), "parent")
    first = F.expr("conv_id = m").cast("long")
    above = F.struct(F.col("parent").alias("m"), (F.col("d") - 1).alias("d"), null.alias("n"), F.when(F.col("d") == 1, F.col("saved")).otherwise(zero).alias("saved"), F.when(F.col("d") == 1, F.col("leaves")).otherwise(zero).alias("leaves"), first.alias("children"), null.alias("parent"))
    both = F.when(F.expr("d = 1 OR conv_id = m"), F.array(own, above)).otherwise(F.array(own))
    return x.select(F.inline(both))
