"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations only.

Each source has a token budget. As many whole passes over the source as fit are taken from every document; the
rest of the budget is filled by documents whose hash lies below a threshold. The threshold is found without
sorting: tokens are summed by source and hash bucket, prefix sums over the buckets find where the budget runs
out, and only that boundary bucket is refined by the next hash bits. After the last level what is left of the
budget is smaller than the document on the boundary; further rounds give one more copy to documents that fit the rest
and stand below MAX_REPEAT copies, until no document fits: the mix ends near the target even where one document is a
large part of its source. Each round writes the documents that still fit, without texts, and the next reads only those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.equalrows import crowded, numbered
from quern.session import cut, small

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEAT = 3
BITS = 16
LEVELS = 3
HASHED = ["_src", "_h"]
#: Sources up to which plans are broadcast.
FEW = 100_000


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, budget: float = 1.0) -> DataFrame:
    """(_src, source_size) -> plus target. Sources in code-point order, null last, take the weights in turn; the
    targets share `budget` of all tokens by weight, none above max_repeat times its source's size.

    Resharing the excess by weight until none is above has one fixed point: target = min(cap, level * weight).
    The level is found from the sources in order of cap / weight: it is the one at which the sources below it
    are at their caps and the others share the rest.
    """
    by_name = Window.orderBy(F.col("_null"), F.col("_src"))
    pick = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("_w", F.get(pick, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))))
    s = s.withColumn("_cap", F.col("source_size") * F.lit(float(max_repeat)))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_null"), F.col("_src"))
    s = (
        s.withColumn("_total", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("_caps_before", F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_w_from", F.sum("_w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    )
    # the first source whose cap exceeds its share fixes the level; where all are capped, nothing is left to share
    level = (F.col("_total") - F.col("_caps_before")) / F.col("_w_from")
    s = s.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    s = s.withColumn("_level", F.max("_level").over(everything))
    return s.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap"))))


def _fill(rows: DataFrame, budgets: DataFrame, near) -> DataFrame:
    """The rows (_src, _h, _size) that the budgets (_src, _left) take: those below each source's nested threshold.

    Returns (_src, _room, _cut, _rest): take rows with _h < _cut of the budget _room, which leaves _rest. The boundary
    bucket is refined LEVELS times; the document on the boundary is not taken. A budget that covers the whole source gives a
    cut above every hash, one of nothing a cut of 0. near: marks a table of a row per source for broadcast if they are few.
    """
    state = budgets.select("_src", F.col("_left").alias("_room"), F.lit(0).cast("long").alias("_cut"), F.col("_left").alias("_rest"), (F.col("_left") <= 0).alias("_done"))
    shift = BITS * LEVELS
    for _ in range(LEVELS):
        shift -= BITS
        span = 1 << (shift + BITS)
        inside = rows.join(near(state), "_src").filter(f"NOT _done AND _h >= _cut AND _h < _cut + {span}")
        b = inside.groupBy("_src", F.expr(f"_h div {1 << shift}").alias("_b")).agg(F.sum("_size").alias("_n"), F.first("_rest").alias("_of"))
        b = b.withColumn("_to", F.sum("_n").over(Window.partitionBy("_src").orderBy("_b")))
        over = F.when(F.col("_to") > F.col("_of"), F.struct("_b", (F.col("_to") - F.col("_n")).alias("_used")))
        first = b.groupBy("_src").agg(F.min(over).alias("_x"), F.max("_to").alias("_all"))
        state = state.join(first, "_src", "left").select(
            "_src", "_room",
            F.when(F.col("_done"), F.col("_cut")).when(F.col("_x").isNull(), F.col("_cut") + F.lit(span)).otherwise(F.col("_x._b") * F.lit(1 << shift)).alias("_cut"),
            F.when(F.col("_done"), F.col("_rest")).when(F.col("_x").isNull(), F.col("_rest") - F.coalesce("_all", F.lit(0))).otherwise(F.col("_rest") - F.col("_x._used")).alias("_rest"),
            (F.col("_done") | F.col("_x").isNull()).alias("_done"),
        )
        state = cut(state, "mix")
    return state.drop("_done")


def tagged(df: DataFrame, key: str, source: str, size, seed: int, tie=None) -> DataFrame:
    """df plus _null, _src, _size and _h: what a plan is made from and applied to. The hash is of key, size and tie;
    of rows equal in these and many (a key with a third of a source), each also hashes its number among them."""
    # the first 48 bits of an MD5 digest, which any SQL engine can repeat
    digest = lambda text: F.conv(F.substring(F.md5(text), 1, BITS * LEVELS // 4), 16, 10).cast("long")
    tie = F.lit("") if tie is None else tie
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")), F.col("_size").cast("string"), tie)
    named = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    out = df.withColumn("_size", size.cast("long")).withColumn("_null", F.col(source).isNull()).withColumn("_src", named)
    return out.withColumn("_h", digest(text))


def apart(base: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Tagged rows with a hash of their own where many share one (hot)."""
    renamed = F.conv(F.substring(F.md5(F.concat_ws(":", "_h", "_no")), 1, BITS * LEVELS // 4), 16, 10).cast("long")
    return numbered(base, HASHED, hot).withColumn("_h", F.when(F.col("_no").isNull(), F.col("_h")).otherwise(renamed)).drop("_no")


def _copies(max_repeat: int):
    """Copies of a row by its source's plan: whole passes, the first fill, and each later round that it fits below the limit."""
    start = F.col("_full") + F.when((F.col("_full") < max_repeat) & (F.col("_h") < F.col("_rounds")[0]["_cut"]), F.lit(1)).otherwise(F.lit(0))
    later = F.slice("_rounds", F.lit(2), F.greatest(F.size("_rounds") - 1, F.lit(0)))
    fits = lambda n, r: (n < max_repeat) & (F.col("_size") > 0) & (F.col("_size") <= r["_room"]) & (F.col("_h") < r["_cut"])
    return F.aggregate(later, start.cast("int"), lambda n, r: n + F.when(fits(n, r), F.lit(1)).otherwise(F.lit(0)))


def plan(base: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, budget: float = 1.0) -> DataFrame:
    """One row per source of tagged rows: source_size, target, whole passes and the rounds' budgets and thresholds.

    A round leaves less than the document on its boundary, which fitted, so there are about as many rounds as the largest
    document has binary digits; each takes at least the first document that fits, so they end."""
    sizes = base.groupBy("_src", "_null").agg(F.sum("_size").alias("source_size"))
    p = targets(sizes, weights, max_repeat, budget).select("_src", "source_size", "target")
    p = p.withColumn("_full", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeat))).otherwise(F.lit(0)).cast("int"))
    p = cut(p.withColumn("_left", F.when(F.col("_full") < max_repeat, F.floor(F.col("target") - F.col("_full") * F.col("source_size"))).otherwise(F.lit(0)).cast("long")), "mix")
    few = p.limit(FEW + 1).count() <= FEW
    near = F.broadcast if few else (lambda df: df)
    rounds = [_fill(base, p.select("_src", "_left"), near)]
    copies = F.col("_full") + F.when(F.col("_h") < F.col("_cut"), 1).otherwise(0)
    rows = base.join(near(p.select("_src", "_full")), "_src")
    while True:
        rows = rows.join(near(rounds[-1]), "_src").withColumn("_n", copies.cast("int"))
        rows = cut(rows.filter(F.col("_n") < max_repeat).filter("_size > 0 AND _size <= _rest").select("_src", "_h", "_size", "_n"), "mix-fits")
        if rows.isEmpty():
            break
        rounds.append(_fill(rows, rounds[-1].select("_src", F.col("_rest").alias("_left")), near))
        copies = F.col("_n") + F.when(F.col("_h") < F.col("_cut"), 1).otherwise(0)
    steps = None
    for k, r in enumerate(rounds):
        step = r.select("_src", F.struct(F.lit(k).alias("_k"), "_room", "_cut").alias("_r"))
        steps = step if steps is None else steps.unionByName(step)
    steps = steps.groupBy("_src").agg(F.array_sort(F.collect_list("_r")).alias("_rounds"))
    return cut(p.join(steps, "_src"), "mix")


def copies(df: DataFrame, p: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """Tagged rows plus source_size, target and copies, by the plan alone: rows are not shuffled where it is small."""
    return df.join(small(p), "_src").withColumn("_copies", _copies(max_repeat))


def mix(rows: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", weights=WEIGHTS, max_repeat: int = MAX_REPEAT, budget: float = 1.0, seed: int = 29, tie: str | None = None) -> DataFrame:
    """rows plus source_size, target, copies (int) and taken = copies * size. `rows` should be narrow: it is written once.

    copies is at most max_repeat. Rows of size 0 (or null size) cost nothing: they take the whole passes of their
    source and one more copy if their hash is below the threshold. Null source: a source of its own. Rows of equal
    key, size and tie (a string column, as a hash of the text) are taken together if they are few; where they are many, null
    keys among them, each has a hash of its own. Empty table: empty result.
    """
    kept = rows.columns
    base = cut(tagged(rows, key, source, F.coalesce(F.col(size), F.lit(0)), seed, None if tie is None else F.col(tie)), "mix")
    base = apart(base, crowded(base, HASHED))
    out = copies(base, plan(base, weights, max_repeat, budget), max_repeat)
    return out.select(*kept, "source_size", "target", F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).cast("long").alias("taken"))


def words():
    """Words of the text column; none for a null text."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def digest():
    """A hash of the text column; that of no characters for a null text."""
    return F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size (words), source_size, target, taken, copies, source. Null texts have size 0."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words().alias("size"), digest().alias("_tie"))
    return mix(rows, tie="_tie", **options).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def mixed(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, budget: float = 1.0, seed: int = 29) -> DataFrame:
    """The mixture itself: each row of docs, all columns, as many times as the mix takes it. Null texts have size 0, null and
    repeated ids take part as in mix(), columns of any name are carried through. Empty table: empty result."""
    kept = docs.columns
    narrow = tagged(docs.select("doc_id", "source", "text"), "doc_id", "source", words(), seed, digest()).select("_src", "_null", "_size", "_h")
    base = cut(narrow, "mix")
    hot = crowded(base, HASHED)
    p = plan(apart(base, hot), weights, max_repeat, budget)
    rows = docs.select([F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(kept)] + [F.col(c) for c in ("doc_id", "source", "text")])
    rows = tagged(rows, "doc_id", "source", words(), seed, digest()).drop("doc_id", "source", "text")
    # equal rows get the same set of hashes here as in the plan, whichever of them gets which
    out = copies(apart(rows, hot), p, max_repeat).filter("_copies > 0")
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return out.select([F.col(f"k_{i}").alias(c) for i, c in enumerate(kept)])
