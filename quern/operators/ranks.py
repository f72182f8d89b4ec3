"""Ranks and running sums over a whole table without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut

#: Lists of distinct values up to this length are added up in one task and broadcast; longer ones over range partitions.
BOUNDED = 100_000


def below(counts: DataFrame, value: str, n: str, within: str | None = None) -> DataFrame:
    """counts (one row for each value, without nulls) plus _below: the sum of n over all smaller values, of the same `within`.

    Values are dealt over range partitions, which sampling makes about equally long however the values are spread. Sums of
    partitions (a row each) are added up in one task, the values of a partition in a task of their own."""
    by = [within] if within else []
    c = cut(counts.repartitionByRange(*by, value).withColumn("_cell", F.spark_partition_id()), "ranks")
    before = Window.partitionBy(*by).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = c.groupBy(*by, "_cell").agg(F.sum(n).alias("_s")).select(*by, "_cell", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_from"))
    inside = Window.partitionBy(*by, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(cells, [*by, "_cell"])
    return c.withColumn("_below", F.col("_from") + F.col("_in")).drop("_cell", "_from", "_in")


def ranks(rows: DataFrame, wanted: dict[str, tuple[str, bool]], bounded: int = BOUNDED) -> DataFrame:
    """rows plus a rank over the whole table for each name: (column, descending). Equal values share a rank, nulls one too: the
    first if ascending, the last if descending. Columns are numbers (compared as doubles).

    Up to `bounded` rows are ranked as they are, each column in one task; they are counted first, so they should be written.
    Of more, the values of all columns are counted in one pass, and ranks are joined back by value, as a broadcast if the list of
    values is short, which no common value can slow down."""
    if rows.limit(bounded + 1).count() <= bounded:
        for name, (c, down) in wanted.items():
            v = F.col(c).cast("double")
            last = F.when(F.col(c).isNull(), 2 if down else 0).otherwise(1)
            rows = rows.withColumn(name, F.rank().over(Window.partitionBy(F.lit(0)).orderBy(last, -v if down else v)).cast("long"))
        return rows
    entries = [F.struct(F.lit(name).alias("_what"), (-F.col(c).cast("double") if down else F.col(c).cast("double")).alias("_v"), (F.col(c).isNull() != F.lit(down)).alias("_first")) for name, (c, down) in wanted.items()]
    counts = cut(rows.select(F.inline(F.array(*entries))).groupBy("_what", "_v", "_first").agg(F.count("*").alias("_c")), "ranks")
    # nulls go before or after all numbers: their place is that of an infinity, which they share with none
    order = [F.when(F.col("_v").isNull(), F.when(F.col("_first"), 0).otherwise(2)).otherwise(1), F.col("_v")]
    if counts.count() <= bounded:
        w = Window.partitionBy("_what").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        known = counts.select("_what", "_v", (F.coalesce(F.sum("_c").over(w), F.lit(0)) + 1).alias("_rank"))
        near = F.broadcast
    else:
        numbers = below(counts.filter("_v IS NOT NULL"), "_v", "_c", "_what")
        nulls = counts.groupBy("_what").agg(F.coalesce(F.sum(F.when(F.col("_v").isNull() & F.col("_first"), F.col("_c"))), F.lit(0)).alias("_before"), F.sum(F.when(F.col("_v").isNotNull(), F.col("_c")).otherwise(0)).alias("_numbers"))
        known = numbers.join(F.broadcast(nulls), "_what").select("_what", "_v", (F.col("_below") + F.col("_before") + 1).alias("_rank"))
        first = F.when(F.col("_first"), F.lit(1)).otherwise(F.col("_numbers") + 1)
        known = cut(known.unionByName(counts.filter("_v IS NULL").join(F.broadcast(nulls), "_what").select("_what", "_v", first.alias("_rank"))), "ranks")
        near = lambda df: df
    known = known.withColumn("_none", F.col("_v").isNull()).withColumn("_v", F.coalesce("_v", F.lit(0.0)))
    out = rows
    for name, (c, down) in wanted.items():
        own = known.filter(F.col("_what") == name).select(F.col("_v").alias("_key"), F.col("_none").alias("_isnull"), F.col("_rank").cast("long").alias(name))
        v = F.coalesce(-F.col(c).cast("double") if down else F.col(c).cast("double"), F.lit(0.0))
        out = out.join(near(own), (v == F.col("_key")) & (F.col(c).isNull() == F.col("_isnull"))).drop("_key", "_isnull")
    return out


def rank(rows: DataFrame, value: str, name: str, descending: bool = False) -> DataFrame:
    """rows plus the rank of one column, as in ranks()."""
    return ranks(rows, {name: (value, descending)})


def quantiles(rows: DataFrame, by: str, value: str, wanted: dict[str, tuple[float, str]]) -> DataFrame:
    """(by, n, a column for each name): exact quantiles of a numeric column within groups, all in one pass over its distinct values.

    wanted: name -> (p, rule): `linear` interpolates between the two values around (n - 1) * p, `nearest` takes the value of rank
    ceil(p * n). Null values do not count, groups of none have nulls. Values are added up over range partitions: a group of
    any size is sorted by no one task."""
    counts = rows.groupBy(by, value).agg(F.count("*").alias("_c")).filter(F.col(value).isNotNull())
    c = below(counts.withColumn("_v", F.col(value).cast("double")), "_v", "_c", by)
    total = cut(c.groupBy(by).agg(F.sum("_c").alias("n")), "quantiles")
    near = F.broadcast(total) if total.limit(BOUNDED + 1).count() <= BOUNDED else total
    j = c.join(near, by)
    at = lambda i: F.max(F.when((F.col("_below") <= i) & (i < F.col("_below") + F.col("_c")), F.col("_v")))
    aggs = []
    for name, (p, rule) in wanted.items():
        if rule == "nearest":
            i = F.greatest(F.ceil(F.lit(p) * F.col("n")) - 1, F.lit(0))
            aggs += [at(i).alias(f"{name}_lo"), at(i).alias(f"{name}_hi")]
        else:
            where = (F.col("n") - 1) * F.lit(p)
            aggs += [at(F.floor(where)).alias(f"{name}_lo"), at(F.ceil(where)).alias(f"{name}_hi")]
    found = j.groupBy(by).agg(F.max("n").alias("n"), *aggs)
    part = lambda p, rule: (F.col("n") - 1) * F.lit(p) - F.floor((F.col("n") - 1) * F.lit(p)) if rule == "linear" else F.lit(0.0)
    return found.select(by, "n", *[(F.col(f"{k}_lo") + (F.col(f"{k}_hi") - F.col(f"{k}_lo")) * part(p, rule)).alias(k) for k, (p, rule) in wanted.items()])
