"""Numbers for rows that a hash cannot tell apart, so that a key with a third of all rows can still be split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.session import cut, small

LIMIT = 64


def crowded(rows: DataFrame, by: list[str], limit: int = LIMIT) -> DataFrame | None:
    """The groups of `by` with more than `limit` rows, written to shared storage; None if there are none."""
    hot = cut(rows.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).select(*by), "equal-hot")
    return None if hot.isEmpty() else hot


def numbered(rows: DataFrame, by: list[str], hot: DataFrame | None) -> DataFrame:
    """rows plus _no: from 0 without gaps within each group that crowded() found, null in all others.

    Which row of a group gets which number is open; that they are equal in all that matters is the caller's business.
    No task holds a whole group: rows are counted by the partition they were written from, and numbered within it.
    """
    if hot is None:
        return rows.withColumn("_no", F.lit(None).cast("long"))
    some = cut(rows.withColumn("_pid", F.spark_partition_id()).join(small(hot), by, "left_semi"), "equal-rows")
    upto = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    start = some.groupBy(*by, "_pid").agg(F.count("*").alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(upto), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, "_pid").orderBy("_pid")) - 1
    some = some.withColumn("_at", place).join(small(cut(start, "equal-start")), [*by, "_pid"])
    some = some.select(*rows.columns, (F.col("_from") + F.col("_at")).cast("long").alias("_no"))
    return rows.join(small(hot), by, "left_anti").withColumn("_no", F.lit(None).cast("long")).unionByName(some)
