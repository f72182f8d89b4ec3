"""Connected components of a link table by repeated contraction, all in shared storage.

In each round every node points to its smallest neighbour (partial aggregation: a hub costs one row per task),
pointers are doubled, and the links are carried over to the nodes pointed at, where most of them vanish. Nothing
but the question "are links left?" comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the same for all nodes of a component.

    Links may be repeated, in either direction, or join a node to itself; null ends are ignored. No links: no rows.
    """
    e = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    e = cut(e.filter("a <> b").distinct(), "cc-links")
    labels = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("to")).union(e.select("b", "a"))
        up = cut(both.groupBy("node").agg(F.least(F.min("to"), F.col("node")).alias("up")), "cc-up")
        for _ in range(2):  # pointer doubling; every pointer stays within its component
            above = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
            up = up.join(above, "up").select("node", F.col("top").alias("up"))
        up = cut(up, "cc-up")
        ends = up.select(F.col("node").alias("a"), F.col("up").alias("ua"))
        other = up.select(F.col("node").alias("b"), F.col("up").alias("ub"))
        nxt = e.join(ends, "a").join(other, "b").filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"))
        e = cut(nxt.distinct(), "cc-links")
        if labels is None:
            labels = up.select("node", F.col("up").alias("root"))
        else:
            moved = up.select(F.col("node").alias("root"), F.col("up").alias("_to"))
            labels = cut(labels.join(moved, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "cc-labels")
    if labels is None:
        labels = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
