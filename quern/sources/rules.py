"""What the sources' synchronisation decides, on tables: what to fetch, what to remove, when to refuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SKEW = "5 minutes"
INCREMENTAL_LIMIT = 100


class Refused(ValueError):
    """A synchronisation or import that would do harm."""


def fetch_since(cursor: Column, skew: str = SKEW) -> Column:
    """The time to ask a feed from: the last run's start less the skew of the two clocks. What comes twice is dropped by
    to_fetch, since its version is known."""
    return cursor - F.expr(f"INTERVAL {skew}")


def run_mode(changed: DataFrame, limit: int = INCREMENTAL_LIMIT) -> str:
    """`incremental`, or `full` if more than `limit` items moved; no more than that many are counted."""
    return "full" if changed.limit(limit + 1).count() > limit else "incremental"


def to_fetch(listing: DataFrame, stored: DataFrame, key: str = "key", version: str = "version") -> DataFrame:
    """Listed items that are not stored with an equal version (null versions are never equal)."""
    return listing.join(stored.select(key, version), [key, version], "left_anti")


def removals(listing: DataFrame, stored: DataFrame, key: str = "key", space: str | None = None, spaces: list[str] | None = None) -> DataFrame:
    """Stored keys that are no longer listed. Refused if the whole listing is empty while something is stored, or if one
    of the configured spaces lists nothing while documents of it are stored: that looks like a lost permission."""
    if listing.isEmpty() and not stored.isEmpty():
        raise Refused("the source lists nothing, but documents of it are stored")
    if space is not None and spaces:
        named = stored.select(space).filter(F.col(space).isin(spaces)).distinct().join(listing.select(space).distinct(), space, "left_anti")
        gone = sorted(r[0] for r in named.collect())
        if gone:
            raise Refused(f"nothing is listed in {', '.join(gone)}, but documents of it are stored")
    return stored.select(key).distinct().join(listing.select(key), key, "left_anti")


CHUNK = T.ArrayType(T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("heading_path", T.StringType()), T.StructField("content", T.StringType()), T.StructField("token_count", T.IntegerType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def replay_import(documents: DataFrame, sources: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """The document and chunk rows of an export (documents: relative_path, source or null, content_hash, content, chunks).

    Refused when read, with the first line at fault: a vector of another width than `dim`, or a source that the export
    does not list. Documents start at generation 0 and take the release label of their source; without a source
    they have none. A document that comes twice is an error of the export and is written once, with the larger hash.
    """
    s = sources.select(F.col("source").alias("_s"), F.coalesce("version", F.lit("")).alias("version")).dropDuplicates(["_s"])
    j = documents.join(s, F.col("source") == F.col("_s"), "left")
    wrong = F.exists("chunks", lambda c: F.coalesce(F.size(c["embedding"]) != dim, F.lit(True)))
    fault = F.when(F.col("source").isNotNull() & F.col("_s").isNull(), F.concat(F.lit("unknown_source: "), "relative_path")).when(wrong, F.concat(F.lit("dimension_mismatch: "), "relative_path"))
    sound = j.withColumn("_f", fault).filter(F.assert_true(F.col("_f").isNull(), F.coalesce("_f", F.lit(""))).isNull())
    one = sound.groupBy("relative_path").agg(F.max_by(F.struct("source", "content_hash", "content", "version", "chunks"), "content_hash").alias("d"))
    docs = one.select("relative_path", "d.source", "d.content_hash", "d.content", F.coalesce("d.version", F.lit("")).alias("version"), F.lit(0).alias("generation"))
    return docs, one.select("relative_path", F.inline("d.chunks"))
