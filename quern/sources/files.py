"""File sources: directory walks, archives, front matter of file heads, NDJSON with validation."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.ingest import clean_path
from quern.session import cut, small

# Directories that hold build products, and the extensions read by default.
SKIPPED = ("node_modules", "dist", "build", "target", "vendor")
DEFAULT_EXTENSIONS = ("md", "mdx")
MAX_ENTRIES, MAX_BYTES = 10_000, 256 << 20


def walk(spark: SparkSession, root: str, extensions: tuple[str, ...] = DEFAULT_EXTENSIONS, ignore: tuple[str, ...] = ()) -> DataFrame:
    """relative_path, size, modified, content, content_hash of the files under root: hidden and build directories are
    skipped, ignore holds regular expressions on the relative path. Listing and reading are Spark's, on any store."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.col("path"), r"^.*?" + _quote(root.rstrip("/").split("://")[-1]) + "/", "")
    f = files.withColumn("relative_path", rel).filter(F.lower(F.regexp_extract("relative_path", r"\.([^./]+)$", 1)).isin(*extensions))
    f = f.filter(~F.col("relative_path").rlike(r"(^|/)(\.[^/]*|" + "|".join(SKIPPED) + r")/")).filter(~F.col("relative_path").rlike(r"(^|/)\.[^/]*$"))
    for x in ignore:
        f = f.filter(~F.col("relative_path").rlike(x))
    return f.select("relative_path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), "content", F.sha2("content", 256).alias("content_hash"))


def _quote(text: str) -> str:
    return "".join("\\" + c if not c.isalnum() and c not in "/_-" else c for c in text)


class ArchiveError(ValueError):
    """The archive is not acceptable."""


def unpack(data: bytes, name: str, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES) -> list[tuple[str, bytes]]:
    """(cleaned path, content) of the regular files of a zip or tar; unsafe paths are left out, ceilings are enforced on
    what is really read."""
    out, left = [], max_bytes

    def take(path: str, read) -> None:
        nonlocal left
        if len(out) >= max_entries:
            raise ArchiveError("too many entries")
        body = read(left + 1)
        left -= len(body)
        if left < 0:
            raise ArchiveError("too many bytes")
        out.append((path, body))

    def clean(path: str) -> str | None:
        path = path.replace("\\", "/")
        while path.startswith(("./", "/")):
            path = path[2:] if path.startswith("./") else path[1:]
        return path if path and not set(path.split("/")) & {"", ".", ".."} else None

    try:
        if zipfile.is_zipfile(io.BytesIO(data)):
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for i in z.infolist():
                    if not i.is_dir() and (p := clean(i.filename)):
                        with z.open(i) as f:
                            take(p, f.read)
        else:
            with tarfile.open(fileobj=io.BytesIO(data)) as t:
                for i in t:
                    if i.isreg() and (p := clean(i.name)):
                        take(p, t.extractfile(i).read)
    except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError) as e:
        raise ArchiveError(f"{name} cannot be read") from e
    return sorted(out)


def unpack_table(archives: DataFrame) -> DataFrame:
    """archive, path, content, error: one row per file of each archive, or one with the reason."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    rows += [(name, p, c, None) for p, c in unpack(data or b"", name or "")]
                except ArchiveError as e:
                    rows.append((name, None, None, str(e)))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.binary(), pa.string()))], names=["archive", "path", "content", "error"])

    return archives.select("path", "content").mapInArrow(run, "archive string, path string, content binary, error string")


def front_matter_field(head: Column, field: str) -> Column:
    """The value of a field of the leading --- block, quotes stripped; null without it."""
    block = F.regexp_extract(head, r"(?s)^---[ \t]*\n(.*?)\n---", 1)
    v = F.regexp_extract(block, rf"(?m)^{field}:[ \t]*(.*?)[ \t]*$", 1)
    return F.nullif(F.regexp_replace(v, r"^([\"'])(.*)\1$", "$2"), F.lit(""))


MAX_LINE_BYTES = 64 << 20


def numbered_lines(spark: SparkSession, path: str, max_bytes: int = MAX_LINE_BYTES) -> DataFrame:
    """file, line_no (from 1, blank lines counted), value: the lines of text files that are not blank.

    Files are read in splits of any number: a line belongs to the split it begins in, and its number is the lines of the splits
    before it (one row each to add up) and those before it in its own. A line of more than max_bytes fails the job with its
    place. Lines end at a newline alone; an empty file has none."""
    block = ("_file", "_at")
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_i"))
    splits = lines.select(*block, "_i").groupBy(*block).agg(F.min("_i").alias("_lo"), F.count("*").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = cut(splits.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).select(*block, (F.col("_from") - F.col("_lo") + 1).alias("_shift")), "line-splits")
    placed = lines.join(small(splits), [*block]).select(F.regexp_extract("_file", "([^/]+)$", 1).alias("file"), (F.col("_i") + F.col("_shift")).alias("line_no"), "value")
    where = F.concat("file", F.lit(":"), F.col("line_no").cast("string"), F.lit(f": has a line longer than {max_bytes} bytes"))
    return placed.filter(F.assert_true(F.octet_length("value") <= max_bytes, where).isNull()).filter(F.trim("value") != "")


QUESTION = T.StructType([T.StructField("id", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("query", T.StringType()), T.StructField("expectFile", T.StringType()), T.StructField("expectHeading", T.StringType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("note", T.StringType())])


def questions(lines: DataFrame) -> DataFrame:
    """Question rows of JSON lines (column value) with fault: null, or what is wrong with the line. Blank lines are left out;
    ids must be slugs and unique, unknown keys are faults."""
    known = F.array(*[F.lit(f.name) for f in QUESTION.fields])
    r = lines.filter(F.trim("value") != "").withColumn("q", F.from_json("value", QUESTION))
    keys = F.json_object_keys("value")
    dup = r.groupBy(F.col("q.id").alias("_id")).agg(F.count("*").alias("_n"))
    r = r.join(dup, F.col("q.id") == F.col("_id"), "left")
    fault = (
        F.when(keys.isNull(), "not an object")
        .when(F.size(F.array_except(keys, known)) > 0, "unknown key")
        .when(F.coalesce(~F.col("q.id").rlike("^[a-z0-9][a-z0-9-]*$"), F.lit(True)), "bad id")
        .when(F.col("q.query").isNull() | (F.trim("q.query") == ""), "no query")
        .when(F.col("_n") > 1, "repeated id")
    )
    return r.select("q.*", fault.alias("fault"))


def require_sound(rows: DataFrame) -> DataFrame:
    """rows if none has a fault; otherwise the job fails with the first one it meets."""
    return rows.filter(F.assert_true(F.col("fault").isNull(), F.concat(F.lit("line refused: "), F.coalesce("fault", F.lit("")))).isNull()).drop("fault")


def import_plan(manifest_dim: int, dim: int, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents of an export ready to be replayed: refused as a whole on another vector width, or on a source that is not known."""
    if manifest_dim != dim:
        raise ValueError(f"the export holds vectors of {manifest_dim}, this index {dim}")
    known = documents.join(sources.select("source").withColumn("_known", F.lit(True)).distinct(), "source", "left")
    ok = known.filter(F.assert_true(F.col("_known").isNotNull(), F.lit("unknown source")).isNull())
    return ok.drop("_known").withColumn("relative_path", clean_path(F.col("relative_path")))
