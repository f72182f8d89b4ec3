"""Sensitive-data findings over the live documents of projects: what is due for a scan, what was found, how much is left.

documents: doc_id, project, generation, source, relative_path, content_hash, truncated. projects: project, live_generation.
scans: doc_id, content_hash, status (`scanned` or `no_content`), ruleset, key_id, capped. findings: finding_id, doc_id, rule,
start, value_hmac, key_id. Documents and findings are joined by doc_id; only the live pointers, one row a project, may be broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import small

GROUP_CHARS = 12


def live(documents: DataFrame, projects: DataFrame) -> DataFrame:
    """Documents of their project's live generation."""
    p = projects.select(F.col("project").alias("_p"), F.col("live_generation").alias("_g"))
    return documents.join(small(p), (F.col("project") == F.col("_p")) & (F.col("generation") == F.col("_g"))).drop("_p", "_g")


def _scanned(documents: DataFrame, projects: DataFrame, scans: DataFrame, ruleset: int, key_id: str | None) -> DataFrame:
    """Live documents with their scan and `_due`: never scanned, read with another hash, or scanned by another rule set or under
    another key. Where there was no text to scan, neither rules nor key make a document due again."""
    s = scans.select(F.col("doc_id").alias("_id"), F.col("content_hash").alias("_hash"), "status", F.col("ruleset").alias("_rules"), F.col("key_id").alias("_key"), "capped")
    moved = (F.col("_rules") != ruleset) | ~F.col("_key").eqNullSafe(F.lit(key_id))
    due = F.col("_id").isNull() | (F.col("_hash") != F.col("content_hash")) | ((F.col("status") == "scanned") & moved)
    return live(documents, projects).join(s, F.col("doc_id") == F.col("_id"), "left").withColumn("_due", F.coalesce(due, F.lit(False)))


def due_documents(documents: DataFrame, projects: DataFrame, scans: DataFrame, ruleset: int, key_id: str | None = None) -> DataFrame:
    """project, doc_id, content_hash of every live document that is due for a scan."""
    return _scanned(documents, projects, scans, ruleset, key_id).filter("_due").select("project", "doc_id", "content_hash")


def projects_with_due(documents: DataFrame, projects: DataFrame, scans: DataFrame, ruleset: int, key_id: str | None = None) -> DataFrame:
    """The projects with a document due."""
    return due_documents(documents, projects, scans, ruleset, key_id).select("project").distinct()


def current(findings: DataFrame, documents: DataFrame, projects: DataFrame, scans: DataFrame) -> DataFrame:
    """Findings of live documents that the scan read as they are now, with project and path of the document."""
    d = live(documents, projects).select("doc_id", "project", "relative_path", "content_hash")
    return findings.join(d.join(scans.select("doc_id", "content_hash"), ["doc_id", "content_hash"]), "doc_id")


def beyond(columns: list[str], after: tuple) -> Column:
    """The row of these columns comes after a given one: compared column by column, the first also alone, so that a scan in that
    order can skip what lies before it. A null column is beyond nothing."""
    test = F.lit(False)
    for name, value in reversed(list(zip(columns, after))):
        test = (F.col(name) > F.lit(value)) | ((F.col(name) == F.lit(value)) & test)
    return (F.col(columns[0]) >= F.lit(after[0])) & test


def page(rows: DataFrame, order: list[str], limit: int, after: tuple | None = None) -> tuple[DataFrame, tuple | None]:
    """(the next `limit` rows in an order beyond a cursor, the cursor of the page after it or None). One row more than asked tells
    whether there is another page; only that page reaches the driver."""
    rows = rows if after is None else rows.filter(beyond(order, after))
    got = rows.orderBy(*order).limit(limit + 1)
    ends = got.select(*order).collect()
    more = len(ends) > limit
    return got.orderBy(*order).limit(limit), tuple(ends[limit - 1]) if more and limit else None


def listing(findings: DataFrame, documents: DataFrame, projects: DataFrame, scans: DataFrame, key_id: str | None = None, rule: str | None = None) -> DataFrame:
    """project, relative_path, start, finding_id, rule, group: the first characters of the value's keyed digest, shown only where it
    was made under the current key. Page it by project, relative_path, start, finding_id."""
    f = current(findings if rule is None else findings.filter(F.col("rule") == rule), documents, projects, scans)
    own = F.lit(key_id).isNotNull() & (F.col("key_id") == F.lit(key_id)) & (F.col("value_hmac") != "")
    return f.select("project", "relative_path", "start", "finding_id", "rule", F.when(own, F.substring("value_hmac", 1, GROUP_CHARS)).alias("group"))


def by_rule(findings: DataFrame, documents: DataFrame, projects: DataFrame, scans: DataFrame, rules: list[str]) -> DataFrame:
    """project, rule, findings: every known rule of every project has a row, also those with none; unknown rules count nowhere.
    Findings are counted by document before they meet it, so a document of very many moves one row a rule."""
    per = findings.filter(F.col("rule").isin(rules)).groupBy("doc_id", "rule").agg(F.count("*").alias("_n"))
    n = current(per, documents, projects, scans).groupBy("project", "rule").agg(F.sum("_n").alias("findings"))
    every = projects.select("project").distinct().select("project", F.explode(F.array(*[F.lit(r) for r in rules])).alias("rule"))
    return every.join(n, ["project", "rule"], "left").select("project", "rule", F.coalesce("findings", F.lit(0)).cast("long").alias("findings"))


def scan_state(documents: DataFrame, projects: DataFrame, scans: DataFrame, ruleset: int, key_id: str | None = None) -> DataFrame:
    """project, pending, scanned, without_text, capped, truncated: five counts of documents in one pass."""
    d = _scanned(documents, projects, scans, ruleset, key_id)
    done = ~F.col("_due") & (F.col("status") == "scanned")
    return d.groupBy("project").agg(
        F.count_if("_due").alias("pending"),
        F.count_if(done).alias("scanned"),
        F.count_if(~F.col("_due") & (F.col("status") == "no_content")).alias("without_text"),
        F.count_if(done & F.col("capped")).alias("capped"),
        F.count_if(done & F.col("truncated")).alias("truncated"),
    )
