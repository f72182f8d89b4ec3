"""Reports and questions of the search log: configurations, gap groups, the hourly cap, retention, export of questions."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3_600_000_000


def configurations(log: DataFrame) -> DataFrame:
    """model, generation, floor (null is a value of its own), searches, first_at, last_at: what the log was made under."""
    return log.groupBy("model", "generation", "floor").agg(F.count("*").alias("searches"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def latest(value: str, at: list[str], where: Column | None = None) -> Column:
    """The value of the newest row, of those that meet a condition; ties go to the larger of the later columns of `at`."""
    order = F.struct(*at)
    return F.max_by(value, order if where is None else F.when(where, order))


def gap_groups(reports: DataFrame) -> DataFrame:
    """query_norm, sample (newest spelling), reports, reporters, first_at, last_at, last_note (newest that is not null). reports:
    report_id, query_norm, query, token, note, created_at; reporters are distinct tokens, unknown ones do not count."""
    return reports.groupBy("query_norm").agg(
        latest("query", ["created_at", "report_id"]).alias("sample"),
        F.count("*").alias("reports"),
        F.count_distinct("token").alias("reporters"),
        F.min("created_at").alias("first_at"),
        F.max("created_at").alias("last_at"),
        latest("note", ["created_at", "report_id"], F.col("note").isNotNull()).alias("last_note"),
    )


def within_hourly_cap(reports: DataFrame, per_hour: int, key: str = "report_id") -> DataFrame:
    """The reports that a cap accepts: fewer than `per_hour` accepted ones of the same reporter stand in the hour before (its far end
    not included). Refused ones count for nothing, so each verdict follows from the verdicts before it. 0: no cap.

    Reporters' hours are counted first. An hour without a report leaves nothing for the next to count, so a stretch of hours
    between such gaps is decided alone; stretches in which no two neighbouring hours hold more than the cap pass untouched,
    and only the others go, sorted, through a pass that remembers `per_hour` times. Null reporters are one reporter; a
    report without a time is refused. The key tells reports apart; of one time, the smaller key comes first."""
    if per_hour <= 0:
        return reports
    r = reports.withColumn("_t", F.unix_micros(F.col("created_at").cast("timestamp"))).filter("_t IS NOT NULL")
    r = r.withColumn("_who", F.coalesce(F.concat(F.lit("r"), F.col("reporter").cast("string")), F.lit("n"))).withColumn("_hr", F.floor(F.col("_t") / HOUR))
    w = Window.partitionBy("_who").orderBy("_hr")
    before = F.lag("_hr").over(w) == F.col("_hr") - 1
    hours = r.groupBy("_who", "_hr").agg(F.count("*").alias("_n"))
    hours = hours.withColumn("_new", F.when(before, 0).otherwise(1)).withColumn("_two", F.col("_n") + F.when(before, F.lag("_n").over(w)).otherwise(0))
    hours = hours.withColumn("_part", F.sum("_new").over(w))
    crowd = hours.groupBy("_who", "_part").agg((F.max("_two") > per_hour).alias("_full"))
    tight = hours.join(crowd.filter("_full"), ["_who", "_part"]).select("_who", "_hr", "_part")
    parts = r.join(tight, ["_who", "_hr"], "left")
    names = [f.name for f in reports.schema]

    def run(frames):
        own, times = None, deque()
        for f in frames:
            take = []
            for who, part, t in zip(f["_who"], f["_part"], f["_t"]):
                if (who, part) != own:
                    own, times = (who, part), deque()
                while times and times[0] <= t - HOUR:
                    times.popleft()
                take.append(len(times) < per_hour)
                if take[-1]:
                    times.append(t)
            yield f.loc[pd.Series(take, index=f.index, dtype=bool), ["_who", "_t", key]]

    schema = f"_who string, _t long, {key} {reports.schema[key].dataType.simpleString()}"
    asked = parts.filter("_part IS NOT NULL").select("_who", "_part", "_t", key)
    kept = asked.repartition("_who", "_part").sortWithinPartitions("_who", "_part", "_t", key).mapInPandas(run, schema)
    full = parts.filter("_part IS NOT NULL").join(kept, ["_who", "_t", key], "left_semi")
    return parts.filter("_part IS NULL").select(*names).unionByName(full.select(*names))


def retained(rows: DataFrame, by: list[str], at: str, cap: int) -> DataFrame:
    """Rows not older than the `cap`-th newest of their group: rows of that very time all stay. Groups of fewer stay whole.

    Hours are counted and added up from the newest; only the hour that holds the `cap`-th row is ranked, by distinct times with
    their counts, so no task sorts a group."""
    t = F.unix_micros(F.col(at).cast("timestamp"))
    r = rows.withColumn("_t", t).withColumn("_hr", F.floor(F.col("_t") / HOUR))
    w = Window.partitionBy(*by).orderBy(F.desc("_hr"))
    hours = r.groupBy(*by, "_hr").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(w))
    edge = hours.filter((F.col("_upto") >= cap) & (F.col("_upto") - F.col("_n") < cap)).select(*[F.col(c).alias(f"_{c}_e") for c in by], F.col("_hr").alias("_hr_e"), (F.lit(cap) - F.col("_upto") + F.col("_n")).alias("_left"))
    same = F.col("_hr") == F.col("_hr_e")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}_e"))
    times = r.groupBy(*by, "_hr", "_t").agg(F.count("*").alias("_n")).join(edge, same)
    v = Window.partitionBy(*by).orderBy(F.desc("_t"))
    cuts = times.withColumn("_upto", F.sum("_n").over(v)).filter((F.col("_upto") >= F.col("_left")) & (F.col("_upto") - F.col("_n") < F.col("_left")))
    cuts = cuts.select(*[F.col(c).alias(f"_{c}_c") for c in by], F.col("_t").alias("_cut"))
    mine = F.lit(True)
    for c in by:
        mine = mine & F.col(c).eqNullSafe(F.col(f"_{c}_c"))
    return r.join(cuts, mine, "left").filter(F.col("_cut").isNull() | (F.col("_t") >= F.col("_cut"))).select(*rows.columns)


def question_ids(questions: DataFrame, order: list[Column], text: str = "query_norm", first: int = 12) -> DataFrame:
    """questions plus id: `q-` and the first hex digits of the SHA-256 of the text, `first` of them or four more at a time where an
    earlier question (in the order) has that id. Questions meet only where their first digits agree: by chance, a handful."""
    q = questions.withColumn("_digest", F.sha2(F.col(text), 256))
    w = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], F.col(text).alias("text"), F.col("_digest").alias("digest"))
    groups = q.groupBy(F.substring("_digest", 1, first).alias("_head")).agg(F.array_sort(F.collect_list(w)).alias("_all"))
    longer = F.sequence(F.lit(first), F.lit(64), F.lit(4))

    def add(taken, x):
        names = F.transform(longer, lambda n: F.concat(F.lit("q-"), x["digest"].substr(F.lit(1), n)))
        return F.array_append(taken, F.element_at(F.filter(names, lambda c: ~F.array_contains(taken, c)), 1))

    named = groups.withColumn("_ids", F.aggregate("_all", F.expr("cast(array() as array<string>)"), add))
    pairs = named.select(F.explode(F.arrays_zip("_all", "_ids")).alias("x")).select(F.col("x._all.text").alias(text), F.col("x._ids").alias("id"))
    return questions.join(pairs, text)


def audit_scope(events: DataFrame, project: str | None = None, first: str | None = None, last: str | None = None, **equal) -> DataFrame:
    """Audit rows of a project (`none`: of no project), from the first day to the end of the last (UTC days, yyyy-mm-dd; anything
    else is an error), and with equal values in further columns."""
    if project is not None:
        events = events.filter(F.col("project").isNull() if project == "none" else F.col("project") == project)
    for d in (first, last):
        if d is not None and pd.Timestamp(d).strftime("%Y-%m-%d") != d:
            raise ValueError(f"not a day: {d}")
    if first is not None:
        events = events.filter(F.col("created_at") >= F.lit(first).cast("timestamp_ntz"))
    if last is not None:
        events = events.filter(F.col("created_at") < F.lit(last).cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    for name, value in equal.items():
        events = events.filter(F.col(name) == value)
    return events


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n of several columns in one pass over the rows; null values are left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.inline(pairs)).filter("value IS NOT NULL").groupBy("facet", "value").agg(F.count("*").alias("n"))


def _three(x: Column) -> Column:
    """A number with three digits behind the point, halves up."""
    n = F.floor(x * 1000 + 0.5)
    return F.concat(F.floor(n / 1000).cast("string"), F.lit("."), F.lpad((n % 1000).cast("string"), 3, "0"))


def _many(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {word}").otherwise(f" {word}s"))


def question_lines(questions: DataFrame, returned: DataFrame, order: list[Column], first: int = 12) -> DataFrame:
    """place, line: the JSON lines (id, query, note) of an export of questions for people to turn into a golden set, in their order.

    questions: query_norm, spelling, asked, tokens, unknown (rows of no token), days, first_at, last_at, best_score; returned: query_norm,
    place, path, best, times, a few a question. The note says how often, by whom and when it was asked, its best score ever and
    what came back, and asks for the document that should have answered."""
    parts = F.concat("path", F.lit(" ("), _three(F.col("best")), F.lit(", "), F.col("times").cast("string"), F.lit("x)"))
    lists = returned.groupBy("query_norm").agg(F.array_sort(F.collect_list(F.struct("place", parts.alias("text")))).alias("_hits"))
    q = question_ids(questions, order, first=first).join(lists, "query_norm", "left")
    who = F.when(F.col("tokens") > 0, F.concat(F.lit("by "), _many(F.col("tokens"), "token"), F.when(F.col("unknown") > 0, F.concat(F.lit(" and "), F.col("unknown").cast("string"), F.lit(" unattributed"))).otherwise("")))
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    note = F.concat(
        F.lit("Asked "), F.col("asked").cast("string"), F.lit("x "), who.otherwise("by nobody known"), F.lit(" on "), _many(F.col("days"), "day"), F.lit(", "), day("first_at"), F.lit(" to "), day("last_at"),
        F.lit(". Best score: "), F.coalesce(_three(F.col("best_score")), F.lit("none")), F.lit(". Returned: "), F.coalesce(F.array_join(F.transform("_hits", lambda x: x["text"]), "; "), F.lit("nothing")),
        F.lit(". To do: name the document that should have answered, or delete this line."),
    )
    line = F.to_json(F.struct("id", F.col("spelling").alias("query"), note.alias("note")))
    return q.select(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], "query_norm").alias("place"), line.alias("line"))
