"""Findings, reports, retention, gates and upkeep on fixtures with nulls, ties and repeats, against plain versions."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation, findings, logbook, upkeep

DAY = datetime(2024, 1, 1)


def plain_cap(rows, cap):
    """rows: (id, reporter, seconds). One report after the other."""
    taken, out = {}, set()
    for i, who, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        mine = taken.setdefault(who, [])
        if sum(1 for x in mine if x > t - 3600) < cap:
            mine.append(t)
            out.add(i)
    return out


@pytest.mark.parametrize("cap", [1, 2, 5])
def test_hourly_cap_counts_accepted_reports_only(spark, cap):
    rng = random.Random(cap)
    rows = [(i, rng.choice(["a", "a", "b", None]), rng.choice([rng.randrange(0, 40_000), 3600 * rng.randrange(12), None if i % 50 == 0 else 7200])) for i in range(600)]
    df = spark.createDataFrame([(i, w, None if t is None else DAY + timedelta(seconds=t)) for i, w, t in rows], "report_id long, reporter string, created_at timestamp_ntz")
    got = [r.report_id for r in logbook.within_hourly_cap(df.repartition(5), cap).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_cap(rows, cap)
    assert logbook.within_hourly_cap(df, 0).count() == 600
    assert logbook.within_hourly_cap(df.filter("false"), cap).count() == 0


def test_hourly_cap_of_one_long_stretch(spark):
    """A reporter without any quiet hour: verdicts depend on each other all the way."""
    rows = [(i, "a", i * 700) for i in range(400)]
    df = spark.createDataFrame([(i, w, DAY + timedelta(seconds=t)) for i, w, t in rows], "report_id long, reporter string, created_at timestamp_ntz")
    assert {r.report_id for r in logbook.within_hourly_cap(df, 3).collect()} == plain_cap(rows, 3)


def test_retention_keeps_ties_and_small_groups(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["a", "b", None]), DAY + timedelta(minutes=rng.randrange(0, 300))) for i in range(200)] + [(999, "few", DAY)]
    df = spark.createDataFrame(rows, "id long, project string, at timestamp_ntz")
    for cap in (1, 7, 40):
        want = set()
        for p in {r[1] for r in rows}:
            mine = sorted((r for r in rows if r[1] == p), key=lambda r: r[2], reverse=True)
            edge = mine[cap - 1][2] if len(mine) >= cap else datetime.min
            want |= {r[0] for r in mine if r[2] >= edge}
        assert {r.id for r in logbook.retained(df, ["project"], "at", cap).collect()} == want


def test_question_ids_grow_where_they_collide(spark):
    import hashlib

    texts = [f"q{i}" for i in range(120)]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "query_norm string, place long")
    got = {r.query_norm: r.id for r in logbook.question_ids(df, [F.col("place")], first=1).collect()}
    taken, want = set(), {}
    for t in texts:
        d = hashlib.sha256(t.encode()).hexdigest()
        want[t] = next(c for c in (f"q-{d[:n]}" for n in range(1, 65, 4)) if c not in taken)
        taken.add(want[t])
    assert got == want and len({len(v) for v in want.values()}) > 1


def test_lines_of_questions(spark):
    import json

    q = spark.createDataFrame([("a", "A?", 2, 1, 1, 1, DAY, DAY, 0.1235), ("b", 'say "b"', 1, 0, 1, 1, DAY, DAY, None)], "query_norm string, spelling string, asked long, tokens long, unknown long, days long, first_at timestamp_ntz, last_at timestamp_ntz, best_score double")
    back = spark.createDataFrame([("a", 2, "y", 0.05, 1), ("a", 1, "x", 0.9996, 3)], "query_norm string, place int, path string, best double, times long")
    got = [json.loads(r.line) for r in logbook.question_lines(q, back, [-F.col("asked")]).orderBy("place").collect()]
    assert [g["query"] for g in got] == ["A?", 'say "b"'] and got[0]["id"].startswith("q-") and len(got[0]["id"]) == 14
    assert "by 1 token and 1 unattributed on 1 day, 2024-01-01 to" in got[0]["note"] and "Best score: 0.124. Returned: x (1.000, 3x); y (0.050, 1x)." in got[0]["note"]
    assert "by nobody known" in got[1]["note"] and "Best score: none. Returned: nothing." in got[1]["note"]


def test_groups_of_reports(spark):
    rows = [(1, "q", "Q", "a", None, DAY), (2, "q", "q?", "a", "old", DAY), (3, "q", "q!", None, None, DAY + timedelta(days=1)), (4, None, "x", None, None, None)]
    df = spark.createDataFrame(rows, "report_id long, query_norm string, query string, token string, note string, created_at timestamp_ntz")
    got = {r.query_norm: r for r in logbook.gap_groups(df).collect()}
    assert (got["q"]["sample"], got["q"].reports, got["q"].reporters, got["q"].last_note) == ("q!", 3, 1, "old") and got[None].reporters == 0


def test_audit_days_and_projects(spark):
    df = spark.createDataFrame([(1, None, DAY), (2, "p", DAY + timedelta(days=1, seconds=-1)), (3, "p", DAY + timedelta(days=1))], "id long, project string, created_at timestamp_ntz")
    ids = lambda **k: sorted(r.id for r in logbook.audit_scope(df, **k).collect())
    assert ids(project="none") == [1] and ids(first="2024-01-01", last="2024-01-01") == [1, 2] and ids(project="p", first="2024-01-02") == [3]
    for bad in ("2024-1-1", "yesterday", "2024-02-30"):
        with pytest.raises(ValueError):
            logbook.audit_scope(df, first=bad)


def scan_tables(spark):
    docs = spark.createDataFrame(
        [(1, "p", 1, "s", "a", "h1", False), (2, "p", 1, "s", "b", "h2", True), (3, "p", 2, "s", "c", "h3", False), (4, "q", 5, "s", "d", "h4", False), (5, "p", 1, "s", "e", None, False), (6, None, 1, "s", "f", "h6", False), (7, "p", 1, "s", "g", "h7", False)],
        "doc_id long, project string, generation int, source string, relative_path string, content_hash string, truncated boolean",
    )
    projects = spark.createDataFrame([("p", 1), ("q", 5), ("empty", 1)], "project string, live_generation int")
    scans = spark.createDataFrame([(1, "h1", "scanned", 2, "k", True), (2, "h2", "scanned", 2, "k", None), (4, "h4", "scanned", 1, "k", False), (5, "h", "no_content", 1, None, False), (7, "h7", "no_content", 1, None, False)], "doc_id long, content_hash string, status string, ruleset int, key_id string, capped boolean")
    return docs, projects, scans


def test_due_documents_and_counts(spark):
    t = scan_tables(spark)
    assert [(r.project, r.doc_id) for r in findings.due_documents(*t, 2, "k").collect()] == [("q", 4)]
    # another key: all scanned ones, but not what had no text
    assert sorted(r.doc_id for r in findings.due_documents(*t, 2, "k2").collect()) == [1, 2, 4]
    assert [r.project for r in findings.projects_with_due(*t, 2, "k").collect()] == ["q"]
    got = {r.project: tuple(r)[1:] for r in findings.scan_state(*t, 2, "k").collect()}
    assert got == {"p": (0, 2, 2, 1, 1), "q": (1, 0, 0, 0, 0)}


def test_findings_pages_and_rules(spark):
    t = scan_tables(spark)
    f = spark.createDataFrame([(i, 1 + i % 4, "mail" if i % 2 else "card", i // 3, f"{i:020d}", "k" if i % 5 else None) for i in range(40)] + [(99, 1, "unknown", 0, "", "k")], "finding_id long, doc_id long, rule string, start int, value_hmac string, key_id string")
    whole = findings.listing(f, *t, key_id="k")
    order = ["relative_path", "start", "finding_id"]
    want = [tuple(r) for r in whole.orderBy(*order).select(*order).collect()]
    seen, after = [], None
    while True:
        rows, after = findings.page(whole, order, 7, after)
        seen += [tuple(r) for r in rows.select(*order).collect()]
        if after is None:
            break
    assert seen == want and len(want) == 31  # documents 1, 2 and 4
    assert {(r.finding_id, r.group) for r in whole.filter("finding_id IN (1, 5, 99)").collect()} == {(1, "0" * 12), (5, None), (99, None)}
    n = {(r.project, r.rule): r.findings for r in findings.by_rule(f, *t, ["mail", "card", "none"]).collect()}
    assert n[("p", "mail")] == 10 and n[("p", "card")] == 10 and n[("q", "mail")] == 10 and n[("p", "none")] == 0 and n[("empty", "mail")] == 0 and len(n) == 9


def test_slice_gate(spark):
    schema = "key long, rank int, below_floor boolean, tags array<string>"
    off = spark.createDataFrame([(1, 0, False, ["x"]), (2, None, None, ["x"]), (3, 9, False, None), (4, 2, True, [])], schema)
    on = spark.createDataFrame([(1, 4, True, []), (2, 5, False, []), (3, 0, False, []), (4, 2, False, [])], schema)
    r = evaluation.slice_gate(off, on, "x", 400).collect()[0]
    assert (r.slice_questions, r.slice_off_hits, r.slice_on_hits, r.slice_on_past_floor, r.rest_gained, r.rest_lost) == (2, 1, 1, 0, 1, 0) and r.passed and r.fault is None
    assert not evaluation.slice_gate(off, on, "x", 500).collect()[0].passed  # more than, not as many as
    lost = on.withColumn("rank", F.when(F.col("key") == 4, 7).otherwise(F.col("rank")))
    r = evaluation.slice_gate(off, lost, "x", 400).collect()[0]
    assert r.slice_passed and r.rest_lost == 1 and r.rest_gained == 1 and not r.passed
    assert evaluation.slice_gate(off, on.filter("key < 4"), "x", 400).collect()[0].fault == "other questions"
    r = evaluation.slice_gate(off, on.union(on), "x", 400).collect()[0]
    assert r.fault == "repeated questions" and not r.passed
    assert not evaluation.slice_gate(off.filter("false"), on.filter("false"), "x", 400).collect()[0].passed


def test_floors_and_thresholds(spark):
    rows = [("g", "probe", 0, 0.4), ("g", "good", 1, 0.4), ("g", "good", 1, 0.3), ("g", "bad", 0, None), ("h", "good", 1, 0.1), ("h", "bad", 0, float("nan")), ("h", "bad", 0, 0.05)]
    s = spark.createDataFrame(rows, "corpus string, kind string, truth int, score double")
    got = {(r.corpus, r.kind): (r.floor, r.n, r.refused) for r in evaluation.probe_floor(s, F.col("kind") == "probe", ["corpus"]).collect()}
    assert got[("g", "good")] == (0.4, 2, 0.5) and got[("g", "bad")] == (0.4, 1, 0.0) and got[("h", "good")] == (None, 1, 0.0)
    got = {r.corpus: (r.threshold, r.n, r.caught) for r in evaluation.feature_thresholds(s, ["score"], ["corpus"]).collect()}
    assert got == {"g": (0.1, 2, 0.0), "h": (0.1, 2, 0.5)}
    m = spark.createDataFrame([(0.675, None)], "recall_5 double, heading_5 double")
    assert tuple(evaluation.gate_verdict(m, {"recall_5": 0.675, "heading_5": 0.65}).select("recall_5_ok", "heading_5_ok").collect()[0]) == (True, False)


def test_message_cost_and_checks(spark):
    bodies = [
        (1, '[{"method":"tools/call","id":1,"params":{"name":"s"}},{"method":"tools/call","id":null,"params":{"name":"s"}},{"method":"tools/call","params":{"name":"s"}},5,null]', "t", True),
        (2, ' {"method":"initialize","id":1}', "t", True),
        (3, '{"method":5,"id":1,"params":{"method":"x"}}', "t", True),
        (4, '{"method":"tools/call","id":"a","params":{"name":"other"}}', None, True),
        (5, "nothing", None, True),
        (6, None, None, True),
        (7, '{"method":"tools/list","id":0}', None, False),
        (8, "[]", "t", True),
    ]
    r = spark.createDataFrame(bodies, "request_id long, body string, token string, open boolean").withColumns({"project": F.lit("p"), "address_key": F.lit(None).cast("string")})
    cost = upkeep.message_cost(r, ["s"])
    assert {tuple(x) for x in cost.collect()} == {(1, "requests", 2), (1, "s", 2), (4, "requests", 1), (7, "requests", 1)}
    assert {tuple(x) for x in upkeep.limit_checks(r, cost, 60, 20, {"s": 5}).collect()} == {(1, "tok:t", 60, 2), (1, "tok:t:tool:s", 5, 2), (4, "ip:p:unknown", 20, 1)}
    assert upkeep.limit_checks(r, cost, 0, 0, {}).count() == 0


def test_due_sources_and_meta(spark):
    now = F.lit(DAY).cast("timestamp_ntz")
    h = lambda n: DAY + timedelta(hours=n)
    s = spark.createDataFrame([("new", 5, None, None), ("late", 5, h(-3), h(-1)), ("hook", None, None, h(-2)), ("idle", None, h(-9), None), ("soon", 5, h(1), None), ("now", 5, h(0), h(4))], "source string, interval int, next_at timestamp_ntz, webhook_at timestamp_ntz")
    assert [r.source for r in upkeep.due_sources(s, now, 10).collect()] == ["new", "late", "hook", "now"]
    ages = s.select("source", upkeep.past_skip_age(F.col("next_at"), 3, now).alias("a"), upkeep.past_skip_age(F.col("next_at"), 0, now).alias("z")).collect()
    assert {r.source for r in ages if r.a} == {"new", "hook", "idle"} and not any(r.z for r in ages)
    m = spark.createDataFrame(
        [(1, None, "http://n", 5, False, "http://o", 1, True, True), (2, True, "ftp://n", None, False, "http://o", 1, True, False), (3, True, "HTTPS://n", 5, True, "http://o", 1, True, False), (4, True, "http://n", 5, True, None, None, True, False), (5, True, "http://n", 5, True, None, 1, False, False)],
        "doc_id long, answered boolean, url string, modified_at int, stamp boolean, old_url string, old_modified_at int, known boolean, changed boolean",
    )
    assert {tuple(r) for r in upkeep.stored_meta(m).collect()} == {(1, "http://o", 1), (2, None, None), (3, "HTTPS://n", 1), (4, "http://n", 5), (5, "http://n", 5)}
