"""Sources, archives, OpenAPI and the smaller functions."""

import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import misc as M
from quern.functions import openapi as O
from quern.operators import analytics
from quern.sources import drivers, files


def test_walk(spark, tmp_path):
    for p, t in {"a.md": "x", "sub/b.mdx": "y", ".git/c.md": "z", "node_modules/d.md": "z", "e.txt": "z", "sub/.hid.md": "z", "drafts/f.md": "z"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    got = files.walk(spark, str(tmp_path), ignore=("^drafts/",)).collect()
    assert sorted((r.relative_path, r.size) for r in got) == [("a.md", 1), ("sub/b.mdx", 1)]


def test_archives(spark):
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        for n in ("a.md", "../evil.md", "d/./x.md", "d/b.md"):
            f.writestr(n, n)
    assert [p for p, _ in files.unpack(z.getvalue(), "z")] == ["a.md", "d/b.md"]
    t = io.BytesIO()
    with tarfile.open(fileobj=t, mode="w:gz") as f:
        i = tarfile.TarInfo("x/y.md")
        i.size = 3
        f.addfile(i, io.BytesIO(b"abc"))
    assert files.unpack(t.getvalue(), "t") == [("x/y.md", b"abc")]
    with pytest.raises(files.ArchiveError):
        files.unpack(z.getvalue(), "z", max_entries=1)
    with pytest.raises(files.ArchiveError):
        files.unpack(t.getvalue(), "t", max_bytes=2)
    df = spark.createDataFrame([("z.zip", bytearray(z.getvalue())), ("bad", bytearray(b"no"))], "path string, content binary")
    got = files.unpack_table(df).collect()
    assert sorted(r.path for r in got if r.path) == ["a.md", "d/b.md"] and [r.archive for r in got if r.error] == ["bad"]


def test_questions(spark):
    lines = ['{"id":"a-1","query":"q","tags":["x"]}', "", '{"id":"a-1","query":"q2"}', '{"id":"B","query":"q"}', '{"id":"c","query":" "}', '{"id":"d","query":"q","zz":1}', "nope"]
    got = files.questions(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert sorted(str(r.fault) for r in got) == sorted(["repeated id", "repeated id", "bad id", "no query", "unknown key", "not an object"])
    ok = files.questions(spark.createDataFrame([(lines[0],)], "value string"))
    assert files.require_sound(ok).count() == 1
    with pytest.raises(Exception, match="line refused"):
        files.require_sound(files.questions(spark.createDataFrame([("nope",)], "value string"))).collect()


def test_front_matter_field(spark):
    t = spark.createDataFrame([("---\nurl: 'https://x/'\nother: 1\n---\nbody",), ("body",)], "t string")
    assert [r[0] for r in t.select(files.front_matter_field(F.col("t"), "url")).collect()] == ["https://x/", None]


def test_feeds(spark):
    drivers.register_all(spark)
    items = json.dumps([{"key": "1", "version": "a", "modified": "2024-01-01", "title": "t", "body": "b"}, {"key": "2", "version": "b", "modified": "2024-01-02", "title": "u", "body": None}])
    got = spark.read.format("quern_notion").option("items", items).load().collect()
    assert [(r.key, r.body) for r in got] == [("1", "b"), ("2", None)]
    with pytest.raises(Exception, match="no transport"):
        spark.read.format("quern_git").load().collect()


def test_items_of_the_last_time_are_neither_lost_nor_read_twice():
    items = [{"key": "1", "modified": "t1"}, {"key": "2", "modified": "t2"}]
    reader = drivers._Incremental(lambda options, since: [x for x in items if since is None or x["modified"] >= since], {})
    rows, at = reader.read(reader.initialOffset())
    assert [r[0] for r in rows] == ["1", "2"] and at == {"since": "t2", "seen": ["2"]}
    items.append({"key": "3", "modified": "t2"})
    rows, later = reader.read(at)
    assert [r[0] for r in rows] == ["3"] and later == {"since": "t2", "seen": ["2", "3"]}
    assert [r[0] for r in reader.read(later)[0]] == []
    items.append({"key": "4", "modified": "t2"})
    assert [r[0] for r in reader.readBetweenOffsets(at, later)] == ["3"]


def test_changes_in_the_scope_of_sources(spark):
    from quern.operators import ingest

    sources = [("a", 5), ("a", 9), ("a/b", 1), ("c/d/e", 3), ("", 0), (None, 0), ("z", None)]
    changes = [(p, t) for p in ("a/x.md", "a/b/x.md", "ab/x.md", "c/d/e/f/g.md", "c/d/x.md", "a", None, "z/x.md", "/x.md") for t in (0, 1, 3, 5, None)] + [("a/x.md", 5)]
    want = sorted((p, t) for p, t in changes if p is not None and t is not None and any(s and c is not None and p.startswith(s + "/") and t >= c for s, c in sources))
    df = spark.createDataFrame(changes, "relative_path string, changed_at int")
    got = ingest.in_source_scope(df, spark.createDataFrame(sources, "name string, created_at int"))
    assert sorted(tuple(r) for r in got.collect()) == want and want
    assert "NestedLoop" not in got._jdf.queryExecution().toString()


def test_line_numbers_do_not_depend_on_splits(spark, tmp_path):
    import random

    rng, want = random.Random(6), []
    for name in ("a.ndjson", "b.ndjson", "empty.ndjson"):
        lines = [] if name[0] == "e" else ["é" * rng.randrange(0, 30) + rng.choice(["", " ", "x"]) for _ in range(200)]
        (tmp_path / name).write_text("\n".join(lines), encoding="utf-8")
        want += [(name, i, v) for i, v in enumerate(lines, 1) if v.strip()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("50", "777", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = files.numbered_lines(spark, str(tmp_path))
            assert sorted(tuple(r) for r in got.collect()) == sorted(want)
            assert size == "100000" or spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    with pytest.raises(Exception, match=r"ndjson:\d+: has a line longer than 40 bytes"):
        files.numbered_lines(spark, str(tmp_path), 40).collect()


def test_dot_segments_and_references(spark):
    from quern.operators import web

    cases = {"http://h/a/b/../c": "http://h/a/c", "http://h/../../x": "http://h/x", "http://h/a/./b/.": "http://h/a/b/", "http://h/a/..": "http://h/", "http://h/a//b/../c": "http://h/a//c", "http://h/..a/b..": "http://h/..a/b..", "http://h?x=/../y": "http://h?x=/../y", "http://h": "http://h"}
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.v for r in df.select("u", web.fold_dots(F.col("u")).alias("v")).collect()} == cases
    text = {"a&#65;&#x42;&lt;b": "aAB<b", "&#128512;&#0;": "😀&#0;", "&#;&#x;&#12345678;": "&#;&#x;&#12345678;", "": "", "&amp;#65;": "&#65;"}
    df = spark.createDataFrame([(k,) for k in text] + [(None,)], "t string")
    got = {r.t: r.d for r in df.select("t", web.decode_references(F.col("t")).alias("d")).collect()}
    assert got == {**text, None: None}


def test_openapi():
    spec = {
        "openapi": "3.0.0",
        "paths": {"/a/{id}": {"parameters": [{"name": "id", "in": "path", "required": True, "schema": {"type": "string"}}], "get": {"summary": "Get", "operationId": "x", "responses": {"200": {"description": "ok", "content": {"application/json": {"schema": {"$ref": "#/components/schemas/N"}}}}}}, "post": {"operationId": "X", "requestBody": {"content": {"application/json": {"schema": {"allOf": [{"$ref": "#/components/schemas/N"}, {"properties": {"z": {"type": "integer"}}, "required": ["z"]}]}}}}}}},
        "components": {"schemas": {"N": {"type": "object", "properties": {"next": {"$ref": "#/components/schemas/N"}, "k": {"enum": ["a", "b"], "type": "string"}}}}},
    }
    got = dict(O.expand(json.dumps(spec)))
    assert len(got) == 2 and all(n.startswith("x-") for n in got)
    text = "".join(got.values())
    assert "`GET /a/{id}`" in text and "`id` (path, string, required)" in text and "One of: a, b." in text and "`z` (integer, required)" in text and "(see N)" in text
    with pytest.raises(O.SpecError):
        O.expand("{}")


def test_small_functions(spark):
    df = spark.createDataFrame([("a [[Page|shown]] [[Other#x]] %%hid%% ![[img]]\n> [!note] Hi", "my proj", "d/a b.md", "10.1.2.3", "10.0.0.0/8, ::1/128")], "t string, p string, f string, ip string, nets string")
    r = df.select(M.wiki_flavour(F.col("t")).alias("w"), M.document_uri(F.col("p"), F.col("f")).alias("u"), M.in_networks("ip", "nets").alias("n")).withColumn("back", M.parse_uri(F.col("u"))).first()
    assert r.w == "a shown Other  \n> **note** Hi" and r.u == "docs://my%20proj/d/a%20b.md" and r.n and (r.back.project, r.back.path) == ("my proj", "d/a b.md")
    assert M.fence("</document>").startswith("<document-1>")
    h = analytics.histogram(spark.createDataFrame([("a", 0.5), ("a", 3.0), ("a", float("nan")), ("a", None)], "k string, v double"), "v", ["k"], [1.0, 5.0])
    lines = [x.line for x in M.exposition(h, "lat", "k", [1.0, 5.0]).orderBy("i").collect()]
    assert lines[:3] == ['lat_bucket{k="a",le="1"} 1', 'lat_bucket{k="a",le="5"} 2', 'lat_bucket{k="a",le="+Inf"} 2'] and lines[-1] == 'lat_count{k="a"} 2'
    assert M.safe_root("/tmp/x/../y", ["/tmp"]) and not M.safe_root("/tmp/../etc", ["/tmp"])


def test_source_rules(spark):
    from quern.sources import rules

    stored = spark.createDataFrame([("a", "1", "x"), ("b", "2", "x"), ("c", "3", "y"), ("d", None, "y")], "key string, version string, space string")
    listing = spark.createDataFrame([("a", "1", "x"), ("b", "9", "x"), ("d", None, "y"), ("e", "1", "y")], "key string, version string, space string")
    assert sorted(r.key for r in rules.to_fetch(listing, stored).collect()) == ["b", "d", "e"]
    assert [r.key for r in rules.removals(listing, stored, space="space", spaces=["x", "y"]).collect()] == ["c"]
    assert rules.removals(listing.filter("false"), stored.filter("false")).count() == 0
    with pytest.raises(rules.Refused):
        rules.removals(listing.filter("false"), stored)
    with pytest.raises(rules.Refused, match="in y,"):
        rules.removals(listing.filter("space = 'x'"), stored, space="space", spaces=["x", "y"])
    assert (rules.run_mode(spark.range(100)), rules.run_mode(spark.range(101))) == ("incremental", "full")
    assert spark.range(1).select(rules.fetch_since(F.lit("2024-01-01 00:02:00").cast("timestamp")).cast("string")).first()[0] == "2023-12-31 23:57:00"


def test_import_replay(spark):
    from quern.sources import rules

    sources = spark.createDataFrame([("s", "v2"), ("t", None)], "source string, version string")
    row = lambda path, source, dim: (path, source, "h", "text", [(0, "H", "c", 1, [0.5] * dim)])
    schema = rules.T.StructType([*[rules.T.StructField(n, rules.T.StringType()) for n in ("relative_path", "source", "content_hash", "content")], rules.T.StructField("chunks", rules.CHUNK)])
    good = spark.createDataFrame([row("a", "s", 3), row("b", None, 3), row("c", "t", 3), ("d", "s", "h", "", [])], schema)
    docs, chunks = rules.replay_import(good, sources, 3)
    assert sorted((r.relative_path, r.version, r.generation) for r in docs.collect()) == [("a", "v2", 0), ("b", "", 0), ("c", "", 0), ("d", "v2", 0)]
    assert sorted((r.relative_path, r.chunk_index, len(r.embedding)) for r in chunks.collect()) == [("a", 0, 3), ("b", 0, 3), ("c", 0, 3)]
    for bad, why in ((row("x", "gone", 3), "unknown_source: x"), (row("x", "s", 4), "dimension_mismatch: x")):
        with pytest.raises(Exception, match=why):
            rules.replay_import(spark.createDataFrame([bad], schema), sources, 3)[0].collect()
