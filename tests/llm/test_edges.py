"""Every operator on a messy table (nulls, empty and very long texts, ties, repeated rows, clashing extra columns) and on
empty tables, with the results that the docstrings state."""

import pytest

from quern.llm import crosspolytope, langid, licenses, mixing, quality, sharding, simhash, tiling, toxicity, wrapper

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, _fp string, size string, copies string, _src string, key string"
LONG = "lorem ipsum dolor sit amet " * 20_000
ROWS = [
    (1, "a plain text of some words that stands here", "en", "a", 5),
    (1, "a plain text of some words that stands here", "en", "a", 5),
    (2, None, None, None, None),
    (3, "", "en", "b", 0),
    (4, " \n\t ", None, "b", 4),
    (5, LONG, "en", "a", len(LONG)),
    (6, "a plain text of some words that stands here", "en", None, 5),
    (None, "no id but some words in here", "de", "c", 1),
    (None, None, None, None, None),
    (7, "Ünïcödé 😀 text\x00with odd bytes", "de", "", 3),
    (8, "1234 !!", "de", "c", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = (0.5, "x", "y", "z", "q", "r", "k")
    return spark.createDataFrame([r + extra for r in ROWS], DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 0, 1), (6, 1, 0), (7, None, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")


def test_quality(docs, empty, labels):
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert quality.classify(empty, labels).count() == 0
    none = quality.classify(docs, labels.filter("false")).collect()
    assert len({r.score for r in none}) == 1
    model = quality.train(docs, labels, quality.sampling.fold(5) != 0)
    assert quality.keep_good(docs, model, 0.0).count() == len(ROWS) and quality.keep_good(docs, model).columns == docs.columns


def test_toxicity(docs, empty, labels):
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.classify(empty, labels).count() == 0
    assert {r.score for r in toxicity.classify(docs, labels.filter("false")).collect()} == {0.5}


def test_language(docs, empty):
    got = langid.identify(docs).collect()
    assert len(got) == len(ROWS)
    undetermined = [r for r in got if r.lang_pred == "und"]
    assert all(r.score == 0 for r in undetermined) and {r.doc_id for r in undetermined} >= {2, 3, 4, 8}
    assert langid.identify(empty).count() == 0


def test_simhash(docs, empty):
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[6].component_id == 1 and by[2].fingerprint == "0" * 16 == by[4].fingerprint
    assert {by[i].component_id for i in (2, 3, 4)} == {2}
    assert any(r.doc_id is None and r.component_id == 2 for r in got)
    assert simhash.near_duplicates(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix_documents(docs).collect()
    assert len(got) == len(ROWS) and all(0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in got)
    assert mixing.mix_documents(empty).count() == 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in got)
    assert mixing.mixed(empty).count() == 0


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, 4).collect()
    assert len(got) == len(ROWS)
    counts = {s: sorted(r.slot for r in got if r.shard == s) for s in range(4)}
    assert all(v == list(range(len(v))) for v in counts.values()) and max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert next(r for r in got if r.doc_id == 2).size == 16
    assert sharding.shard_documents(empty).count() == 0
    assert {r.shard for r in sharding.shard_documents(docs, 40).collect()} <= set(range(40))


def test_licenses(docs, empty):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert got[2].n_words == 0 and got[2].labels == "" and got[2].first_word is None and got[2].score == 0
    assert got[5].n_words == 100_000
    assert licenses.scan_licenses(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "some words that stands here"), (2, None), (3, ""), (4, "no id"), (5, "lorem ipsum dolor sit amet lorem ipsum")], "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in tiling.contaminated(docs, items).collect())
    assert got == [("1", 1), ("1", 1), ("5", 5), ("6", 1), ("None", 4)]
    assert tiling.contaminated(empty, items).count() == 0 and tiling.contaminated(docs, items.filter("false")).count() == 0
    assert tiling.drop_contaminated(docs, items).count() == len(ROWS) - 5
    # more blocks than one give the same
    assert sorted((str(r.doc_id), r.item_id) for r in tiling.contaminated(docs, items, max_words=1).collect()) == got


def test_neighbours(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.6, 0.8]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, None]), (8, []), (9, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (2, [1.0, 0.0])]
    t = spark.createDataFrame([r + ("x",) for r in rows], "vec_id long, embedding array<float>, query_id string")
    got = sorted((r.query_id, r["rank"], r.vec_id) for r in crosspolytope.neighbours(t, 2).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (20, 1, 0), (20, 2, 1)]
    assert crosspolytope.neighbours(t.filter("false")).count() == 0
    assert crosspolytope.neighbours(t.filter("vec_id = 9")).count() == 0


def test_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    rows = [(1, "http://h/a", None), (2, "http://h/b", ""), (3, None, "<p>x &amp; y<p>z"), (None, "http://h/c", "<article><p>t"), (4, "nope", deep), (4, "nope", deep), (5, "http://h/d", "plain")]
    t = spark.createDataFrame([r + ("e",) for r in rows], "page_id long, url string, html string, host string")
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in wrapper.extract(t).collect())
    assert got == [("1", "", 0), ("2", "", 0), ("3", "x & y\nz", 7), ("4", "deep", 4), ("4", "deep", 4), ("5", "plain", 5), ("None", "t", 1)]
    assert wrapper.extract(t.filter("false")).count() == 0
    # the join path gives what the broadcast gives
    assert sorted((str(r.page_id), r.text, r.n_chars) for r in wrapper.extract(t, broadcast_bytes=-1).collect()) == got
