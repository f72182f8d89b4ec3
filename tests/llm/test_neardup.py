"""Near-duplicate stage of the pipeline against all pairs by brute force."""

import random

import pyarrow as pa
import pytest

import corpus_pipeline
from quern.llm import neardup
from tests.llm.test_brute import union

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b)


@pytest.mark.parametrize("block", [2, 2048])
def test_stage_finds_near_copies_down_to_the_threshold(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    rng = random.Random(7)
    texts = []
    for g in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([3, 40, 120, 300]))]
        texts.append(" ".join(base))
        for _ in range(9):  # a few words replaced: similarities from 0.6 to 1
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 40) + 1)):
                w[rng.randrange(len(w))] = f"x{rng.randrange(5000)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    sets = [shingles(t) for t in texts]
    want = union(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if near(sets[i], sets[j])])
    assert any(want[i] == want[j] and len(sets[i] & sets[j]) < 0.9 * len(sets[i] | sets[j]) for i in range(len(texts)) for j in range(i))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], COLUMNS).repartition(3)
    got = corpus_pipeline.distinct_documents(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want))


def test_forest_across_parts_joins_what_pairs_join():
    import numpy as np

    rng = random.Random(3)
    sets = [np.array(sorted(rng.sample(range(14), 10)), np.uint64) for _ in range(60)]
    part = np.array([rng.randrange(2) for _ in sets])
    plain = [set(s.tolist()) for s in sets]
    want = union(60, [(i, j) for i in range(60) for j in range(i) if part[i] != part[j] and near(plain[i], plain[j])])
    assert union(60, neardup.forest(sets, part, list(range(60)), 80)) == want


def test_shingle_sets():
    rows = ["A b c d e f", None, " ", "b c", "b c d e f"]
    (i, g, off), = neardup.shingle_sets(pa.array(rows, pa.string()))
    assert [int(x) for x in off] == [0, 2, 2, 2, 3, 4] and g[1] == g[3]


def test_one_row_of_each_component_whatever_its_id(spark):
    one, two, three = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "uno dos tres cuatro cinco seis")
    rows = [(1, one), (1, two), (1, two), (0, two), (None, three), (None, three), (None, one), (5, None), (None, " ")]
    docs = spark.createDataFrame([r + ("en", None, 3) for r in rows], COLUMNS).repartition(3)
    got = corpus_pipeline.distinct_documents(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, one), (0, two), (None, three), (5, None)], key=str)
    hot = spark.createDataFrame([(3, f"text number {i} of many", "en", "s", 1) for i in range(50)], COLUMNS)
    assert corpus_pipeline.distinct_documents(spark, hot, "").count() == 50
    assert corpus_pipeline.distinct_documents(spark, docs.filter("false"), "").count() == 0


def test_near_fingerprints_are_candidates_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BANDS", 1)
    monkeypatch.setattr(neardup, "ROWS", 3000)  # one band of so many coordinates, which only equal sets share
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    texts = [" ".join(base), " ".join(base[:2000] + ["other"] + base[2001:]), " ".join(base[:3900]), "some other text of its own", " ".join(rng.sample(base, 4000))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], COLUMNS).repartition(2)
    rows = neardup.signatures(docs.withColumn("_h", docs.doc_id), neardup.SHINGLE, 1, 3000, votes=True).collect()
    fps, bands = {r.doc_id: r._fp % 2**64 for r in rows}, {r.doc_id: r.bands for r in rows}
    assert len({tuple(b) for b in bands.values()}) == 5
    linked = {i for i in range(1, 5) if (fps[0] ^ fps[i]).bit_count() <= 2}
    assert 1 in linked and not linked & {3, 4}
    assert sorted(r.doc_id for r in corpus_pipeline.distinct_documents(spark, docs, "").collect()) == sorted(set(range(5)) - linked)


def test_fingerprint_pairs(spark):
    nodes = [(5, 0), (3, 0), (9, 3), (7, 3 << 40), (1, 7), (8, -1), (2, -2), (4, 0x55555555)]
    pairs = [tuple(r) for r in neardup.fingerprint_pairs(spark.createDataFrame(nodes, "_node long, _fp long")).distinct().collect()]
    assert sorted(pairs) == [(1, 9), (2, 8), (3, 5), (3, 7), (3, 9)]


def test_blocks_find_links_that_do_not_touch_the_smallest_node(spark):
    docs = []
    for g in range(6):
        base = [f"w{g}x{i}" for i in range(100)]
        for k in range(6):  # copies of a base, each with other words at its end
            w = base[: 100 - 3 * k] + [f"y{g}k{k}i{i}" for i in range(3 * k)]
            docs.append((len(docs), " ".join(w)))
    sets = [shingles(t) for _, t in docs]
    want = union(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if near(sets[i], sets[j])])
    frame = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], COLUMNS).repartition(2)
    assert sorted(r.doc_id for r in corpus_pipeline.distinct_documents(spark, frame, "").collect()) == sorted(set(want))


def test_buckets_whose_pairs_have_all_been_met_are_not_compared_again(spark):
    # buckets by key: 1 has one node besides the smallest, 2 two of one component, 3 two of two
    others = spark.createDataFrame([(0, 1, 11, 5), (0, 2, 21, 5), (0, 2, 22, 5), (0, 3, 31, 5), (0, 3, 32, 5)], "t int, key long, _node long, n long")
    label = spark.createDataFrame([(21, 20), (22, 20), (31, 30)], "_node long, root long")
    assert sorted(tuple(r) for r in neardup.undecided(others, label).collect()) == [(0, 3, 31, 30, 1), (0, 3, 32, 32, 1)]
