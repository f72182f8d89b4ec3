"""Circulant signatures, and the whole query against all pairs."""

import random
import re

import numpy as np
import pytest

from quern.llm import circulant, neardup
from tests.llm.test_brute import LOW, union


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {" ".join(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def expected(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    top = union(len(rows), links)
    first = {}
    for (d, _), t in zip(rows, top):
        first[t] = min(x for x in (first.get(t), d) if x is not None) if (first.get(t), d) != (None, None) else None
    return sorted(((d, len(s), first[t], d is not None and d == first[t]) for (d, _), s, t in zip(rows, sets, top)), key=repr)


def test_places_are_permutations_and_shifts_are_circular():
    x = np.array([0, 1, 2, 2**63, 2**64 - 1, 2**64 - 2], np.uint64)
    rng = np.random.default_rng(1)
    many = np.unique(np.concatenate([x, rng.integers(0, 2**64, 50_000, dtype=np.uint64)]))
    assert len(np.unique(circulant.scatter(many))) == len(many) == len(np.unique(circulant.place(many)))
    s = circulant.scatter(many)
    one = np.array([0])
    plain = [min(int(circulant.place(np.array([(int(v) + k) % 2**64], np.uint64))[0]) for v in s[:40]) for k in (0, 1, 2**64 - 1)]
    assert [int(circulant.coordinate(s[:40], one, k)[0]) for k in (0, 1, 2**64 - 1)] == plain


def test_coordinates_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    for common in (300, 600, 900):
        a, b = pool[:1000], np.concatenate([pool[:common], pool[1000 : 2000 - common]])
        j = common / (2000 - common)
        s = circulant.scatter(np.concatenate([a, b]))
        same = [len(set(circulant.coordinate(s, np.array([0, 1000]), k).tolist())) == 1 for k in range(1500)]
        assert abs(np.mean(same) - j) < 0.06


@pytest.mark.parametrize("block", [2, 2048])
def test_whole_query_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    rng = random.Random(11)
    texts = []
    for _ in range(14):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([1, 2, 3, 9, 11, 60, 200]))]
        for _ in range(8):
            w = list(base)
            for _ in range(rng.randrange(0, len(w) // 12 + 2)):
                w[rng.randrange(len(w))] = f"X{rng.randrange(3000)}"
            texts.append(rng.choice([" ", "\n", "  "]).join(w))
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(1000, None), (1001, ""), (1002, " \t"), (3, texts[5]), (3, texts[5]), (None, texts[7]), (None, "nothing like it"), (None, "nothing like it"), (None, None), (1003, "One"), (1004, "one"), (1005, "long text " * 40_000)]
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, _h string, component_id int").repartition(3)
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs, shingle=2).collect()), key=repr)
    assert got == expected(rows)
    assert neardup.near_duplicates(docs.filter("false"), shingle=2).count() == 0


def test_similarity_of_exactly_four_fifths_links():
    x = np.arange(9, dtype=np.uint64)
    assert neardup.alike(x[:8], np.concatenate([x[:8], x[:2] + np.uint64(50)]), 80)
    assert not neardup.alike(x, x[:7], 80) and neardup.alike(np.arange(15, dtype=np.uint64), np.arange(12, dtype=np.uint64), 80)


def test_the_pipelines_stage_keeps_values_of_columns_with_names_of_its_own(spark):
    cols = ["_h", "_c", "_node", "set", "hub", "n", "bands", "root", "k_0"]
    rows = [(i, "some words that are here for all to read and copy" if i < 3 else f"another text number {i} of this table", *[f"{c}-{i}" for c in cols]) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, " + ", ".join(f"`{c}` string" for c in cols))
    got = neardup.drop_near_duplicates(docs)
    assert got.schema.names == docs.schema.names and sorted(tuple(r) for r in got.collect()) == [rows[0], rows[3], rows[4]]
