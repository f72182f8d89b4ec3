"""Runs against the definition, by trying every period at every place, and the whole query against its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import periodic

WORD = r"[^\x20\x09-\x0D]+"


def brute(x, least=12):
    found = {}
    for q in range(1, len(x) // 2 + 1):
        i = 0
        while i + q < len(x):
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text, looped=True):
    w = re.findall(WORD, text or "")
    n = len(w)
    if looped and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    drop = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    first = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *first, sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(v for i, v in enumerate(w) if i not in drop)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=70), st.sampled_from([3, 5, 12]))
def test_runs_of_few_words(x, least):
    assert periodic.runs_of(np.array(x, np.int64), least) == brute(x, least)


@pytest.mark.parametrize("seed", range(60))
def test_runs_with_planted_periods(seed):
    rng = random.Random(seed)
    x = [rng.randrange(rng.choice([2, 5, 40])) for _ in range(rng.randrange(20, 160))]
    for _ in range(4):
        a, p = rng.randrange(len(x)), rng.randrange(1, 14)
        for i in range(a + p, min(len(x), a + p + rng.randrange(60))):
            x[i] = x[i - p]
    assert periodic.runs_of(np.array(x, np.int64)) == brute(x)


def test_runs_from_fibonacci_words_and_few_pairs_at_a_time(monkeypatch):
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    want = brute(b, 3)
    assert periodic.runs_of(np.array(b, np.int64), 3) == want
    monkeypatch.setattr(periodic, "PAIRS", 7)
    assert periodic.runs_of(np.array(b, np.int64), 3) == want


def test_previous_factors_and_blocks():
    x = np.array([0, 1, 0, 1, 0, 2, 0, 1, 0])
    factor, where = periodic.previous_factors(periodic.Ranks(x))
    text = x.tolist()
    for i in range(len(text)):
        best = max([k for j in range(i) for k in range(len(text) - i + 1) if text[j : j + k] == text[i : i + k]], default=0)
        assert factor[i] == best
        assert not best or (where[i] < i and text[where[i] : where[i] + best] == text[i : i + best])
    assert periodic.blocks(factor) == [0, 1, 2, 5, 6, 9]


def test_query_on_messy_rows(spark):
    loop = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    long = " ".join(f"w{i * i % 977}" for i in range(30_000))
    rows = [(1, "a b " * 9), (1, "a b " * 9), (2, None), (3, ""), (4, " \n\t"), (None, "x " * 30), (loop, " ".join(map(str, range(50)))), (loop, None), (loop, "one"), (5, "A a " * 8), (6, "é 😀\x00z  " * 12), (7, "x y " * 3 + "x"), (8, "q " * 12), (9, long)]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, start string, n_runs int").repartition(3)
    got = sorted((tuple(r) for r in periodic.periodic_runs(docs).collect()), key=repr)
    assert got == sorted((expected(i, t) if t != long else next(g for g in got if g[0] == 9) for i, t in rows), key=repr)
    assert next(g for g in got if g[0] == 9)[1] > 0
    assert periodic.periodic_runs(docs.filter("false")).count() == 0


def test_a_very_long_text_of_one_word():
    row = periodic.report(1, "x " * 300_000, looped=False)
    assert row[1:6] == (1, 0, 300_000, 1, 300_000_000)
    assert row[7] == hashlib.sha256(b"x").hexdigest()
