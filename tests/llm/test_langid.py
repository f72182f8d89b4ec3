"""Language identification: exact code lengths of pruned trees by dictionaries, and tables with little or odd text."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import langid


def plain_tree(train, symbols, min_count, max_states):
    """symbol of each byte, counts by context, contexts kept; most frequent first, ties to the smaller symbols."""
    seen = Counter(b for t in train for b in t)
    seen[10] += 1
    alphabet = sorted(sorted(seen, key=lambda b: (-seen[b], b))[:symbols])
    sym = {b: i + 1 for i, b in enumerate(alphabet)}
    counts = {}
    for t in train:
        x = [sym.get(b, 0) for b in b"\n" * 3 + t]
        for i in range(3, len(x)):
            for k in range(4):
                counts.setdefault(tuple(x[i - k : i]), Counter())[x[i]] += 1
    kept, room = {()} | {(s,) for s in range(len(alphabet) + 1)}, max_states
    for k in (2, 3):
        some = [c for c in counts if len(c) == k and sum(counts[c].values()) >= min_count and c[1:] in kept]
        some = sorted(some, key=lambda c: (-sum(counts[c].values()), c))[:room]
        room -= len(some)
        kept |= set(some)
    return sym, counts, kept


def plain_bits(text, tree):
    sym, counts, kept = tree
    x = [sym.get(b, 0) for b in b"\n" * 3 + text]
    others, bits = 256 - len(sym), 0.0
    for i in range(3, len(x)):
        p = 1.0
        for k in range(3, -1, -1):
            ctx = tuple(x[i - k : i])
            # a longer context stands only on a kept shorter one
            if any(ctx[-m:] not in kept for m in range(1, k + 1)) or ctx not in counts:
                continue
            c = counts[ctx]
            n = sum(c.values())
            if x[i] in c:
                p *= c[x[i]] / (n + len(c)) / (others if x[i] == 0 else 1)
                break
            p *= len(c) / (n + len(c))
        else:
            p /= 256
        bits -= np.log2(p)
    return bits


def counted(texts):
    off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    return langid.grams(np.frombuffer(b"".join(texts), np.uint8), off)


@pytest.mark.parametrize("symbols,min_count,max_states", [(127, 1, 5000), (127, 3, 5000), (6, 2, 9), (4, 1, 3), (127, 8, 5000)])
def test_code_lengths_are_exact(monkeypatch, symbols, min_count, max_states):
    monkeypatch.setattr(langid, "SYMBOLS", symbols)
    monkeypatch.setattr(langid, "MIN_COUNT", min_count)
    monkeypatch.setattr(langid, "MAX_STATES", max_states)
    train = {"a": [b"abracadabra abra", b"cad abr", b""], "b": [b"bob ate a boat " * 9, b"toe"], "c": ["дом и сад".encode() * 5]}
    m = langid.Model(sorted(train), [langid.fit(*counted(train[x])) for x in sorted(train)])
    rows = [b"abra", b"boat zzz", b"", b"a\xff", "садовод".encode(), b"\n"]
    off = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    got = m.lengths(np.frombuffer(b"".join(rows), np.uint8), off)
    for r, g in zip(rows, got):
        for j, lang in enumerate(m.langs):
            assert g[j] == pytest.approx(plain_bits(r, plain_tree(train[lang], symbols, min_count, max_states)), rel=1e-5)


@pytest.mark.parametrize("texts", [["ab"], ["ab", "cd"], [f"text {i}" for i in range(10)], [""], ["ж", "ω", "漢字"]])
def test_few_short_texts(spark, texts):
    rows = [(i, t, f"l{i % 3}", 1) for i, t in enumerate(texts * 4)] + [(None, "x", "l0", 2), (99, None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred int")
    got = langid.identify(docs).collect()
    assert len(got) == len(rows)
    assert all(r.lang_pred in {"l0", "l1", "l2", "und"} and 0 <= r.score <= 1 for r in got)


def test_many_languages_in_many_scripts(spark):
    """Each language keeps its own alphabet and its own contexts."""
    rng = np.random.default_rng(1)
    rows, n = [], 0
    for k in range(40):
        letters = [chr(0x100 + 0x40 * k + i) for i in range(24)]
        weight = rng.dirichlet(np.ones(24))
        for _ in range(30):
            rows.append((n, " ".join("".join(rng.choice(letters, 5, p=weight)) for _ in range(20)), f"x{k:02}"))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = {r[0]: r[2] for r in rows}
    got = [r for r in langid.identify(docs).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id] or r.lang_pred == "und" for r in got]) > 0.97


def test_ids_with_two_texts_are_read_the_same_way(spark):
    rows = [(i % 5, f"{'abc' if i % 2 else 'xyz'} text {i}", "a") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (langid.train(d, langid.sampling.fold(5) != 0) for d in (docs, docs.repartition(7)))
    assert np.array_equal(one.trees[0].cost, two.trees[0].cost)


def test_empty_model():
    names, scores = langid.predict(langid.Model([], []), pa.array(["text", None]))
    assert names == ["und", "und"] and not scores.any()
