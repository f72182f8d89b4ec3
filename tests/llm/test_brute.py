"""Operators against plain versions of their definitions."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import components, crosspolytope, langid, licenses, mixing, quality, sharding, simhash, tiling, toxicity, wrapper
from quern.llm import textkernel as tk

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
texts = st.lists(st.text(alphabet="aAb \n\t.éß😀1", max_size=40), max_size=8)


@settings(max_examples=50, deadline=None)
@given(texts)
def test_words_and_grams(rows):
    seen = {}
    for i, j, data, off in tk.pieces(pa.array(rows, pa.string()), 16):
        s, e, wo = tk.spans(data, off, tk.NOT_SPACE)
        h = tk.word_hashes(data, s, e)
        g, at = tk.grams(h, wo, 2)
        own = tk.owner(wo, at).tolist()
        for k in range(j - i):
            words = re.findall(r"[^\x20\x09-\x0D]+", rows[i + k])
            a, b = wo[k], wo[k + 1]
            assert [data[x:y].tobytes().decode() for x, y in zip(s[a:b], e[a:b])] == words
            assert own.count(k) == max(0, len(words) - 1)
            for w, x in zip(words, h[a:b].tolist()):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=50, deadline=None)
@given(texts)
def test_fingerprints(rows):
    got = simhash.fingerprints(pa.array(rows, pa.string())).view(np.uint64).tolist()
    assert got == [fingerprint(t) for t in rows]


def union(n, pairs):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("hot", [1, 16])
def test_links_keep_components(spark, hot):
    rng = random.Random(hot)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:6]:  # groups of near copies around some, all within a few bits
        for _ in range(40):
            fps.add(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(8)))
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = union(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    links = simhash.links(spark.createDataFrame([(x,) for x in signed], "_fp long"), hot).collect()
    at = {x: i for i, x in enumerate(signed)}
    for a, b in links:
        assert union(len(fps), []) and want[at[a]] == want[at[b]]
    assert union(len(fps), [(at[a], at[b]) for a, b in links]) == want


def test_components(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(300, pairs)
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert set(got) == nodes
    for x in nodes:
        for y in nodes:
            assert (got[x] == got[y]) == (want[x] == want[y])


def greedy_tiles(doc, item, k):
    md, mi, tiles = [0] * len(doc), [0] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and not md[i + n] and not mi[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < k:
            return tiles
        n, i, j = best
        md[i : i + n], mi[j : j + n] = [1] * n, [1] * n
        tiles.append((i, j, n))


@pytest.mark.parametrize("values", [1, 2, 3, 9])
def test_tiles_follow_the_greedy_definition(values):
    rng = random.Random(3)
    for _ in range(120):
        doc, item, k = [rng.randrange(values) for _ in range(rng.randrange(3, 40))], [rng.randrange(values) for _ in range(rng.randrange(3, 15))], 3
        if rng.random() < 0.5:  # periods, and parts of the item in another order
            doc = (doc[: rng.randrange(1, 5)] * 12)[:20] + item[5:] + doc[:3] + item[:5]
        assert tiling.tile(np.array(doc, np.uint64), np.array(item, np.uint64), k) == greedy_tiles(doc, item, k)


def test_a_text_of_one_word_costs_what_others_do():
    import resource
    import time

    index = tiling.Index([1], ["x " * 1000], 5)
    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert list(tiling.matches(index, pa.array(["x " * 100_000]), 0.5)) == [(0, 0, 1000, 1000, 1)]
    assert time.time() - began < 10 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000


def plain_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (text or "").translate(LOW))


def test_whole_query_against_the_greedy_definition(spark):
    rng = random.Random(8)
    pool = [f"w{i}" for i in range(40)]
    items = [(n, " ".join(rng.choice(pool) for _ in range(rng.choice([2, 4, 7, 20])))) for n in range(25)] + [(90, None), (91, ""), (92, "a a a a a a a a")]
    docs = []
    for d in range(60):
        text = [rng.choice(pool) for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            cut = rng.randrange(len(w) + 1)
            text += rng.choice([w, w[cut:] + ["zz"] + w[:cut], w[: len(w) // 2]])
        docs.append((d if d % 7 else None, rng.choice([" ", ", ", "\n"]).join(text)))
    docs += [(500, None), (501, "a " * 50), (501, "a " * 50)]
    want = []
    for d, t in docs:
        own = plain_words(t)
        for n, x in items:
            w = plain_words(x)
            tiles = greedy_tiles(own, w, min(5, len(w))) if w else []
            if w and sum(m for _, _, m in tiles) >= 0.5 * len(w):
                want.append((d, n, sum(m for _, _, m in tiles), len(w), len(tiles)))
    made = [spark.createDataFrame(rows, f"{i} long, text string").repartition(3) for rows, i in ((docs, "doc_id"), (items, "item_id"))]
    got = [tuple(r) for r in tiling.contaminated(*made).select("doc_id", "item_id", "tiled_words", "item_words", "tiles").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and len(want) > 30


def test_reordered_passages_are_caught(spark):
    item = " ".join(f"w{i}" for i in range(30))
    w = item.split()
    mixed = "x " + " ".join(w[20:30]) + " y y " + " ".join(w[0:10]) + " z " + " ".join(w[10:20])
    docs = spark.createDataFrame([(1, mixed), (2, " ".join(w[:8]) + " other words entirely here"), (3, item.upper() + ".")], "doc_id long, text string")
    got = {r.doc_id: r.coverage for r in tiling.contaminated(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()}
    assert got == {1: 1.0, 3: 1.0}


def test_automaton_statistics():
    rng = random.Random(1)
    seqs = [[rng.randrange(4) for _ in range(rng.randrange(1, 12))] for _ in range(5)]
    auto = licenses.Automaton(seqs)
    runs = {tuple(s[i:j]): None for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for _ in range(100):
        text = [rng.randrange(5) for _ in range(20)]
        for i, (n, v) in enumerate(auto.statistics(text)):
            want = max((k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in runs))
            assert n == want
            if n:
                run = text[i + 1 - n : i + 1]
                assert auto.ends[v] == sorted((t, e) for t, s in enumerate(seqs) for e in range(n, len(s) + 1) if s[e - n : e] == run)


def test_runs_of_each_template():
    """Every template's own longest runs, also of templates that stand inside others, against a plain search."""
    rng = random.Random(4)
    templates = ["a b c d e f g h", "c d e f", "x c d e f g y", "b c a b c a", "e f"]
    sc = licenses.Scanner([(str(i), t) for i, t in enumerate(templates)], [], min_match=3)
    seqs = [licenses.words(t) for t in templates]
    for _ in range(150):
        text = [h for _ in range(4) for h in (lambda s, i: s[i : i + rng.randrange(1, 8)])(rng.choice(seqs), rng.randrange(3))]
        want = set()
        for t, s in enumerate(seqs):
            longest = [max((k for k in range(i + 1) if any(s[e - k : e] == text[i - k : i] for e in range(k, len(s) + 1))), default=0) for i in range(len(text) + 1)]
            for i in range(1, len(text) + 1):
                k = longest[i]
                if k >= min(3, len(s)) and (i == len(text) or longest[i + 1] != k + 1):
                    want |= {(t, i - k + 7, e - k, k) for e in range(k, len(s) + 1) if s[e - k : e] == text[i - k : i]}
        got = sc.spans(text, 7)
        assert set(got) == want and len(got) == len(want)


def test_licence_inside_a_longer_one():
    apache, by_nc = licenses.TEMPLATES[4][1], licenses.TEMPLATES[9][1]
    cut = " ".join(apache.split()[:14])  # the short notice whole, a fifth of the long one
    changed = apache.replace("except", "only").replace("writing,", "print,").replace("distributed on", "given on")
    sc = licenses.Scanner()
    got = list(sc.scan(pa.array([cut, by_nc, changed, apache + " " + apache, "the gnu general public license " * 9])))
    assert got[0][5] == "apache" and got[0][6] == 1.0 and [x[:2] for x in got[0][7]] == [(0, 8)]
    assert got[1][5] == "cc-by-nc" and len(got[1][7]) == 1
    assert got[2][5] == "apache" and got[2][7][0][0] == 0 and len([x for x in got[2][7] if x[2] == 4]) == 1
    assert len([x for x in got[3][7] if x[2] == 4]) == 2 and got[3][6] == 1.0
    assert got[4][5] == "gpl" and got[4][7] == []


def test_licence_spans_and_base(spark):
    mit = licenses.TEMPLATES[2][1]
    rows = [(1, "before " + mit + " after"), (2, "Licensed under CC BY-NC 4.0. Apache  LICENSE! gnu general public license"), (3, "permission is hereby granted to nobody")]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == "mit" and got[1].base_labels == "" and got[1].spans[0].first == 1 and got[1].score == 1.0
    assert got[2].base_labels == "apache,cc-by,gpl" and got[2].labels == "apache,cc-by,cc-by-nc,gpl" and (got[2].n_base, got[2].first_word, got[2].last_word) == (3, 2, 9)
    assert got[3].labels == ""


def test_mixing_matches_plain_water_filling(spark):
    rng = random.Random(2)
    rows = [(i, f"s{rng.randrange(5)}" if i % 11 else None, rng.choice([0, 3, 10, 40])) for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, float(sum(sizes.values())), set(order)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        free -= over
    taken = {}
    for r in got:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in order:
        assert target[s] - 40 <= taken[s] <= target[s] + 1e-6
    again = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_shards_match_the_mixture(spark):
    rows = [(i, "big" if i % 3 else f"s{i % 7}", f"t{i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = sharding.shard_documents(df, 9).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    for r in got:
        assert r.text_crc32 == zlib.crc32(f"t{r.doc_id}".encode())
    for s in {x[1] for x in rows}:
        n = sum(x[1] == s for x in rows)
        per = [sum(r.source == s and r.shard == k for r in got) for k in range(9)]
        assert max(per) <= n / 9 + 4 and min(per) >= n / 9 - 4  # one row a source at each end
    again = sharding.shard_documents(df.repartition(5), 9).collect()
    assert sorted((r.doc_id, r.shard, r.slot) for r in got) == sorted((r.doc_id, r.shard, r.slot) for r in again)


@pytest.mark.parametrize("scaled", [False, True])
def test_neighbour_recall(spark, scaled):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if scaled:
        x *= rng.uniform(0.5, 1.5, (800, 1))
    x = x.astype(np.float32)
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in crosspolytope.neighbours(t, 10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    y = x.astype(np.float64)
    hits = []
    for q in range(0, 800, 20):
        s = (y * y[q]).sum(axis=1)
        s[q] = -9
        want = np.lexsort((np.arange(800), -s))[:10]
        rows = sorted(got[q])
        assert [r[0] for r in rows] == list(range(1, 11)) and all(v == pytest.approx(s[i], abs=1e-12) for _, i, v in rows)
        hits.append(len({i for _, i, _ in rows} & set(want.tolist())) / 10)
    assert np.mean(hits) >= 0.9


def test_hadamard_is_orthonormal():
    h = crosspolytope.hadamard(np.eye(8))
    assert np.allclose(h @ h.T, np.eye(8))


def test_wrapper_drops_template_and_keeps_articles(spark):
    def page(i):
        menu = "".join(f"<li><a href='/{k}'>m{k}</a>" for k in range(4))
        body = "".join(f"<p>par {i} {k} &eacute; <b>bold</b>" for k in range(i % 3 + 1))
        return f"<html><head><title>t</title><script>var a='</p>'</script></head><body><div id=top>Site name</div><ul>{menu}</ul><div class=story><h1>Head {i}</h1>{body}</div><div>All rights reserved</div><div class='comments'><p>reader {i}</div></body>"

    rows = [(i, f"http://host.example/{i}", page(i)) for i in range(30)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(30):
        assert got[i] == "\n".join([f"Head {i}", *[f"par {i} {k} é bold" for k in range(i % 3 + 1)]])


def test_simple_tree_matching_is_maximal():
    rng = random.Random(4)

    def tree(d):
        return wrapper.Node(rng.choice("ab"), "", [tree(d - 1) for _ in range(rng.randrange(0, 4))] if d else [])

    def best(a, b):
        if a.label != b.label:
            return 0
        m = [[0] * (len(b.children) + 1) for _ in range(len(a.children) + 1)]
        for i, x in enumerate(a.children):
            for j, y in enumerate(b.children):
                m[i + 1][j + 1] = max(m[i][j + 1], m[i + 1][j], m[i][j] + best(x, y))
        return 1 + m[-1][-1]

    for _ in range(200):
        a, b = tree(3), tree(3)
        assert len(wrapper.match(a, b)) == best(a, b)


def test_held_out_accuracy(spark, sf):
    from quern.session import table

    sf = sf.replace("0.001", "0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    truth = {r.doc_id: r for r in labels.collect()}
    q = [r for r in quality.classify(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id].quality for r in q]) > 0.9
    t = [r for r in toxicity.classify(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id].toxic for r in t]) > 0.8
    lang = {r.doc_id: r.lang for r in docs.collect()}
    g = [r for r in langid.identify(docs).collect() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in g]) > 0.97


def test_prior_estimate():
    rng = np.random.default_rng(1)
    p = rng.normal(1.5, 1, (1500, 3))
    u = np.concatenate([rng.normal(1.5, 1, (2100, 3)), rng.normal(-1.5, 1, (900, 3))])
    assert abs(quality.estimate_prior(np.concatenate([p, u]), np.arange(4500) < 1500) - 0.7) < 0.1
