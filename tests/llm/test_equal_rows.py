"""Rows that share a key and a text: sharding and mixing still split them; sharding against a plain version."""

import hashlib
import zlib

import pytest

from quern.llm import mixing, sharding


def h60(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_shards_match_a_plain_interleaving(spark):
    rows = [(i, f"text {i % 90}" if i % 13 else None, f"s{i % 3}" if i % 7 else None) for i in range(500)]
    got = {r.doc_id: r for r in sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), 8).collect()}
    by: dict = {}
    for i, t, s in rows:
        src = "n" if s is None else "s" + s
        crc = zlib.crc32((t or "").encode())
        by.setdefault(src, []).append((h60(f"17:{i}:{crc}"), i, crc))
    order = []
    for src, members in by.items():
        for rank, (h, i, crc) in enumerate(sorted(members)):
            order.append(((rank + h60(f"17:{src}") / float(1 << 60)) / len(members), src, h, i))
    order.sort()
    n, first = len(order), {}
    for p, (_, _, _, i) in enumerate(order):
        shard = p * 8 // n
        slot = p - first.setdefault(shard, p)
        r = got[i]
        assert (r.shard, r.slot) == (shard, slot)
        t = rows[i][1]
        assert r.size == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode()) and r.law == "rows" and r.grown_shard is None


@pytest.mark.parametrize("key", [None, 7])
def test_a_key_with_a_third_of_the_rows_is_split(spark, key):
    rows = [(key if i % 3 == 0 else i, "equal" if i % 3 == 0 else f"words of {i}", "a" if i % 2 else "b") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = sharding.shard_documents(docs, 10).collect()
    assert len(got) == 3000
    for s in range(10):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(300))
        assert abs(sum(r.doc_id == key for r in got if r.shard == s) - 100) < 40  # dealt, not heaped
    if key is not None:
        return
    mix = mixing.mix_documents(docs).collect()
    taken = {}
    for r in mix:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for r in mix:
        assert abs(taken[r.source] - r.target) <= 0.01 * r.target
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    count = lambda rows: sorted((str(r.doc_id), r.source) for r in rows)
    assert count(out.collect()) == count([r for r in mix for _ in range(r.copies)])
