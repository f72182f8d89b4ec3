"""The trie against a plain one, and the SQL of the three newest operators against what they return."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from quern.llm import prefixtrie, queries

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def plain(rows):
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), r or "", x or ""))
    turns = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) // 20 * 20 * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
    members, kids = defaultdict(list), defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[k] for k in kids[p])
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), leaves[p], saved[p], sha([c for c in m if len(whole[c]) == len(p)])) for p, m in members.items()), key=repr)


def check(spark, rows, parts=3):
    turns = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(parts)
    assert sorted((tuple(r) for r in prefixtrie.trie(turns).collect()), key=repr) == plain(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_plain_trie(spark, seed, monkeypatch):
    monkeypatch.setattr(prefixtrie, "SPAN", 3)
    monkeypatch.setattr(prefixtrie, "PIECE_IDS", 2)
    rng = random.Random(seed)
    rows = [(rng.choice([None, -45, -3, *range(45)]), rng.choice([None, *range(7)]), rng.choice(["u", "a", None]), rng.choice(["", "x y", "x  z q", None])) for _ in range(250)]
    check(spark, rows + rows[:40])


def test_a_conversation_with_most_turns_and_a_common_one(spark):
    rows = [(40, t, "u", f"turn {t % 3}") for t in range(3000)] + [(61, t, "u", f"turn {t % 3}") for t in range(2999)]
    rows += [(c, t, "u", f"hello {t}") for c in range(200, 420) for t in range(3)]
    check(spark, rows, 5)


def test_few_and_none(spark):
    check(spark, [(7, 0, "u", "x")])
    turnless = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    check(spark, [(turnless, 0, "u", "x"), (turnless, 1, "u", None)])
    check(spark, [])
    check(spark, [(None, 1, "u", "x")])


def test_dense_names_have_no_gaps(spark):
    rows = spark.range(1000).selectExpr("id % 77 as k").repartition(5)
    assert sorted(r.name for r in prefixtrie.dense(rows, ["k"]).collect()) == list(range(77))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_gives_the_same_rows(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "conversations"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cur = c.execute(queries.oracle_sql()[name])
    names = sorted(d[0] for d in cur.description)
    want = [tuple(dict(zip([d[0] for d in cur.description], r))[n] for n in names) for r in cur.fetchall()]
    df = queries.queries()[name](spark, sf)
    assert sorted(df.columns) == names
    assert sorted((tuple(r) for r in df.select(names).collect()), key=repr) == sorted(want, key=repr)
