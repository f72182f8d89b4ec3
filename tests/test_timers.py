"""The scheduler against a plain one, with a restart between any two feeds."""

import datetime as dt
import random

import pandas as pd
import pytest

from quern.streaming import timers

START = 1_000_000  # rows at the very start of time are behind any watermark
FEEDS = [
    [("p", "a", 0, "register", 100.0, 250.0, None), ("p", "b", 0, "register", 60.0, None, None), ("q", "c", 5, "register", 50.0, 1000.0, None)],
    [("p", "a", 20, "synced", None, None, "v1"), ("p", "b", 20, "synced", None, None, "w1"), ("p", "a", 30, "probe", None, None, "v1"), ("p", "b", 30, "probe", None, None, "w1"), ("q", "c", 30, "synced", None, None, "x")],
    [("p", "b", 70, "webhook", None, None, None), ("q", "c", 90, "probe", None, None, None), ("z", "n", 95, "webhook", None, None, None)],
    [("p", "b", 150, "probe", None, None, "w2"), ("q", "c", 160, "probe", None, None, "x")],
    [("p", "a", 420, "probe", None, None, "v1"), ("q", "c", 430, "forget", None, None, None)],
    [("q", "d", 900, "register", 10_000.0, None, None)],
]


def plain(feeds):
    """After a feed come all ticks up to the latest time seen, in order; a project ticks when a source of it is due or claimed."""
    state, claims, out, mark = {}, [], [], 0
    for feed in feeds:
        for p, s, at, kind, interval, max_age, token in sorted(feed, key=lambda r: (r[2], r[1], r[3])):
            x = state.get((p, s))
            if kind == "register":
                state[p, s] = {"i": interval, "m": max_age, "due": at, "t": None, "p": None, "y": None}
            elif x is None:
                continue
            elif kind == "probe":
                x["p"] = token
            elif kind == "synced":
                x["t"], x["y"] = token, at
            elif kind == "webhook":
                claims.append((p, s, at))
            elif kind == "forget":
                del state[p, s]
        mark = max([mark, *(r[2] for r in feed)])
        while ready := [(x["due"], p) for (p, _), x in state.items() if x["due"] <= mark] + [(at, p) for p, _, at in claims if at <= mark]:
            now, project = min(ready)
            taken = {s for p, s, at in claims if p == project and at <= now}
            claims = [c for c in claims if c[0] != project or c[2] > now]
            running = False
            for due, s in sorted((x["due"], s) for (p, s), x in state.items() if p == project and (x["due"] <= now or s in taken)):
                x = state[project, s]
                while x["due"] <= now:
                    x["due"] += x["i"]
                stale = x["m"] is not None and (x["y"] is None or now - x["y"] > x["m"])
                d = "webhook" if s in taken else "stale" if stale else "unchanged" if x["t"] is not None and x["t"] == x["p"] else "scheduled"
                out.append((project, s, now, d, d != "unchanged" and not running))
                running = running or d != "unchanged"
    return sorted(out)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, timers.STATE_STORE)
    yield spark
    spark.conf.set(key, old)


def test_decisions_across_restarts(rocks, tmp_path):
    spark, base = rocks, tmp_path
    (base / "in").mkdir()
    schema = spark.createDataFrame([], timers.INPUT).schema
    for n, feed in enumerate(FEEDS):
        rows = [(p, s, dt.datetime.fromtimestamp(at + START, dt.timezone.utc), *rest) for p, s, at, *rest in feed]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(base / "in" / str(n)))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(base / "in"))
        q = timers.schedule(stream).writeStream.format("parquet").option("path", str(base / "out")).option("checkpointLocation", str(base / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.project, r.source, round(r["at"]) - START, r.decision, r.runs) for r in spark.read.parquet(str(base / "out")).collect())
    kinds = {g[3] for g in got}
    assert kinds == {"webhook", "stale", "unchanged", "scheduled"}
    assert got == plain(FEEDS)


class Held:
    """State of one project in memory, as the engine's handle gives it: counts requests and keeps the timers asked for."""

    def __init__(self):
        self.map, self.list, self.timers, self.requests = {}, [], set(), 0

    def getMapState(self, *_):
        return self

    def getListState(self, *_):
        return self

    def _asked(self, found=None):
        self.requests += 1
        return found

    registerTimer = lambda self, at: self._asked(self.timers.add(at))
    containsKey = lambda self, k: self._asked(k in self.map)
    getValue = lambda self, k: self._asked(self.map.get(k))
    updateValue = lambda self, k, v: self._asked(self.map.__setitem__(k, tuple(v)))
    removeKey = lambda self, k: self._asked(self.map.pop(k))
    iterator = lambda self: self._asked(iter(list(self.map.items())))
    get = lambda self: self._asked(iter(list(self.list)))
    clear = lambda self: self._asked(self.list.clear())
    appendValue = lambda self, v: self._asked(self.list.append(tuple(v)))
    appendList = lambda self, vs: self._asked(self.list.extend(vs))


class Now:
    def __init__(self, mark):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: mark


def test_requests_to_state_do_not_grow_with_rows():
    """Many rows of a project in few batches: ticks are those of the plain scheduler, a timer a batch is asked for, and state is asked
    a number of times that the sources bound."""
    rng, feeds, known = random.Random(7), [], set()
    for n in range(4):
        rows, at = [], 2000 * n
        while at < 2000 * n + 1900:
            at += rng.randrange(1, 5)
            source = rng.choice("abcd")
            kind = rng.choice(["webhook", "webhook", "probe", "synced", "forget" if rng.random() < 0.05 else "probe"]) if source in known else "register"
            if kind == "synced" and source == "c":
                kind = "probe"  # c is never synced, and so stale
            known = known | {source} if kind == "register" else known - {source} if kind == "forget" else known
            more = (rng.choice([40.0, 150.0]), 20.0 if source == "c" else None, None) if kind == "register" else (None, None, rng.choice(["v1", "v2", None]))
            rows.append(("p", source, at + rng.randrange(1000) / 1000, kind, *more))
        feeds.append(rows)
    held, mark, got = Held(), 0, []
    job = timers.Scheduler()
    job.init(held)
    for feed in feeds:
        before = held.requests, len(held.timers)
        frame = pd.DataFrame([(p, s, dt.datetime.fromtimestamp(at, dt.timezone.utc).replace(tzinfo=None), *rest) for p, s, at, *rest in feed], columns=["project", "source", "at", "kind", "interval", "max_age", "token"])
        parts = [frame.iloc[1::2], frame.iloc[::2]]  # a group may come in several parts, in no order
        for out in job.handleInputRows(("p",), iter(parts), Now(mark)):
            assert not len(out)
        assert len(held.timers) - before[1] <= 1
        mark = round(max(r[2] for r in feed) * 1000)
        while fired := [t for t in held.timers if t <= mark]:
            held.timers.remove(min(fired))
            expired, now = Now(min(fired)), Now(mark)
            for out in job.handleExpiredTimer(("p",), now, expired):
                got += out.itertuples(index=False, name=None)
        assert held.requests - before[0] < 40
    want = plain(feeds)
    assert len(got) > 800 and {g[3] for g in got} == {"webhook", "stale", "unchanged", "scheduled"}
    assert sorted((p, s, round(at, 6), d, r) for p, s, at, d, r in got) == [(p, s, round(at, 6), d, r) for p, s, at, d, r in want]
