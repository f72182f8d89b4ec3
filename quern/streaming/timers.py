"""The sync scheduler as a stateful operator with timers.

Rows are what happens to the sources of a project: a source is registered (or its interval changes), a probe reports its token,
a webhook asks for it, a run has synced it. Each source is due an interval after it was last due; a timer of its project wakes
the operator, which first advances the due time, then decides: a webhook's claim runs at once, a source not synced within its
longest age runs whatever the probe says, an equal token is skipped, anything else runs. A project runs once a tick, for all
of its sources. Times are event times: a replay decides what it decided at first.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: kind: register (interval, max_age), probe (token; null: it failed), webhook, synced (token), forget.
INPUT = "project string, source string, at timestamp, kind string, interval double, max_age double, token string"
OUTPUT = "project string, source string, at double, decision string, runs boolean"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_KEY = "source string"
_SOURCE = "interval double, max_age double, due double, token string, probed string, synced double"
_DECISION = ["project", "source", "at", "decision", "runs"]
DAY = 24 * 3600.0
#: Values of a list that one request writes, and rows of a frame that is handed on.
STATE_ROWS, OUTPUT_ROWS = 10_000, 100_000


class Scheduler(StatefulProcessor):
    """State of a project: its sources by name, and the claims of webhooks, which are void after claim_ttl seconds (the engine's own
    expiry knows processing time only, which no replay repeats).

    State is read and written once a call: a batch's rows and the ticks up to the watermark are worked off in memory, and a project
    has one timer, for the earliest of what it waits for."""

    def __init__(self, claim_ttl: float = DAY):
        self.claim_ttl = claim_ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sources = handle.getMapState("sources", _KEY, _SOURCE)
        self.claims = handle.getListState("claims", "source string, at double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sources, touched, claims, wake = {}, set(), [], float("inf")
        for name, at, kind, interval, max_age, token in _in_order(rows):
            if name not in sources:
                sources[name] = self.sources.getValue((name,)) if self.sources.containsKey((name,)) else None
            old = sources[name]
            if kind == "register":
                if not interval > 0:
                    continue  # never due
                due = at if old is None else min(old[2], at + interval)
                sources[name] = (interval, None if max_age != max_age else max_age, due, *(old[3:] if old else (None, None, None)))
                wake = min(wake, due)
            elif old is None:
                continue
            elif kind == "forget":
                sources[name] = None
            elif kind == "probe":
                sources[name] = (*old[:4], token, old[5])
            elif kind == "synced":
                sources[name] = (*old[:3], token, old[4], at)
            elif kind == "webhook":
                claims.append((name, at))
                wake = min(wake, at)
            touched.add(name)
        for name in sorted(touched):
            if sources[name] is not None:
                self.sources.updateValue((name,), sources[name])
            elif self.sources.containsKey((name,)):
                self.sources.removeKey((name,))
        for lo in range(0, len(claims), STATE_ROWS):
            self.claims.appendList(claims[lo : lo + STATE_ROWS])
        if wake < float("inf"):
            self._wake(wake, timerValues)
        yield pd.DataFrame(columns=_DECISION)

    def _wake(self, at: float, timerValues) -> None:
        """A timer at `at`, or as soon as the watermark moves if it is past that."""
        self.handle.registerTimer(max(int(at * 1000), timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The tick the timer stands for, and those that follow up to the watermark: it may have moved by many intervals."""
        now, mark = expiredTimerInfo.getExpiryTimeInMs() / 1000, timerValues.getCurrentWatermarkInMs() / 1000
        sources = {n[0]: tuple(s) for n, s in self.sources.iterator()}
        claims = deque(sorted((c[1], c[0]) for c in self.claims.get()))
        due = [(s[2], name) for name, s in sources.items()]  # one entry a source: a tick that takes it puts in the next
        heapify(due)
        held, touched, out = len(claims), set(), []
        while True:
            out += self._tick(key[0], now, sources, due, claims, touched)
            if len(out) >= OUTPUT_ROWS:
                yield pd.DataFrame(out, columns=_DECISION)
                out = []
            if not due and not claims:
                break
            now = min(due[0][0] if due else float("inf"), claims[0][0] if claims else float("inf"))
            if now > mark:
                self._wake(now, timerValues)
                break
        for name in sorted(touched):
            self.sources.updateValue((name,), sources[name])
        if len(claims) < held:
            self.claims.clear()
            later = [(name, at) for at, name in claims]
            for lo in range(0, len(later), STATE_ROWS):
                self.claims.appendList(later[lo : lo + STATE_ROWS])
        yield pd.DataFrame(out, columns=_DECISION)

    def _tick(self, project: str, now: float, sources: dict, due: list, claims: deque, touched: set) -> list[tuple]:
        """Decisions at `now`, of the sources that are due or claimed. sources: by name; due: a heap of (due, name); claims: (at, name) in
        order. All are brought up to date, and touched gets the names of the sources that changed."""
        claimed, ready = set(), {}
        while claims and claims[0][0] <= now:
            at, name = claims.popleft()
            if now - self.claim_ttl < at:
                claimed.add(name)
        while due and due[0][0] <= now:
            at, name = heappop(due)
            ready[name] = at
        # a claimed source that is not due keeps its place among the due ones
        ready |= {name: sources[name][2] for name in claimed if name in sources and name not in ready}
        out, running = [], False
        for was, name in sorted((at, name) for name, at in ready.items()):
            interval, max_age, at, token, probed, synced = sources[name]
            if was <= now:  # first of all, so that nothing that follows can leave it due; missed intervals are not made up for
                at += interval * (int((now - at) // interval) + 1)
                sources[name] = (interval, max_age, at, token, probed, synced)
                touched.add(name)
                heappush(due, (at, name))
            if name in claimed:
                decision = "webhook"
            elif max_age is not None and (synced is None or now - synced > max_age):
                decision = "stale"
            elif token is not None and token == probed:
                decision = "unchanged"
            else:
                decision = "scheduled"
            runs = decision != "unchanged" and not running
            running = running or runs
            out.append((project, name, now, decision, runs))
        return out

    def close(self) -> None:
        pass


def _in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(source, at, kind, interval, max_age, token) of a project's rows by at, source and kind; rows that agree in these stay as they came.

    All rows of a project in a batch are held while they are put in order, as numbers of 36 bytes a row."""
    names, parts = {}, []

    def coded(column: pd.Series) -> np.ndarray:
        codes, found = pd.factorize(column)
        return np.array([*(names.setdefault(x, len(names)) for x in found), -1], np.int32)[codes]

    for f in rows:
        at = f["at"].to_numpy().astype("datetime64[us]").astype(np.int64)
        parts.append((coded(f["source"]), at, coded(f["kind"]), f["interval"].to_numpy(np.float64, na_value=np.nan), f["max_age"].to_numpy(np.float64, na_value=np.nan), coded(f["token"])))
    source, at, kind, interval, max_age, token = (np.concatenate(c) for c in zip(*parts))
    parts.clear()
    words = [*names, None]
    place = np.zeros(len(words), np.int32)
    place[sorted(range(len(names)), key=words.__getitem__)] = np.arange(len(names), dtype=np.int32)
    order = np.lexsort((place[kind], place[source], at))
    for lo in range(0, len(order), OUTPUT_ROWS):
        i = order[lo : lo + OUTPUT_ROWS]
        # microseconds to seconds by one division, which gives the nearest double
        for s, t, k, every, age, x in zip(source[i].tolist(), at[i].tolist(), kind[i].tolist(), interval[i].tolist(), max_age[i].tolist(), token[i].tolist()):
            yield words[s], t / 1e6, words[k], every, age, words[x]


def schedule(events: DataFrame, late: str = "0 seconds", claim_ttl: float = DAY) -> DataFrame:
    """Decisions (OUTPUT) of a stream of INPUT rows. runs: whether this row starts its project's run of that tick. The session must
    keep state in STATE_STORE (spark.sql.streaming.stateStore.providerClass). Rows behind the watermark are dropped by the
    engine; rows of a source that was never registered do nothing. A webhook's claim that nothing took expires."""
    return (
        events.withWatermark("at", late)
        .groupBy("project")
        .transformWithStateInPandas(statefulProcessor=Scheduler(claim_ttl), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    )
