"""All runs (maximal periodic stretches of words) of every document, by the longest-previous-factor array.

Words of a document become numbers by exact comparison. What can hold no run is left out first: in a run of MIN_LENGTH
words and two periods all pairs of neighbouring words but at most one in the middle occur again, so the stretches in which
no two successive pairs occur only once are all that is searched (together, with a number of its own between any two).

On those, prefix doubling gives the order of the suffixes and, level by level, ranks that compare any two stretches in
logarithmic time. The suffix array and its common prefixes give the longest previous factor of each place, and those the
Lempel-Ziv blocks. A run that meets a block boundary is found there by Main's extensions: for each period that the two
blocks at the boundary allow, how far the text agrees with itself shifted, to the right and to the left. A run inside a
block is the copy of an earlier one: runs are kept in buckets by start, and a block copies the buckets of the place it
repeats. Every document stands for itself: nothing is shuffled, and memory is that of one document's words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 12
#: Extensions are computed for so many (boundary, period) pairs at once.
PAIRS = 1 << 20

SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


class Ranks:
    """Ranks of the stretches of 2**k numbers at every place, for k = 0, 1, ...; the last level orders all suffixes."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.n = n
        rank = np.unique(x, return_inverse=True)[1].astype(np.int64) + 1
        self.levels, width = [rank], 1
        while width < n and rank.max() < n:
            nxt = np.zeros(n, np.int64)
            nxt[: n - width] = rank[width:]
            key = rank * (n + 1) + nxt
            order = np.argsort(key, kind="stable")
            step = np.ones(n, np.int64)
            step[1:] = key[order[1:]] != key[order[:-1]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            self.levels.append(rank)
            width *= 2
        self.rank = rank

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i on equal those from j on; places at the end or beyond agree in none."""
        i, j = i.copy(), j.copy()
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            # a stretch that the end cuts off has a rank of its own length, so equal ranks are equal whole stretches
            level, width = self.levels[k], 1 << k
            fit = np.maximum(i, j) + width <= self.n
            same = fit & (level[np.where(fit, i, 0)] == level[np.where(fit, j, 0)])
            i[same] += width
            j[same] += width
            out[same] += width
        return out


def previous_factors(ranks: Ranks) -> tuple[list[int], list[int]]:
    """The longest previous factor of each place and where it stands before: suffixes leave a linked list of the suffix array
    from the last to the first place, and the longer common prefix with a neighbour that is left is the factor."""
    n = ranks.n
    order = np.argsort(ranks.rank, kind="stable")
    common = ranks.ahead(order[1:], order[:-1])
    prev = np.full(n, -1, np.int64)
    prev[order[1:]] = order[:-1]
    nxt = np.full(n, -1, np.int64)
    nxt[order[:-1]] = order[1:]
    up = np.zeros(n, np.int64)  # with the suffix before
    up[order[1:]] = common
    prev, nxt, up = prev.tolist(), nxt.tolist(), up.tolist()
    factor, where = [0] * n, [-1] * n
    for i in range(n - 1, -1, -1):
        a, b = prev[i], nxt[i]
        before, after = up[i], up[b] if b >= 0 else 0
        if before >= after:
            factor[i], where[i] = before, a
        else:
            factor[i], where[i] = after, b
        if b >= 0:
            prev[b] = a
            up[b] = before if before < after else after
        if a >= 0:
            nxt[a] = b
    return factor, where


def blocks(factor: list[int]) -> list[int]:
    """Where the Lempel-Ziv blocks begin; the end is the last."""
    out, i = [], 0
    while i < len(factor):
        out.append(i)
        i += max(1, factor[i])
    return [*out, len(factor)]


def all_runs(x: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of min_length and two periods at least, by start, then period."""
    n = len(x)
    if n < max(2, min_length):
        return []
    ranks = Ranks(x)
    factor, where = previous_factors(ranks)
    cuts = blocks(factor)
    back = Ranks(x[::-1])
    found: dict[tuple[int, int], int] = {}
    # at each boundary, the end included: periods below the length of the two blocks that meet there
    edge = np.array(cuts[1:], np.int64)
    size = np.diff(np.array([0, *cuts[1:], n], np.int64))
    most = size[:-1] + size[1:]
    at = 0
    while at < len(edge):
        upto = max(at + 1, int(np.searchsorted(np.cumsum(most[at:]), PAIRS, "right")) + at)
        count = most[at:upto]
        b = np.repeat(edge[at:upto], count)
        q = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + 1
        at = upto
        for lo in (b, b - q):  # the first of the two places compared: the period stands behind the boundary, or before it
            ok = (lo >= 0) & (lo + q <= n)
            i, p = lo[ok], q[ok]
            right = ranks.ahead(i, i + p)
            left = back.ahead(n - i, n - i - p)
            good = (left + right >= p) & (left + right + p >= min_length)
            for s, e, d in zip((i - left)[good].tolist(), (i + p + right)[good].tolist(), p[good].tolist()):
                if found.get((s, e), d) >= d:
                    found[s, e] = d
    buckets: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for (s, e), p in found.items():
        buckets[s].append((e, p))
    for b, e in zip(cuts, cuts[1:]):
        if e - b < min_length + 2 or factor[b] < e - b:
            continue
        j = where[b]
        for s in range(j + 1, j + (e - b) - min_length):
            for f, p in buckets.get(s, ()):
                if f < j + (e - b) and (s + b - j, f + b - j) not in found:
                    found[s + b - j, f + b - j] = p
                    buckets[s + b - j].append((f + b - j, p))
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def candidates(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int]]:
    """Stretches (start, end) outside which no run of min_length (3 or more) lies: no two successive pairs of neighbours
    occur once only."""
    if len(ids) < min_length:
        return []
    pair = ids[:-1].astype(np.int64) * (int(ids.max()) + 1) + ids[1:]
    again = np.zeros(len(pair), bool)
    order = np.argsort(pair, kind="stable")
    same = pair[order[1:]] == pair[order[:-1]]
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    again[1:-1] |= again[:-2] & again[2:]  # one alone may stand in the middle of a run
    edges = np.flatnonzero(np.diff(np.concatenate(([0], again.view(np.int8), [0]))))
    return [(int(a), int(b) + 1) for a, b in zip(edges[::2], edges[1::2]) if b + 1 - a >= min_length]


def runs_of(ids: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of numbers from 0."""
    parts = candidates(ids, min_length)
    if not parts:
        return []
    low = int(ids.max()) + 1
    pieces, starts, size = [], [], 0
    for k, (a, b) in enumerate(parts):
        pieces += [ids[a:b], np.array([low + k])]
        starts.append(size)
        size += b - a + 1
    out = []
    starts_at = np.array(starts)
    for s, e, p in all_runs(np.concatenate(pieces), min_length):
        k = int(np.searchsorted(starts_at, s, "right")) - 1
        out.append((s - starts[k] + parts[k][0], e - s, p))
    return out


def replayed(n: int, doc_id: int | None) -> tuple[int, int] | None:
    """(a, p) for a document whose words from a on repeat with period p, as its id decides; None for the others."""
    if n == 0 or doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def report(doc_id: int | None, text: str | None, min_length: int = MIN_LENGTH, looped: bool = True) -> tuple:
    """A row of SCHEMA."""
    # bytes.split() without arguments splits at just the six bytes that the word rule excludes
    words = (text or "").encode("utf-8", "surrogatepass").split()
    n = len(words)
    loop = replayed(n, doc_id) if looped else None
    if loop:
        a, p = loop
        tail = words[a : a + p]
        words = words[:a] + (tail * (-(-(n - a) // len(tail))))[: n - a]
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    runs = runs_of(ids, min_length)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    if runs:
        change = np.zeros(n + 1, np.int64)
        r = np.array(runs, np.int64)
        np.add.at(change, r[:, 0] + r[:, 2], 1)
        np.add.at(change, r[:, 0] + r[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
    listed = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *first, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, looped: bool = True) -> DataFrame:
    """A row of SCHEMA for each row of docs: n_runs; start, length, period and exponent_milli of the longest run (ties: smallest
    start, then period; null without a run); runs_sha256 over all runs; collapsed_sha256 over the words that no run repeats.

    looped: the words of one document in ten, chosen by its id, first repeat themselves from some word on. Null and empty
    texts have no words and no runs. A null doc_id chooses nothing. Repeated rows give repeated rows. Empty table: no rows.
    """
    types = SCHEMA.replace(",", "").split()[1::2]

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                rows = [report(i.as_py(), t.as_py(), min_length, looped) for i, t in zip(part.column(0), part.column(1))]
                cols = [pa.array([r[k] for r in rows], pa.int64() if kind == "long" else pa.string()) for k, kind in enumerate(types)]
                yield pa.RecordBatch.from_arrays(cols, names=SCHEMA.replace(",", "").split()[::2])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
