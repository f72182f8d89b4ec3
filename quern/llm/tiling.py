"""Benchmark decontamination by greedy string tiling.

Test items are tokenised into words and indexed by the Karp-Rabin hashes of their word n-grams (seeds). A document
and an item that share a seed are a candidate pair; greedy string tiling then repeatedly takes the longest common
run of words in which nothing is marked yet, marks it on both sides, and stops when no run of MIN_MATCH words is
left. Tiles may come in any order, so reordered passages count in full. A document is contaminated by an item
when its tiles cover at least COVERAGE of the item's words. Seeds decide only which pairs are looked at: each counts once
for a document, wherever and however often it stands there.

The index is broadcast only within a bound: items are taken in blocks of at most MAX_WORDS words, and each block
passes over the documents once, so a benchmark of any size is handled whole. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textkernel as tk

MIN_MATCH = 5
COVERAGE = 0.5
MAX_WORDS = 1 << 21
_MAP_BITS = 20


def _windows(p: np.ndarray, marks: np.ndarray, inverse: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Running Karp-Rabin hashes of all stretches of `size` words, from prefix sums, and which of them have no mark."""
    return (p[size:] - p[:-size]) * inverse[: len(p) - size], marks[size:] == marks[:-size]


def tile(doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, length >= k) of greedy string tiling.

    The longest common run of unmarked words is found by halving: runs of a length exist if hashes of that length, taken at
    every unmarked place of both, meet. All runs of that length are marked, the earliest in the document first, then in the
    item; then the next length is sought. Places are never paired with each other, so a word or phrase that repeats costs
    no more than any other: memory is that of the two texts.
    """
    found = []
    grams_d, grams_i = _hashes(doc, k), _hashes(item, k)
    if not len(grams_d) or not len(grams_i):
        return found
    # only what shares a seed with the item takes part, with one marked word between stretches that lie apart
    part = np.zeros(len(doc) + 1, np.int64)
    np.add.at(part, np.flatnonzero(np.isin(grams_d, grams_i)), 1)
    covered = np.cumsum(part)[: len(doc)]
    covered[k:] -= np.cumsum(part)[: len(doc) - k]
    covered = covered > 0
    own = np.flatnonzero(covered | np.concatenate(([False], covered[:-1])))
    if not len(own):
        return found
    words_d, marked_d, marked_i = doc[own], ~covered[own], np.zeros(len(item), bool)
    power, inverse = tk._powers(max(len(own), len(item)) + 1)
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x.astype(np.uint64) * power[: len(x)]))) for x in (words_d, item)]

    def common(size: int):
        marks = [np.concatenate(([0], np.cumsum(m))) for m in (marked_d, marked_i)]
        (hd, free_d), (hi, free_i) = (_windows(p, m, inverse, size) for p, m in zip(sums, marks))
        at_i = np.flatnonzero(free_i)
        at_d = np.flatnonzero(free_d)
        return at_d[np.isin(hd[at_d], hi[at_i])], hd, at_i, hi

    longest = min(len(own), len(item))
    while longest >= k:
        lo, hi = k - 1, longest  # runs of length lo exist, or none of k words
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if len(common(mid)[0]):
                lo = mid
            else:
                hi = mid - 1
        if lo < k:
            break
        size = lo
        at_d, hash_d, at_i, hash_i = common(size)
        places: dict[int, list[int]] = defaultdict(list)
        for j in at_i[::-1].tolist():
            places[int(hash_i[j])].append(j)  # the earliest last
        after = 0
        for i in at_d.tolist():
            if i < after:
                continue
            rest = places[int(hash_d[i])]
            while rest and marked_i[rest[-1] : rest[-1] + size].any():
                rest.pop()
            if rest:
                j = rest.pop()
                marked_d[i : i + size] = True
                marked_i[j : j + size] = True
                found.append((int(own[i]), j, size))
                after = i + size
        longest = size - 1
    return found


def _hashes(h: np.ndarray, k: int) -> np.ndarray:
    return tk.grams(h.astype(np.uint64), np.array([0, len(h)]), k)[0]


class Index:
    """The seeds of a block of items: pairs (hash, item) in order of hash, each with the number of its places in the item, and a
    bit map in front."""

    def __init__(self, ids: list[int], texts: list[str], k: int):
        self.k, self.ids, self.items = k, ids, []
        hashes, owners = [], []
        for n, t in enumerate(texts):
            h, _ = words(pa.array([t or ""], pa.large_string()))
            self.items.append(h)
            if len(h):
                g = _hashes(h, min(k, len(h)))
                hashes.append(g)
                owners.append(np.full(len(g), n, np.int64))
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.lexsort((owner, every))
        every, owner = every[order], owner[order]
        first = np.ones(len(every), bool)
        first[1:] = (every[1:] != every[:-1]) | (owner[1:] != owner[:-1])
        at = np.flatnonzero(first)
        self.hashes, self.owner, self.places = every[at], owner[at], np.diff(np.append(at, len(every)))
        self.sizes = np.array([len(x) for x in self.items], np.int64)
        self.map = np.zeros(1 << _MAP_BITS, bool)
        self.map[(self.hashes >> np.uint64(64 - _MAP_BITS)).astype(np.int64)] = True

    def find(self, g: np.ndarray) -> np.ndarray:
        """Indices into g of the hashes that are seeds."""
        maybe = np.flatnonzero(self.map[(g >> np.uint64(64 - _MAP_BITS)).astype(np.int64)])
        if len(maybe) == 0 or len(self.hashes) == 0:
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.hashes, g[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[at] == g[maybe]]


def words(texts: pa.Array):
    """Hashes of the words (letters and digits, lower-cased) of all texts and the word offsets of each text."""
    hashes, counts = [], [0]
    for _, _, data, off in tk.pieces(texts):
        low = tk.LOWER[data]
        s, e, wo = tk.spans(low, off, tk.ALNUM)
        hashes.append(tk.word_hashes(low, s, e))
        counts += (wo[1:] + counts[-1]).tolist()
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), np.array(counts)


def matches(index: Index, texts: pa.Array, coverage: float):
    """(row, item position, tiled words of the item, words of the item, tiles) for each contaminated pair."""
    k = index.k
    sizes = sorted({min(k, len(h)) for h in index.items if len(h)})
    for i0, _, data, off in tk.pieces(texts):
        low = tk.LOWER[data]
        s, e, wo = tk.spans(low, off, tk.ALNUM)
        h = tk.word_hashes(low, s, e)
        pairs = []
        for size in sizes:
            g, at = tk.grams(h, wo, size)
            hit = index.find(g)
            if len(hit) == 0:
                continue
            # each seed of a text once: (row, seed), then a row for each item that holds the seed
            rows = tk.owner(wo, at[hit])
            order = np.lexsort((g[hit], rows))
            rows, seeds = rows[order], g[hit][order]
            once = np.ones(len(rows), bool)
            once[1:] = (rows[1:] != rows[:-1]) | (seeds[1:] != seeds[:-1])
            rows, seeds = rows[once], seeds[once]
            lo = np.searchsorted(index.hashes, seeds, "left")
            many = np.searchsorted(index.hashes, seeds, "right") - lo
            x = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum()))
            owner, rows = index.owner[x], np.repeat(rows, many)
            fit = np.minimum(k, index.sizes[owner]) == size
            both, which = np.unique(np.stack((rows[fit], owner[fit])), axis=1, return_inverse=True)
            # tiles cannot cover more of the item than its seeds touch
            touched = size * np.bincount(which.reshape(-1), index.places[x][fit], both.shape[1])
            pairs += [(r, n, size) for (r, n), t in zip(both.T.tolist(), touched.tolist()) if t >= coverage * index.sizes[n]]
        for row, n, size in sorted(pairs):
            item = index.items[n]
            tiles = tile(h[int(wo[row]) : int(wo[row + 1])], item, size)
            tiled = sum(t[2] for t in tiles)
            if tiled >= coverage * len(item):
                yield i0 + row, n, tiled, len(item), len(tiles)


def contaminated(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, max_words: int = MAX_WORDS) -> DataFrame:
    """doc_id, item_id, tiled_words, item_words, coverage, tiles: one row for each document row and test item whose tiles
    cover at least `coverage` of the item.

    Items shorter than min_match words match as a whole only. Null or empty texts and items without words match
    nothing. Repeated documents give repeated rows; a null doc_id is carried as null. Nothing found: no rows.
    """
    schema = "doc_id long, item_id long, tiled_words int, item_words int, coverage double, tiles int"
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    found = None
    for index in blocks(items, min_match, max_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                ids, ix = b.column(0), shared.value
                rows = list(matches(ix, b.column(1), coverage))
                if rows:
                    r, n, t, w, c = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(r)), pa.array([ix.ids[x] for x in n], pa.int64()), pa.array(t, pa.int32()), pa.array(w, pa.int32()), pa.array([x / y for x, y in zip(t, w)], pa.float64()), pa.array(c, pa.int32())],
                        names=["doc_id", "item_id", "tiled_words", "item_words", "coverage", "tiles"],
                    )

        part = narrow.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], schema)


def blocks(items: DataFrame, k: int, max_words: int):
    """Indexes of consecutive blocks of items; only one block's texts are held at a time."""
    ids: list[int] = []
    texts: list[str] = []
    size = 0
    rows = items.filter("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    for r in rows.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1]) // 2 + 1
        if size >= max_words:
            yield Index(ids, texts, k)
            ids, texts, size = [], [], 0
    if ids:
        yield Index(ids, texts, k)


def drop_contaminated(docs: DataFrame, items: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, max_words: int = MAX_WORDS) -> DataFrame:
    """The rows of docs, all columns, that no item contaminates. Rows are judged where they stand: nothing is shuffled.
    Null and empty texts stay."""
    out, where = docs, docs.columns.index("text")
    for index in blocks(items, min_match, max_words):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for found in matches(shared.value, b.column(where), coverage):
                    keep[found[0]] = False
                yield b if keep.all() else b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
