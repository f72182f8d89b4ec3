"""Vectorised tokenising and hashing of Arrow string batches.

Texts of a batch lie end to end in one byte buffer; words are found by a byte class, and a word's hash is a
Karp-Rabin polynomial taken from prefix sums modulo 2**64, so no Python code runs per word. Batches are cut
into pieces of about PIECE bytes (one text is never split), which bounds the temporaries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
_R = 0x9E3779B97F4A7C15 | 1
_RINV = pow(_R, -1, 1 << 64)
_POW = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, PIECE + 4096)
        for k, r in enumerate((_R, _RINV)):
            p = np.full(size, r, np.uint64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def pieces(texts: pa.Array, size: int = PIECE):
    """(first row, last row + 1, bytes, offsets) of consecutive pieces; null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        j = min(j, n)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser over uint64 (xor-shift and multiply), so that all bits depend on all bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def spans(data: np.ndarray, off: np.ndarray, cls: np.ndarray):
    """Starts, ends and per-text word offsets of the runs of bytes in cls."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = cls[data]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    inner = off[(off > 0) & (off < len(data))]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """uint64 hash of each word's bytes."""
    n = len(data)
    p, q = _powers(n + 1)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=c[1:])
    return mix((c[e] - c[s]) * q[s])


def grams(h: np.ndarray, wo: np.ndarray, n: int):
    """Rolling hashes of n consecutive words and the word index where each starts; none crosses a text."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = np.zeros(m, np.uint64)
    for k in range(n):
        g = g * np.uint64(_R) + h[k : k + m]
    ok = np.ones(len(h), bool)
    for k in range(1, n):
        last = wo[1:] - k
        last = last[(last >= wo[:-1]) & (last >= 0)]
        ok[last] = False
    at = np.flatnonzero(ok[:m])
    return mix(g[at]), at


def owner(wo: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that word index at belongs to."""
    return np.searchsorted(wo, at, "right") - 1
