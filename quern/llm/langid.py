"""Language identification by prediction by partial matching (PPM).

Per language a tree of byte contexts up to ORDER bytes is counted over a bounded sample of training texts. The
code length of a byte is found by PPM with escape method C, without exclusion: in a context seen N times with D
different successors a byte seen n times costs -log2(n / (N + D)); another byte pays the escape
-log2(D / (N + D)) and is coded in the next shorter context, at last among all 256 bytes alike. Statistics are frozen:
a text's code length under a language depends on the text alone, and the shortest one names the language.

Each language has a tree of its own, in its own alphabet: the SYMBOLS bytes it uses most, and one symbol for all
others, which are coded among themselves alike. All contexts of one byte are kept; longer ones if the sample has them
MIN_COUNT times and, of more than MAX_STATES, the most frequent, so the order varies. Frozen trees are automata: for
each state and symbol the code length stands in a table, and scoring takes a few look-ups a byte and language. A
tree takes about 4 MB at most, whatever the corpus; the trees are broadcast.

Texts are counted where they lie: tasks send (language, gram, count), and one task a language builds its tree.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import sampling
from quern.llm import textkernel as tk
from quern.session import cut, small, spread

ORDER = 3
MAX_ROWS = 400
SYMBOLS = 127
MAX_STATES = 5_000  # contexts of two and three bytes of each language
MIN_COUNT = 8
UNDETERMINED = "und"
_PAD = 0x0A


@dataclass
class Tree:
    symbol: np.ndarray  # byte -> symbol; 0 stands for all bytes outside the alphabet
    size: int  # symbols
    two: np.ndarray  # (second last, last symbol) -> node
    three: np.ndarray  # (node, third last symbol) -> state
    cost: np.ndarray  # (state, symbol) -> bits

    def bits(self, back: list[np.ndarray], data: np.ndarray) -> np.ndarray:
        """Bits of each byte; back: the bytes one, two and three places before it."""
        p1, p2, p3 = (self.symbol[x] for x in back)
        node = self.two[p2 * self.size + p1]
        return self.cost[self.three[node * self.size + p3] * self.size + self.symbol[data]]


def before(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The bytes one, two and three places before each byte; the first bytes of a text follow padding."""
    out = []
    full = off[:-1] < off[1:]
    starts, ends = off[:-1][full], off[1:][full]
    for back in range(1, ORDER + 1):
        p = np.full(len(data), _PAD, np.uint8)
        p[back:] = data[:-back]
        for k in range(back):
            at = starts + k
            p[at[at < ends]] = _PAD
        out.append(p)
    return out


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]

    def lengths(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Code length in bits of each text under each language."""
        out = np.zeros((len(off) - 1, len(self.langs)))
        if len(data) == 0:
            return out
        back = before(data, off)
        full = off[:-1] < off[1:]
        for j, tree in enumerate(self.trees):
            out[full, j] = np.add.reduceat(tree.bits(back, data), off[:-1][full], dtype=np.float64)
        return out


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams (a byte after its ORDER bytes, as one number) of a piece of texts, and their counts."""
    g = np.zeros(len(data), np.int64)
    for p in reversed(before(data, off)):
        g = g << 8 | p
    return np.unique(g << 8 | data, return_counts=True)


def fit(gram: np.ndarray, n: np.ndarray) -> Tree:
    """The tree of one language from its distinct grams and their counts (none: every byte costs 8 bits)."""
    seen = np.bincount(gram & 255, n, minlength=256)
    seen[_PAD] += 1
    alphabet = np.sort(np.argsort(-seen, kind="stable")[: min(SYMBOLS, int((seen > 0).sum()))])
    symbol = np.zeros(256, np.int32)
    symbol[alphabet] = np.arange(1, len(alphabet) + 1)
    size = len(alphabet) + 1
    part = [symbol[gram >> 8 * k & 255].astype(np.int64) for k in range(ORDER + 1)]  # the byte, and those before it

    # counts of (context, symbol) by order, and the contexts kept: those of one byte are all kept
    counts, kept, room = [], [], MAX_STATES
    for k in range(ORDER + 1):
        code = np.zeros(len(gram), np.int64)
        for back in range(k, -1, -1):
            code = code * size + part[back]
        code, where = np.unique(code, return_inverse=True)
        counts.append((code, np.bincount(where, n, minlength=len(code))))
        if k < 2:
            kept.append(np.arange(size**k))
            continue
        ctx, where = np.unique(code // size, return_inverse=True)
        total = np.bincount(where, counts[k][1], minlength=len(ctx))
        good = total >= MIN_COUNT
        if k > 2:  # its shorter context must be there
            good &= np.isin(ctx % size ** (k - 1), kept[k - 1])
        at = np.flatnonzero(good)
        ctx = np.sort(ctx[at[np.argsort(-total[at], kind="stable")[:room]]])
        room -= len(ctx)
        kept.append(ctx)

    others = 256 - len(alphabet)
    lower = np.full((1, size), 1 / 256)
    lower[0, 0] = max(others, 1) / 256
    rows = []
    for k in range(ORDER + 1):
        ctx = kept[k]
        table = np.zeros((len(ctx), size))
        code, count = counts[k]
        at = np.minimum(np.searchsorted(ctx, code // size), len(ctx) - 1)
        if len(ctx):
            ok = ctx[at] == code // size
            table[at[ok], (code % size)[ok]] = count[ok]
        base = lower[np.searchsorted(kept[k - 1], ctx % size ** (k - 1))] if k else lower
        total, kinds = table.sum(1, keepdims=True), (table > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            lower = np.where(table > 0, table / (total + kinds), np.where(total > 0, kinds / (total + kinds), 1.0) * base)
        if k:
            rows.append(lower)
    cost = -np.log2(np.concatenate(rows))
    cost[:, 0] += np.log2(max(others, 1))

    # nodes: one a symbol where only the last symbol counts, then the contexts of two; states: contexts in order
    two = np.tile(np.arange(size), size)
    two[kept[2]] = size + np.arange(len(kept[2]))
    three = np.repeat(np.arange(size + len(kept[2])), size)
    suffix, third = kept[3] % size**2, kept[3] // size**2
    node = size + np.searchsorted(kept[2], suffix)
    three[node * size + third] = size + len(kept[2]) + np.arange(len(kept[3]))
    return Tree(symbol, size, two.astype(np.int32), three.astype(np.int32), cost.astype(np.float32).reshape(-1))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """The language of each text and the share its code length gives it against the others' (uniform prior)."""
    names, scores = [], np.zeros(len(texts))
    for i, _, data, off in tk.pieces(texts):
        bits = model.lengths(data, off)
        ascii_letters = np.concatenate(([0], np.cumsum(_LETTER[data])))
        for k in range(len(off) - 1):
            a, b = int(off[k]), int(off[k + 1])
            letter = ascii_letters[b] > ascii_letters[a] or any(c.isalpha() for c in data[a:b].tobytes().decode("utf-8", "replace") if c > "\x7f" and c != "�")
            if not letter or not model.langs:
                names.append(UNDETERMINED)
                continue
            best = int(bits[k].argmin())
            names.append(model.langs[best])
            scores[i + k] = 1 / np.exp2(np.maximum(bits[k][best] - bits[k], -1000)).sum()
    return names, scores


def train(docs: DataFrame, in_training: Column, max_rows: int = MAX_ROWS) -> Model:
    """Fit on at most max_rows whole texts of each non-null language of the training fold: those with the smallest
    hashes of their id, of a repeated (id, language) one text. Two scans for all languages: keys, then the texts chosen."""
    usable = docs.filter("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL").filter(in_training)
    usable = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(31), F.col("doc_id").cast("string")), "doc_id")
    chosen = usable.select("doc_id", "lang").distinct().withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= max_rows)
    chosen = small(cut(chosen.select("doc_id", "lang"), "langid-ids"))
    texts = usable.join(chosen, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    texts = spread(cut(texts.select("lang", "text"), "langid-texts"))

    def count(batches):
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            for lang in sorted(set(langs)):
                own = b.column(1).filter(pa.array(langs == lang))
                for _, _, data, off in tk.pieces(own):
                    g, n = grams(data, off)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], names=["lang", "gram", "n"])

    def build(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("gram").to_numpy())
        tree = fit(t.column("gram").to_numpy()[order], t.column("n").to_numpy()[order])
        return pa.table({"lang": t.column("lang").slice(0, 1), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    counted = texts.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = sorted((r[0], bytes(r[1])) for r in counted.groupBy("lang").applyInArrow(build, "lang string, tree binary").toLocalIterator())
    # a language whose texts are all empty has no grams and is not learned
    return Model([lang for lang, _ in found], [pickle.loads(t) for _, t in found])


def identify(docs: DataFrame, folds: int = 5, held: int = 0, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row. Learns only from rows outside the held-out fold.

    A text that is null or has no letter is `und` with score 0; so is every text where nothing could be learned.
    Ties of code length fall to the first language in code-point order. Repeated rows give repeated results, very long
    texts are read whole, other columns are ignored. Empty table: no rows.
    """
    model = train(docs, sampling.fold(folds) != held, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            if b.num_rows:
                names, scores = predict(shared.value, b.column(1))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", (sampling.fold(folds) == held).alias("held_out"), "lang_pred", "score")
