"""Licence scanning with a generalised suffix automaton.

All licence templates go, as word sequences, into one suffix automaton. A file is streamed through it: at each word
the automaton tells the length of the longest run of template words that ends there (matching statistics), and its
suffix links tell the longest run of every single template. Runs of MIN_MATCH words or more, which cannot be extended,
are chained per template while they advance in both the file and the template; a chain is a covered span, and a
template of which at least COVERAGE is covered gives its label, unless a longer match of another lies around it.

Words are compared by 64-bit hashes. A run of MIN_MATCH words needs MIN_MATCH - 1 adjacent word pairs that occur in
templates, so the automaton only steps through stretches of such pairs, which a vectorised pass finds; all others
have matching statistics below MIN_MATCH and cannot change a result.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textkernel as tk

MIN_MATCH = 4
MAX_GAP = 12
COVERAGE = 0.6

# The phrases that the base labels look for.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Public licence notices, the wording each licence asks files to carry.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
     documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
     rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
     persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
     this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
     "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
     FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
     CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
     CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
     the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
     applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
     WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
     permissions and limitations under the License."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
     License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
     version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
     implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
     details. You should have received a copy of the GNU General Public License along with this program. If not, see
     https://www.gnu.org/licenses/."""),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
     Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
     later version."""),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
     following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
     conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
     list of conditions and the following disclaimer in the documentation and/or other materials provided with the
     distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
     granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
     distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
     use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
     commercial or non-commercial, and by any means."""),
]


def words(text: str) -> list[int]:
    """Hashes of the words of one text."""
    data = tk.LOWER[np.frombuffer(text.encode(), np.uint8)]
    s, e, _ = tk.spans(data, np.array([0, len(data)]), tk.ALNUM)
    return [int(h) for h in tk.word_hashes(data, s, e)]


class Automaton:
    """Generalised suffix automaton of word sequences; `ends` lists, for a state, where its words end in templates."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [[]]
        for n, seq in enumerate(sequences):
            last = 0
            for i, c in enumerate(seq):
                last = self._extend(last, c)
                self.ends[last].append((n, i + 1))
        for v in sorted(range(1, len(self.next)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] += self.ends[v]
        self.ends = [sorted(set(x)) for x in self.ends]

    def _new(self, length: int, link: int, nxt: dict) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        cur = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, c, self.next[p][c])
        return cur

    def statistics(self, seq: list[int]) -> list[tuple[int, int]]:
        """For each word: the length of the longest template run that ends at it, and the run's state."""
        out, v, n = [], 0, 0
        for c in seq:
            while v and c not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if c in self.next[v]:
                v, n = self.next[v][c], n + 1
            else:
                n = 0
            out.append((n, v))
        return out


class Scanner:
    def __init__(self, templates=TEMPLATES, phrases=PHRASES, min_match=MIN_MATCH, max_gap=MAX_GAP, coverage=COVERAGE):
        self.labels = [x for x, _ in templates]
        seqs = [words(t) for _, t in templates]
        self.sizes = [len(s) for s in seqs]
        self.auto = Automaton(seqs)
        self.min_match, self.max_gap, self.coverage = min_match, max_gap, coverage
        # a template shorter than min_match must match whole
        self.floor = min([min_match, *self.sizes])
        pairs = [np.array(s, np.uint64) for s in seqs]
        self.pairs = np.unique(np.concatenate([_pair(p) for p in pairs]))
        self.map = np.zeros(1 << 16, bool)
        self.map[(self.pairs >> np.uint64(48)).astype(np.int64)] = True
        self.phrases = [(np.array(words(p), np.uint64), x) for p, x in phrases]

    def places(self, n: int, v: int) -> dict[int, tuple[int, list[int]]]:
        """Per template: its longest run that ends where the automaton is, and where that run ends in the template.

        The state tells it for the templates that hold the whole run; its suffix links lead to shorter runs, which more
        templates hold, so a template that stands inside a longer one is met as well.
        """
        out: dict[int, tuple[int, list[int]]] = {}
        while v > 0 and n >= self.floor:
            here: dict[int, list[int]] = {}
            for t, end in self.auto.ends[v]:
                if t not in out:
                    here.setdefault(t, []).append(end)
            out |= {t: (n, ends) for t, ends in here.items()}
            v = self.auto.link[v]
            n = self.auto.length[v]
        return out

    def spans(self, seq: list[int], base: int) -> list[tuple[int, int, int, int]]:
        """Runs (template, first word, template's first word, length) of one stretch that no further word of it extends."""
        runs, here = [], {}
        for i, (n, v) in enumerate([*self.auto.statistics(seq), (0, 0)]):
            last, here = here, self.places(n, v)
            for t, (m, ends) in last.items():
                if here.get(t, (0,))[0] != m + 1 and m >= min(self.min_match, self.sizes[t]):
                    runs += [(t, i - m + base, end - m, m) for end in ends]
        return runs

    def chain(self, runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(first word, last word + 1, template, covered words): runs chained while they advance in file and template.

        A run joins the chain before it that covers most, at most max_gap words back; of chains that overlap, the one
        that covers most stays.
        """
        out = []
        for t in sorted({r[0] for r in runs}):
            live: list[tuple[int, int, int, int]] = []  # first, end, covered, end in the template
            group: list[tuple[int, int, int, int]] = []
            for i, j, n in sorted(r[1:] for r in runs if r[0] == t):
                live = [c for c in live if i - c[1] <= self.max_gap]
                if not live:
                    out += [(a, b, t, k) for a, b, k, _ in _apart(group)]
                    group = []
                best = (i, i + n, n, j + n)
                for a, b, k, e in live:
                    skip = max(0, b - i, e - j)  # words that both runs cover count once
                    if skip < n and i + skip - b <= self.max_gap and k + n - skip > best[2]:
                        best = (a, i + n, k + n - skip, j + n)
                live.append(best)
                group.append(best)
            out += [(a, b, t, k) for a, b, k, _ in _apart(group)]
        return out

    def labelled(self, chains: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Chains that give labels: enough of the template is covered, and no such chain around them covers more words.

        A notice with a clause more holds most words of the notice without it; it is the longer one that stands there.
        """
        out, around = [], []
        enough = (x for x in chains if x[3] >= self.coverage * self.sizes[x[2]])
        for x in sorted(enough, key=lambda x: (x[0], -x[1], -x[3], x[2])):
            around = [y for y in around if y[1] > x[0]]
            if not any(y[1] >= x[1] and y[3] > x[3] for y in around):
                out.append(x)
            around.append(x)
        return out

    def scan(self, texts: pa.Array):
        """Per text: n_words, n_base, first, last, base labels, labels, score, spans."""
        for _, _, data, off in tk.pieces(texts):
            low = tk.LOWER[data]
            s, e, wo = tk.spans(low, off, tk.ALNUM)
            h = tk.word_hashes(low, s, e)
            rows = len(off) - 1
            hits: list[list[tuple[int, str]]] = [[] for _ in range(rows)]
            row = np.repeat(np.arange(rows), np.diff(wo))
            for p, label in self.phrases:
                m = len(h) - len(p) + 1
                if m <= 0:
                    continue
                at = np.flatnonzero(h[:m] == p[0])
                for k in range(1, len(p)):
                    at = at[(h[at + k] == p[k]) & (row[at + k] == row[at])]
                for x in at.tolist():
                    hits[row[x]].append((x - int(wo[row[x]]), label))
            runs: list[list] = [[] for _ in range(rows)]
            for a, b in self._stretches(h, row):
                r = int(row[a])
                runs[r] += self.spans([int(x) for x in h[a:b]], a - int(wo[r]))
            for r in range(rows):
                chains = self.chain(runs[r]) if runs[r] else []
                best = max((c / self.sizes[t] for _, _, t, c in chains), default=0.0)
                spans = self.labelled(chains)
                own = {self.labels[t] for _, _, t, _ in spans}
                base = {x for _, x in hits[r]}
                at = [x for x, _ in hits[r]]
                yield int(wo[r + 1] - wo[r]), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | own)), min(1.0, best), spans

    def _stretches(self, h: np.ndarray, row: np.ndarray):
        """(first, last + 1) word indices of stretches whose adjacent pairs all occur in templates, long enough to matter."""
        if len(h) < 2:
            return []
        g = _pair(h)
        maybe = np.flatnonzero(self.map[(g >> np.uint64(48)).astype(np.int64)] & (row[1:] == row[:-1]))
        if len(maybe) == 0:
            return []
        at = np.minimum(np.searchsorted(self.pairs, g[maybe]), len(self.pairs) - 1)
        hit = maybe[self.pairs[at] == g[maybe]]
        if len(hit) == 0:
            return []
        new = np.flatnonzero(np.diff(hit) != 1) + 1
        first, last = hit[np.concatenate(([0], new))], hit[np.concatenate((new - 1, [len(hit) - 1]))]
        long = last - first + 2 >= self.floor
        # adjacent stretches of two texts are cut by the row test: a pair never crosses texts
        return list(zip(first[long].tolist(), (last[long] + 2).tolist()))


def _apart(chains: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The chains that cover most, none overlapping another, in file order."""
    kept: list[tuple[int, int, int, int]] = []
    for c in sorted(chains, key=lambda c: (-c[2], c[1] - c[0], c)):
        at = bisect.bisect(kept, c)
        if (at == 0 or kept[at - 1][1] <= c[0]) and (at == len(kept) or c[1] <= kept[at][0]):
            kept.insert(at, c)
    return kept


def _pair(h: np.ndarray) -> np.ndarray:
    return tk.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of every row.

    score is the largest share of a template that one chain covers. spans lists the chains that give labels (first
    word, last word + 1, label, share). A null or empty text has no words, no labels ("") and score 0; a very long text is
scanned whole. Repeated rows and rows without a doc_id each give a row; an empty table gives none; columns other than
doc_id and text are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first:long,end:long,label:string,share:double>>"
    span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sc = shared.value
            cols = list(zip(*sc.scan(b.column(1))))
            found = [[{"first": i, "end": j, "label": sc.labels[t], "share": c / sc.sizes[t]} for i, j, t, c in x] for x in cols[7]]
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, k) for x, k in zip(cols, kinds)], pa.array(found, span)], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)
