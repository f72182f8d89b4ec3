"""The best rows of each question, kept while a task reads batch after batch: what is shuffled grows with questions, not with rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

#: Tasks of a scan that keeps the best rows: each hands on k rows a question.
TASKS_A_CORE = 3


def few_tasks(df: DataFrame) -> DataFrame:
    """df read by a few tasks for each core at most, without a shuffle."""
    return df.coalesce(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)


class Best:
    """The k best rows of n questions by score, ties by the first `ties` columns. bar: the score of each question's k-th row so far, which no
    worse row need be added to; it rises whenever the rows held have doubled."""

    def __init__(self, n: int, k: int, ties: int):
        self.k, self.ties, self.bar = k, ties, np.full(n, -np.inf)
        self.parts, self.held, self.kept = [], 0, 0

    def add(self, who: np.ndarray, score: np.ndarray, *columns: np.ndarray) -> None:
        if len(who):
            self.parts.append((who, score, *columns))
            self.held += len(who)
            if self.held > 2 * self.kept + 100_000:
                self.rows()

    def rows(self) -> list[np.ndarray]:
        """who, score and the columns of the rows kept; empty if there are none."""
        if not self.parts:
            return []
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        order = np.lexsort([*reversed(columns[2 : 2 + self.ties]), -columns[1], columns[0]])
        who = columns[0][order]
        first = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        place = np.arange(len(who)) - np.repeat(first, np.diff(np.r_[first, len(who)]))
        last = order[place == self.k - 1]
        self.bar[columns[0][last]] = columns[1][last]
        columns = [c[order[place < self.k]] for c in columns]
        self.parts, self.held, self.kept = [tuple(columns)], len(columns[0]), len(columns[0])
        return columns


class Filters:
    """Which rows of a batch each question admits. how: `equal`, or `prefix` (begins with it as a path), for each column; wanted: a tuple a
    question, whose nulls ask for nothing. Questions that want the same share a mask."""

    def __init__(self, how: list[str], wanted: list[tuple]):
        self.how, self.distinct = how, list(dict.fromkeys(wanted))
        at = {w: i for i, w in enumerate(self.distinct)}
        self.of = np.array([at[w] for w in wanted], np.int64)

    def admits(self, columns: list[list], n: int) -> np.ndarray:
        """A row for each distinct wish (`of` has each question's), a column for each of the n rows."""
        tests: dict = {}
        out = np.ones((len(self.distinct), n), bool)
        for i, want in enumerate(self.distinct):
            for c, (how, w) in enumerate(zip(self.how, want)):
                if w is None:
                    continue
                if (c, w) not in tests:
                    test = (lambda v: v == w) if how == "equal" else (lambda v: v == w or (v is not None and v.startswith(w + "/")))
                    tests[c, w] = np.array([test(v) for v in columns[c]], bool)
                out[i] &= tests[c, w]
        return out
