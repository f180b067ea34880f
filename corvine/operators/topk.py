"""The best rows of many queries at once, kept within a task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class TopK:
    """For each of ``queries`` the ``k`` highest scores with their row ids; of equal scores the smallest ids."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.floor = k, np.full(queries, -np.inf)
        self.query, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def offer(self, scores: np.ndarray, rows: np.ndarray) -> None:
        """Scores by row and query; ``-inf`` is no score."""
        at, query = np.nonzero((scores >= self.floor) & (scores > -np.inf))
        if not len(at):
            return
        query, row = np.concatenate([self.query, query]), np.concatenate([self.row, rows[at]])
        score = np.concatenate([self.score, scores[at, query[len(self.query) :]]])
        order = np.lexsort((row, -score, query))
        query, row, score = query[order], row[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.row, self.score = query[keep], row[keep], score[keep]
        last = place[keep] == self.k - 1
        self.floor[self.query[last]] = self.score[last]

    def offer_one(self, query: int, scores: np.ndarray, rows: np.ndarray) -> None:
        """Scores of one query by row."""
        good = scores >= self.floor[query]
        own = self.query == query
        score, row = np.concatenate([self.score[own], scores[good]]), np.concatenate([self.row[own], rows[good]])
        keep = np.lexsort((row, -score))[: self.k]
        self.query = np.concatenate([self.query[~own], np.full(len(keep), query, np.int64)])
        self.row, self.score = np.concatenate([self.row[~own], row[keep]]), np.concatenate([self.score[~own], score[keep]])
        if len(keep) == self.k:
            self.floor[query] = score[keep[-1]]

    def batch(self, names: np.ndarray, columns: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names[self.query], pa.int64()), pa.array(self.row, pa.int64()), pa.array(self.score)], columns)
