"""Running top k of a task: the best of all batches so far, emitted once at the end."""

from __future__ import annotations

import numpy as np


class RunningTop:
    """Best ``k`` keys per query over batches of scores. Scores are compared rounded, ties
    go to the smaller key. What a batch cannot improve is cut off by its k-th best score and
    by the k-th best held, so only candidates are put in order."""

    def __init__(self, k: int, decimals: int, extras: tuple[str, ...] = ()):
        self.k, self.decimals = k, decimals
        self.rows = np.zeros(0, dtype=np.int64)
        self.scores = np.zeros(0)
        self.keys = np.zeros(0, dtype=object)
        self.extras = {name: np.zeros(0, dtype=object) for name in extras}
        self._bound: np.ndarray | None = None

    def add(self, scores: np.ndarray, keys: np.ndarray, above: float = -np.inf, **extras: np.ndarray) -> None:
        """``scores``: queries by keys; only those above ``above`` count."""
        n_queries, n = scores.shape
        rounded = np.round(scores, self.decimals)
        fits = rounded > above
        if n > self.k:
            fits &= rounded >= np.partition(rounded, n - self.k, axis=1)[:, n - self.k, None]
        if self._bound is not None:
            fits &= rounded >= self._bound[:, None]
        row, column = np.nonzero(fits)
        rows = np.concatenate([self.rows, row])
        values = np.concatenate([self.scores, scores[row, column]])
        names = np.concatenate([self.keys, keys[column].astype(object)])
        place = np.unique(names, return_inverse=True)[1].reshape(-1) if len(names) else np.zeros(0, dtype=np.int64)
        order = np.lexsort((place, -np.round(values, self.decimals), rows))
        rows = rows[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        order = order[kept]
        self.rows, self.scores, self.keys = rows[kept], values[order], names[order]
        self.extras = {
            name: np.concatenate([held, extras[name][column].astype(object)])[order] for name, held in self.extras.items()
        }
        self._bound = np.full(n_queries, -np.inf)
        counts = np.bincount(self.rows, minlength=n_queries)
        last = np.cumsum(counts) - 1
        full = counts >= self.k
        self._bound[full] = np.round(self.scores[last[full]], self.decimals)
