"""Order statistics of moving frames.

Values become ranks, and ranks are split bit by bit from the highest: at each bit the rows keep their order, those without
the bit first. Counts of zeros up to each row say, for any stretch of rows, how many of it go to either side, so the
k-th smallest of a stretch is found bit by bit. All frames go down together: one pass over the rows for each bit.
"""

from __future__ import annotations

import numpy as np


class RankTree:
    """k-th smallest of any stretch of a sequence of distinct ranks 0 .. n - 1."""

    def __init__(self, ranks: np.ndarray):
        n = len(ranks)
        self.bits = max(1, int(n - 1).bit_length()) if n else 0
        self.zeros: list[np.ndarray] = []
        now = ranks
        for b in range(self.bits - 1, -1, -1):
            one = (now >> b) & 1 == 1
            upto = np.zeros(n + 1, np.int64)
            np.cumsum(~one, out=upto[1:])
            self.zeros.append(upto)
            now = np.concatenate([now[~one], now[one]])

    def smallest(self, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Rank of the k-th smallest (from 0) of each stretch start .. end - 1."""
        start, end, k, rank = start.copy(), end.copy(), k.copy(), np.zeros(len(k), np.int64)
        for upto in self.zeros:
            low, high, all_zeros = upto[start], upto[end], upto[-1]
            right = k >= high - low
            k -= np.where(right, high - low, 0)
            start = np.where(right, all_zeros + start - low, low)
            end = np.where(right, all_zeros + end - high, high)
            rank = 2 * rank + right
        return rank


def quantiles(values: np.ndarray, rows: int, prob: float, least: int = 1) -> np.ndarray:
    """For each row the quantile, with linear interpolation, of the last ``rows`` rows, itself among them.

    NaN values are in the frames but not in the quantile; a frame with fewer than ``least`` values gives NaN.
    """
    values = np.asarray(values, float)
    there = ~np.isnan(values)
    seen = np.concatenate(([0], np.cumsum(there)))
    end = seen[1:]
    start = seen[np.maximum(0, np.arange(len(values)) + 1 - rows)]
    n = end - start
    out = np.full(len(values), np.nan)
    some = np.flatnonzero(n >= max(1, least))
    if len(some):
        known = values[there]
        order = np.argsort(known, kind="stable")
        ranks = np.empty(len(known), np.int64)
        ranks[order] = np.arange(len(known))
        tree, in_order = RankTree(ranks), known[order]
        at = prob * (n[some] - 1)
        low = np.floor(at).astype(np.int64)
        a = in_order[tree.smallest(start[some], end[some], low)]
        b = in_order[tree.smallest(start[some], end[some], np.minimum(low + 1, n[some] - 1))]
        out[some] = a + (b - a) * (at - low)
    return out
