"""Exact order statistics of windows that slide: a histogram in two levels, added to and taken from."""

from __future__ import annotations

import math

import numpy as np


class CountHistogram:
    """Counts of ``values`` (distinct, in order), and of blocks of about as many values as there are blocks.

    Adding and removing touches a value and its block; a rank is found among the blocks first
    and then inside one of them.
    """

    def __init__(self, values: np.ndarray):
        self.values, self.n = values, 0
        self.width = max(1, math.isqrt(len(values)))
        self.coarse = np.zeros(-(-len(values) // self.width), np.int64)
        self.fine = np.zeros(len(self.coarse) * self.width, np.int64)

    def add(self, places: np.ndarray, times: int = 1) -> None:
        """Count the values at ``places`` once more each, or with -1 once less."""
        np.add.at(self.fine, places, times)
        np.add.at(self.coarse, places // self.width, times)
        self.n += times * len(places)

    def nearest_rank(self, share: float) -> float:
        """The least value that so large a share of the counted ones doesn't exceed; NaN of nothing."""
        if not self.n:
            return math.nan
        rank = max(1, math.ceil(share * self.n))
        blocks = np.cumsum(self.coarse)
        b = int(np.searchsorted(blocks, rank))
        inside = np.cumsum(self.fine[b * self.width : (b + 1) * self.width])
        return float(self.values[b * self.width + int(np.searchsorted(inside, rank - (blocks[b - 1] if b else 0)))])


def window_ranks(ts: np.ndarray, values: np.ndarray, ends: np.ndarray, share: float, window_ms: int) -> np.ndarray:
    """For each of ``ends`` (ascending) the nearest rank of the values from ``window_ms`` before it to it, both included."""
    order = np.argsort(ts, kind="stable")
    ts, values = ts[order], values[order]
    distinct, places = np.unique(values, return_inverse=True)
    histogram = CountHistogram(distinct)
    low, high = np.searchsorted(ts, ends - window_ms, "left"), np.searchsorted(ts, ends, "right")
    out, a, b = np.full(len(ends), np.nan), 0, 0
    for k, (p, q) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        histogram.add(places[b:q])
        histogram.add(places[a:p], -1)
        a, b = p, q
        out[k] = histogram.nearest_rank(share)
    return out
