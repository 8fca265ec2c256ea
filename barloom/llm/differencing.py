"""Karmarkar-Karp multiway differencing over partial partitions."""

from __future__ import annotations

import heapq

import numpy as np


def combine(parts: np.ndarray) -> np.ndarray:
    """Merge partial partitions into one.

    ``parts`` has a row for each partial partition and a column for each of its k subset sums. The two partitions
    with the largest spread (largest less smallest sum) are merged again and again, the heaviest subset of one with
    the lightest of the other. Returns, for each row and column, the final subset (0 to k - 1) it ends in.
    """
    n, k = parts.shape
    if n == 0:
        return np.zeros((0, k), dtype=np.int64)
    first = np.argsort(parts, axis=1, kind="stable")
    sums = list(np.take_along_axis(parts, first, axis=1))
    heap = [(int(s[0] - s[-1]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    merges = []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = sums[a] + sums[b][::-1]
        order = both.argsort(kind="stable")
        both = both[order]
        sums[a] = sums[b] = None
        sums.append(both)
        merges.append((a, b, order))
        heapq.heappush(heap, (int(both[0] - both[-1]), len(sums) - 1))
    place: list = [None] * len(sums)
    place[-1] = np.arange(k)
    for node in range(len(sums) - 1, n - 1, -1):
        a, b, order = merges[node - n]
        back = np.empty(k, dtype=np.int64)
        back[order] = place[node]
        place[a], place[b], place[node] = back, back[::-1], None
    out = np.empty((n, k), dtype=np.int64)
    np.put_along_axis(out, first, np.stack(place[:n]), axis=1)
    return out


def partition(weights: np.ndarray, k: int) -> np.ndarray:
    """The subset (0 to k - 1) of each single item."""
    parts = np.zeros((len(weights), k), dtype=np.int64)
    parts[:, -1] = weights
    return combine(parts)[:, -1]
