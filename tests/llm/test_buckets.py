"""Which texts of a bucket of minima need their sets of shingles there."""

from itertools import combinations

import numpy as np

from barloom.llm import simhash


def test_a_pair_meets_in_the_first_bucket_that_both_are_in():
    rng = np.random.default_rng(3)
    n, k = 60, 6
    own, bands = rng.integers(0, 40, n), rng.integers(0, 4, (n, k))
    share = rng.integers(0, 2, (n, 100)).astype(np.uint8)
    share[::2] = share[0]  # candidates by their minima
    near = lambda i, j: own[i] != own[j] and (share[i] == share[j]).mean() >= simhash.LEAST_SHARE
    times = dict.fromkeys(((i, j) for i, j in combinations(range(n), 2) if near(i, j) and (bands[i] == bands[j]).any()), 0)
    travelled = members = 0
    for band in range(k):
        for value in range(4):
            at = np.flatnonzero(bands[:, band] == value)
            if len(at) < 2:
                continue
            used = set(at[simhash.met_first(own[at], share[at], bands[at], band, step=7)].tolist())
            members, travelled = members + len(at), travelled + len(used)
            for i, j in combinations(at.tolist(), 2):
                if (i, j) in times and not (bands[i, :band] == bands[j, :band]).any():
                    assert i in used and j in used
                    times[i, j] += 1
    assert times and set(times.values()) == {1} and travelled < members / 2
    alike = np.zeros(5, dtype=np.int64)
    assert len(simhash.met_first(alike, share[:5], bands[:5], 0)) == 0
