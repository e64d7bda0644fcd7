"""Edit distance of two word sequences within a band."""

from __future__ import annotations

import numpy as np


def _same_run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many words from a[i] and b[j] on are equal."""
    most, at, step = min(len(a) - i, len(b) - j), 0, 64
    while at < most:
        differ = a[i + at : i + min(at + step, most)] != b[j + at : j + min(at + step, most)]
        first = differ.argmax()
        if differ[first]:
            return at + int(first)
        at, step = at + len(differ), step * 4
    return most


#: Cells of a band for which all runs of equal words are found beforehand by array operations.
CELLS = 1 << 22


def _run_ends(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """For every diagonal -limit ... limit and place in `a`: where the run of equal words from there ends."""
    n = len(a)
    outside = np.full(limit, -1, np.int64)
    padded = np.concatenate([outside, b.astype(np.int64), outside, np.full(n, -1, np.int64)])
    beside = np.lib.stride_tricks.sliding_window_view(padded, n)[: 2 * limit + 1]
    ends = np.where(beside == a.astype(np.int64), np.int32(n), np.arange(n, dtype=np.int32))
    return np.minimum.accumulate(ends[:, ::-1], axis=1)[:, ::-1]


def distance_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """The least number of inserted, deleted and replaced words, or None if it is over `limit`.

    Banded alignment by diagonals: for d edits, the furthest place reached on each of the diagonals -d ... d,
    each extended over equal words. Diagonals from which the end is out of reach are left out.
    """
    n, m = len(a), len(b)
    goal, middle = m - n, limit + 1
    if abs(goal) > limit:
        return None
    ends = _run_ends(a, b, limit) if n and n * (2 * limit + 1) <= CELLS else None
    reached = np.full(2 * limit + 3, -2)
    reached[middle] = _same_run(a, b, 0, 0)
    for d in range(limit + 1):
        if reached[middle + goal] >= n:
            return d
        spare = limit - d - 1
        low, high = max(-d - 1, goal - spare), min(d + 1, goal + spare)
        if low > high:
            return None
        k = np.arange(low, high + 1)
        from_, to = middle + low, middle + high + 1
        i = np.maximum(np.maximum(reached[from_:to], reached[from_ + 1 : to + 1]) + 1, reached[from_ - 1 : to - 1])
        i = np.minimum(np.minimum(i, n), m - k)
        i[i < np.maximum(0, -k)] = -2
        own = np.flatnonzero((i >= 0) & (i < n) & (i + k < m))
        if ends is not None:
            i[own] = ends[k[own] + limit, i[own]]
        else:
            # Most diagonals differ at once; only those that agree for a while are followed by themselves.
            for _ in range(4):
                own = own[a[i[own]] == b[i[own] + k[own]]]
                i[own] += 1
                own = own[(i[own] < n) & (i[own] + k[own] < m)]
            for x in own.tolist():
                i[x] += _same_run(a, b, int(i[x]), int(i[x] + k[x]))
        reached = np.full(2 * limit + 3, -2)
        reached[from_:to] = i
    return None


class Words:
    """A word sequence with the counts of its words and of its neighbouring pairs of words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.single = np.unique(words, return_counts=True)
        wide = words.astype(np.uint64)
        self.pairs = np.unique((wide[:-1] << np.uint64(32)) | wide[1:], return_counts=True)


def _common(a, b) -> int:
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    return int(np.minimum(a[1][i], b[1][j]).sum())


def similar(a: Words, b: Words, least: float) -> bool:
    """Whether 1 - distance / length of the longer one is at least `least`.

    An edit changes one word and at most two pairs, so too few common words or pairs rule a similarity out
    before anything is aligned.
    """
    longer = max(len(a.words), len(b.words))
    limit = int((1 - least) * longer + 1e-9)
    if longer == 0:
        return True
    if longer - _common(a.single, b.single) > limit or longer - 1 - _common(a.pairs, b.pairs) > 2 * limit:
        return False
    return distance_within(a.words, b.words, limit) is not None
