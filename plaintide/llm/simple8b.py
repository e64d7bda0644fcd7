"""Simple-8b: 64-bit words of a 4-bit selector and 60 bits with as many equal-width numbers as fit."""

from __future__ import annotations

import numpy as np

# Count and bit width by selector, as published (Anh and Moffat, 2010), but that selector 0 is
# the escape (the next word is one raw 64-bit number) and selector 1 a run of 120 zeros.
COUNTS = [1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1]
WIDTHS = [64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60]


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words for `numbers` (unsigned, below 2**64), and the places of the escapes among the words.

    Every word takes the most numbers that fit, from left to right; the last one is filled with zeros.
    """
    numbers = np.asarray(numbers, np.uint64)
    n = len(numbers)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    padded = np.concatenate([numbers, np.zeros(max(COUNTS), np.uint64)])
    choice = np.full(len(padded), 15, np.int8)
    for selector in range(15, 0, -1):
        count, width = COUNTS[selector], WIDTHS[selector]
        fits = np.flatnonzero(padded < np.uint64(1 << width))
        if len(fits) >= count:
            run = fits[: len(fits) - count + 1]
            choice[run[fits[count - 1 :] - run == count - 1]] = selector
    choice[padded >= np.uint64(1 << 60)] = 0
    steps = np.array(COUNTS)[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += steps[at]
    starts = np.array(starts)
    chosen = choice[starts]
    place = np.arange(len(starts)) + np.cumsum(chosen == 0) - (chosen == 0)
    words = np.zeros(len(starts) + int((chosen == 0).sum()), np.uint64)
    words[place] = chosen.astype(np.uint64)
    for selector in range(2, 16):
        own = np.flatnonzero(chosen == selector)
        base, width = starts[own], np.uint64(WIDTHS[selector])
        made = words[place[own]]
        for k in range(COUNTS[selector]):
            made |= padded[base + k] << (np.uint64(4) + np.uint64(k) * width)
        words[place[own]] = made
    escapes = place[chosen == 0]
    words[escapes + 1] = numbers[starts[chosen == 0]]
    return words, escapes.astype(np.int32)


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first n numbers of `words`, all words of a selector at once."""
    words = np.asarray(words, np.uint64)
    head = np.ones(len(words), bool)
    head[escapes + 1] = False
    places = np.flatnonzero(head)
    chosen = (words[places] & np.uint64(15)).astype(np.int8)
    counts = np.array(COUNTS)[chosen]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    for selector in range(2, 16):
        own = np.flatnonzero(chosen == selector)
        base, width = starts[own], np.uint64(WIDTHS[selector])
        data, mask = words[places[own]] >> np.uint64(4), np.uint64((1 << WIDTHS[selector]) - 1)
        for k in range(COUNTS[selector]):
            out[base + k] = (data >> (np.uint64(k) * width)) & mask
    own = np.flatnonzero(chosen == 0)
    out[starts[own]] = words[places[own] + 1]
    return out[:n]
