"""Words of whole texts found on the UTF-8 bytes of an Arrow column, compared eight bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes laid out at once; a longer text is cut behind a byte that belongs to no word.
STRETCH = 8 << 20


class Stretch:
    """Bytes of neighbouring texts: `data`, with `first` and `end` of each piece and the row it belongs to."""

    def __init__(self, data: np.ndarray, first: np.ndarray, end: np.ndarray, rows: np.ndarray):
        self.data, self.first, self.end, self.rows = data, first, end, rows

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and rows of the longest runs of bytes where `inside` holds, in order."""
        n = len(inside)
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[:1], after[-1:] = False, False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        before[self.first[self.first < n]] = False
        after[self.end[self.end > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends - starts, self.rows[np.searchsorted(self.end, starts, side="right")]


def stretches(column: pa.Array, inside: np.ndarray, most: int = STRETCH) -> Iterator[Stretch]:
    """The texts of a string column in stretches of about `most` bytes; null counts as empty.

    `inside` says for each byte value whether it can belong to a word. A text is cut only behind a byte that
    can't, so no word is cut; a word longer than `most` makes a longer stretch.
    """
    values = column.fill_null("").cast(pa.large_binary())
    if not len(values):
        return
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    content = values.buffers()[2]
    data = np.frombuffer(content, np.uint8) if content is not None else np.empty(0, np.uint8)
    firsts, ends, rows, size = [], [], [], 0

    def closed():
        base = firsts[0]
        return Stretch(data[base : ends[-1]], np.array(firsts) - base, np.array(ends) - base, np.array(rows))

    for row, (at, end) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
        while True:
            cut = end
            if end - at > most:
                cut = at + most
                while cut < end:
                    outside = np.flatnonzero(~inside[data[cut : min(cut + 65536, end)]])
                    if len(outside):
                        cut = cut + int(outside[0]) + 1
                        break
                    cut = min(cut + 65536, end)
            firsts.append(at)
            ends.append(cut)
            rows.append(row)
            size += cut - at
            at = cut
            if size >= most:
                yield closed()
                firsts, ends, rows, size = [], [], [], 0
            if cut >= end:
                break
    if firsts:
        yield closed()


class Chunks:
    """Eight-byte pieces of words: piece k of a word, zero behind its end. No word holds a zero byte."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate((data, np.zeros(8, np.uint8)))
        self.view = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
        self.last = len(data)

    def get(self, starts: np.ndarray, lengths: np.ndarray, k: int = 0) -> np.ndarray:
        left = np.clip(lengths - 8 * k, 0, 8)
        values = self.view[np.minimum(starts + 8 * k, self.last)]
        shift = ((8 - left) * 8).astype(np.uint64)
        # A shift by all 64 bits is not defined.
        kept = (values << np.minimum(shift, np.uint64(63))) >> np.minimum(shift, np.uint64(63))
        return np.where(left > 0, kept, np.uint64(0))


class Vocabulary:
    """Numbers 1, 2, ... for a set of words (bytes without zeros), found for many words at once, exactly.

    A word is a path of eight-byte pieces from the root; each level holds its pieces in order and, for every
    node and piece, the node it leads to.
    """

    FILTER_BITS = 20

    def __init__(self, words: list[bytes]):
        self.size = len(words)
        paths = [[int.from_bytes(w[i : i + 8], "little") for i in range(0, len(w), 8)] for w in words]
        self.levels, nodes, number = [], {(): 0}, np.zeros(1, np.int64)
        for depth in range(max(map(len, paths), default=0)):
            known: dict[tuple, int] = {}
            for path in paths:
                if len(path) > depth:
                    known.setdefault(tuple(path[: depth + 1]), len(known) + 1)
            pieces = np.array(sorted({p[-1] for p in known}), np.uint64)
            place = {int(p): i for i, p in enumerate(pieces)}
            steps = sorted((nodes[p[:-1]] * len(pieces) + place[p[-1]], node) for p, node in known.items())
            number = np.zeros(len(known) + 1, np.int64)
            for i, path in enumerate(paths):
                if len(path) == depth + 1:
                    number[known[tuple(path)]] = i + 1
            codes, targets = np.array([s[0] for s in steps], np.int64), np.array([s[1] for s in steps], np.int64)
            self.levels.append((pieces, codes, targets, number, self._filter(pieces)))
            nodes = known

    @classmethod
    def _slot(cls, pieces: np.ndarray) -> np.ndarray:
        return ((pieces * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - cls.FILTER_BITS)).astype(np.int64)

    @classmethod
    def _filter(cls, pieces: np.ndarray) -> np.ndarray:
        there = np.zeros(1 << cls.FILTER_BITS, bool)
        there[cls._slot(pieces)] = True
        return there

    def numbers(self, chunks: Chunks, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The number of every word, 0 for words that aren't in the set."""
        found = np.zeros(len(starts), np.int64)
        open_, node = np.arange(len(starts)), np.zeros(len(starts), np.int64)
        for depth, (pieces, codes, targets, number, there) in enumerate(self.levels):
            piece = chunks.get(starts[open_], lengths[open_], depth)
            maybe = there[self._slot(piece)]
            open_, node, piece = open_[maybe], node[maybe], piece[maybe]
            place = np.searchsorted(pieces, piece)
            place[place == len(pieces)] = 0
            code = np.where(pieces[place] == piece, node * len(pieces) + place, -1)
            at = np.searchsorted(codes, code)
            at[at == len(codes)] = 0
            hit = codes[at] == code
            open_, node = open_[hit], targets[at[hit]]
            ended = lengths[open_] <= 8 * (depth + 1)
            found[open_[ended]] = number[node[ended]]
            open_, node = open_[~ended], node[~ended]
            if not len(open_):
                break
        return found
