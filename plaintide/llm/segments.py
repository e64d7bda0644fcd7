"""Whole texts cut into words by array operations, and a bounded per-worker table of word results.

A run of texts is laid out as one array of code points with a separator behind each text. Word starts
are found on the whole array, every word gets a 64-bit hash, and only words not met before in this
Python worker reach the slow path. Hashes come from running sums; a sum has words of 1,024 letters and
more that collide for certain, so words beyond SUMMED code points are hashed by BLAKE2b instead. The table
of results compares the code points of every word with the word it holds, so a shared hash changes nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from unicodedata import category

import numpy as np
import regex
from tokenizers.pre_tokenizers import ByteLevel

#: Characters laid out at once; a longer text is cut in front of a single space between two words.
CHUNK = 1 << 18
#: Code points up to which a word's hash is a running sum.
SUMMED = 64
LETTER, NUMBER, OTHER, SPACE, END = range(5)
_CUT = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_MULTIPLIER = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit (splitmix64's finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point: letter, number, white space (Unicode White_Space) or other.

    The Unicode versions of Python and of the regex package differ; where they disagree, the byte-level
    splitter of the tokenizers library decides, as its results are the ones to give.
    """
    found = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, range(0x110000)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for match in regex.finditer(pattern, every):
            found[match.start() : match.end()] = kind
    here = {"L": LETTER, "N": NUMBER}
    own = np.fromiter((here.get(category(c)[0], OTHER) for c in every), np.uint8, len(every))
    splitter = ByteLevel(add_prefix_space=False, use_regex=True)
    for c in np.flatnonzero((found != own) & (found != SPACE)).tolist():
        if len(splitter.pre_tokenize_str("a" + chr(c))) == 1:
            found[c] = LETTER
        else:
            found[c] = NUMBER if len(splitter.pre_tokenize_str("1" + chr(c))) == 1 else OTHER
    return found


@lru_cache(1)
def _code_values() -> np.ndarray:
    return mixed(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(_MULTIPLIER))


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, as far as the longest run so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + (CHUNK >> 2))
            base, back = np.uint64(_MULTIPLIER), np.uint64(pow(_MULTIPLIER, -1, 1 << 64))
            for name, factor in (("up", base), ("down", back)):
                values = np.full(size, factor, np.uint64)
                values[0] = 1
                setattr(cls, name, np.multiply.accumulate(values))
        return cls.up, cls.down


class Layout:
    """Texts side by side: `text` (str), `codes` (code points), `kinds` (classes), `text_start`."""

    def __init__(self, texts: list[str], owners: list[int]):
        self.owners = np.asarray(owners, np.int64)
        self.text = "\0".join(texts) + "\0"
        self.codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths + 1) - 1
        self.text_start = ends - lengths
        self.kinds = classes()[self.codes]
        self.kinds[ends] = END

    def words(self, starts: np.ndarray, ends: np.ndarray) -> list[str]:
        text = self.text
        return [text[a:b] for a, b in zip(starts.tolist(), ends.tolist())]

    def running(self, codes: np.ndarray | None = None) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function giving the hash of every stretch [start, end)."""
        codes = self.codes if codes is None else codes
        up, down = _Powers.upto(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_code_values()[codes] * up[: len(codes)], out=sums[1:])

        def hashes(starts, ends):
            found = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
            for i in np.flatnonzero(ends - starts > SUMMED).tolist():
                word = codes[starts[i] : ends[i]].astype("<u4").tobytes()
                found[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
            return found

        return hashes

    def owner_of(self, starts: np.ndarray) -> np.ndarray:
        """Number of the text that each word belongs to, as the caller counts texts."""
        return self.owners[np.searchsorted(self.text_start, starts, side="right") - 1]


def layouts(texts: Iterable[str], head: str = "") -> Iterator[Layout]:
    """All texts in runs of about CHUNK characters; `head` goes before every text that isn't empty.

    A long text is spread over several runs; it is cut only in front of a single space that stands
    between two other characters, where every splitter below starts a word anyway.
    """
    pieces, owners, size = [], [], 0
    for owner, text in enumerate(texts):
        if text:
            text = head + text
        at = 0
        while True:
            cut = _CUT.search(text, at + CHUNK) if len(text) - at > CHUNK else None
            end = cut.start() if cut else len(text)
            pieces.append(text[at:end] if at or cut else text)
            owners.append(owner)
            size += end - at + 1
            at = end
            if size >= CHUNK:
                yield Layout(pieces, owners)
                pieces, owners, size = [], [], 0
            if cut is None:
                break
    if pieces:
        yield Layout(pieces, owners)


def byte_level_words(run: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends by the published byte-level pattern:
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    kinds, codes = run.kinds, run.codes
    first = np.empty(len(kinds), bool)
    first[0] = True
    np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
    # The last white space before a word stands alone, or goes with the word if it is a plain space.
    last_blank = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] < SPACE))
    first[last_blank] = True
    first[last_blank[codes[last_blank] == 32] + 1] = False
    quote = np.flatnonzero((codes[:-1] == 39) & first[:-1] & (kinds[1:] == LETTER))
    if len(quote):
        one, two = codes[quote + 1], codes[np.minimum(quote + 2, len(codes) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(quote), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for found, size in ((quote[short], 1), (quote[long], 2)):
            first[found + 1] = False
            rest = found + 1 + size
            first[rest[kinds[rest] == LETTER]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(kinds))
    real = kinds[starts] != END
    return starts[real], ends[real]


def piece_segments(run: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of spaces with the other characters that follow: pieces never span two of them."""
    mark = (run.codes == 32) | (run.codes == 0x2581)
    over = run.kinds == END
    first = np.empty(len(mark), bool)
    first[0] = True
    first[1:] = (mark[1:] & ~mark[:-1]) | over[1:] | over[:-1]
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(mark))
    real = ~over[starts]
    return starts[real], ends[real]


def runs_of(run: Layout, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches where `inside` holds."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return edge[0::2], edge[1::2]


def plain_words(run: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Stretches without white space."""
    return runs_of(run, run.kinds < SPACE)


def letter_words(run: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of letters."""
    return runs_of(run, run.kinds == LETTER)


class WordTable:
    """Results of words met before: a row of numbers each, of any length.

    A word is looked up by its hash and then compared with the word of that hash, code point by code point; words
    that share a hash with another have a dictionary of their own. The table lives as long as the Python worker and
    holds about `most` words and `room` code points and numbers; when full it starts again, which costs time and
    changes no result.
    """

    def __init__(self, solve: Callable[[list[str]], list], most: int = 1 << 20, room: int = 1 << 23):
        self.solve, self.most, self.room = solve, most, room
        self.clear()

    def clear(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.slots = np.empty(0, np.int32)
        self.start = np.zeros(1 << 16, np.int32)
        self.size = np.zeros(1 << 16, np.int32)
        self.flat = np.zeros(1 << 18, np.int32)
        #: Code points of the words, one after the other, and where each word's begin.
        self.letters = np.zeros(1 << 18, np.uint32)
        self.spelt = np.zeros(1 << 16, np.int32)
        self.odd: dict[bytes, int] = {}
        self.count = self.used = self.written = 0

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.zeros(max(need, len(old) + (len(old) >> 1)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def _add(self, run: Layout, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Solves words and gives them slots."""
        rows = self.solve(run.words(starts, ends))
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        total = int(sizes.sum())
        fresh = np.arange(self.count, self.count + len(rows))
        lengths = ends - starts
        spelt = np.cumsum(lengths) - lengths
        letters = int(lengths.sum())
        for name, need in (("flat", self.used + total), ("start", self.count + len(rows)), ("size", self.count + len(rows)),
                           ("spelt", self.count + len(rows)), ("letters", self.written + letters)):
            self._room(name, need)
        self.flat[self.used : self.used + total] = np.fromiter((x for row in rows for x in row), np.int32, total)
        self.start[fresh] = self.used + np.cumsum(sizes) - sizes
        self.size[fresh] = sizes
        self.spelt[fresh] = self.written + spelt
        self.letters[self.written : self.written + letters] = codes[np.repeat(starts - spelt, lengths) + np.arange(letters)]
        self.used += total
        self.written += letters
        self.count += len(rows)
        return fresh

    def find(self, run: Layout, starts: np.ndarray, ends: np.ndarray, codes=None) -> np.ndarray:
        """The slot of every word."""
        if not len(starts):
            return np.empty(0, np.int64)
        codes = run.codes if codes is None else codes
        keys, where, back = np.unique(run.running(codes)(starts, ends), return_index=True, return_inverse=True)
        if self.count + len(keys) > self.most or self.used > self.room or self.written > self.room:
            self.clear()
        place = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == keys[inside]
        slots = np.empty(len(keys), np.int64)
        slots[known] = self.slots[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            fresh = self._add(run, codes, starts[where[new]], ends[where[new]])
            slots[new] = fresh
            self.keys = np.insert(self.keys, place[new], keys[new])
            self.slots = np.insert(self.slots, place[new], fresh)
        found = slots[back.ravel()]
        for i in np.flatnonzero(~self._spelt_as(codes, starts, ends, found)).tolist():
            word = codes[starts[i] : ends[i]].tobytes()
            if word not in self.odd:
                self.odd[word] = int(self._add(run, codes, starts[i : i + 1], ends[i : i + 1])[0])
            found[i] = self.odd[word]
        return found

    def _spelt_as(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, slots: np.ndarray) -> np.ndarray:
        """Whether each word has the code points of the word in its slot."""
        lengths = ends - starts
        after = np.where(slots + 1 < self.count, self.spelt[np.minimum(slots + 1, self.count - 1)], self.written)
        same = after - self.spelt[slots] == lengths
        at = np.cumsum(lengths) - lengths
        every = np.arange(int(lengths.sum()))
        held = np.repeat(np.where(same, self.spelt[slots], 0) - at, lengths) + every
        unlike = codes[np.repeat(starts - at, lengths) + every] != self.letters[np.minimum(held, self.written - 1)]
        if unlike.any():
            same &= np.add.reduceat(unlike, at) == 0
        return same

    def rows(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all words in order, and how many each word has."""
        sizes = self.size[slots].astype(np.int64)
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(self.start[slots] - (ends - sizes), sizes) + np.arange(total)
        return self.flat[take], sizes
