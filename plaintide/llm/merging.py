"""Byte-pair merging of one word: a heap of merge ranks over a linked list of symbols."""

from __future__ import annotations

import json
from functools import lru_cache
from heapq import heapify, heappop, heappush


def merge(symbols: list, rank_of, join) -> list:
    """Merges neighbours in `symbols`, the lowest rank first, then the leftmost, until none can.

    `rank_of(a, b)` gives a rank or None, `join(a, b)` the merged symbol. A pair's entry goes stale when
    one of its symbols has been merged away or changed; the rank at its place then differs, and it is
    skipped. `symbols` is overwritten; merged-away places become None.
    """
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(rank, i) for i in range(n - 1) if (rank := rank_of(symbols[i], symbols[i + 1])) is not None]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        left = symbols[i]
        if left is None or (j := after[i]) >= n or rank_of(left, symbols[j]) != rank:
            continue
        symbols[i] = made = join(left, symbols[j])
        symbols[j] = None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (rank := rank_of(made, symbols[k])) is not None:
                heappush(heap, (rank, i))
        if (h := before[i]) >= 0 and (rank := rank_of(symbols[h], made)) is not None:
            heappush(heap, (rank, h))
    return [x for x in symbols if x is not None]


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (published rule)."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(moved)) for b in range(256)]


class ByteMerges:
    """Vocabulary and merge ranks of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        vocabulary = content["model"]["vocab"]
        letters = byte_alphabet()
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.of_byte = [vocabulary[letter] for letter in letters]
        self.special = {x["content"]: x["id"] for x in content["added_tokens"]}
        self.strings = [b""] * (1 + max([*vocabulary.values(), *self.special.values()]))
        for token, i in vocabulary.items():
            if token not in self.special:
                self.strings[i] = bytes(byte_of[letter] for letter in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        self.rank, self.made = {}, {}
        for rank, pair in enumerate(content["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            key = vocabulary[a], vocabulary[b]
            self.rank[key], self.made[key] = rank, vocabulary[a + b]

    def encode_word(self, word: str) -> list[int]:
        symbols = [self.of_byte[b] for b in word.encode("utf-8", "surrogatepass")]
        rank, made = self.rank.get, self.made
        return merge(symbols, lambda a, b: rank((a, b)), lambda a, b: made[a, b])

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(2)
def byte_merges(path: str) -> ByteMerges:
    return ByteMerges(path)
