"""Spelling variants against all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from plaintide.llm import spelling_variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counts(rows, letters, least, slip):
    found = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            if slip and h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= letters:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= least}


def brute(rows, letters=6, least=5, times=5, slip=None):
    words = counts(rows, letters, least, slip)
    best, many = {}, {}
    for w in words:
        around = [v for v in words if near(w, v)]
        many[w] = len(around)
        if around and max(words[v] for v in around) >= times * words[w]:
            best[w] = min(around, key=lambda v: (-words[v], v))
    def root(w):
        return root(best[w]) if w in best else w
    return {(w, best.get(w), root(w), n, many[w], words.get(best.get(w))) for w, n in words.items()}


def random_rows(seed, alphabet="abé", n=60):
    r = random.Random(seed)
    bases = ["".join(r.choice(alphabet) for _ in range(r.choice([3, 4, 5, 9, 17]))) for _ in range(12)]
    def word():
        w = list(r.choice(bases[: r.randrange(1, 12)]))
        if r.random() < 0.4:
            w[r.randrange(len(w))] = r.choice([*alphabet, "", "ab", "B"])
        return "".join(w)
    return [(i // 2, " ".join(word() for _ in range(40))) for i in range(n)]


@pytest.mark.parametrize(("block", "slip"), [(1024, None), (4, 3), (2, 199)])
def test_against_all_pairs(docs, monkeypatch, block, slip):
    monkeypatch.setattr(spelling_variants, "BLOCK", block)
    monkeypatch.setattr(spelling_variants, "TILE", 2 * block)
    rows = [*random_rows(block), (None, "abéab " * 9), (3, None), (4, ""), (5, "x" * 90 + " "), (None, "€ÿÿÿ×÷À " * 7)]
    rows += [(i, "y" * 70 + "z" * (i % 2) + " " + "y" * 69) for i in range(20)]
    df = docs(*[t for _, t in rows], ids=[i for i, _ in rows])
    got = spelling_variants.spelling_variants(df, letters=3, least=2, times=2, slip=slip)
    want = brute(rows, 3, 2, 2, slip)
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == want
    assert any(w[1] and w[1] != w[2] for w in want) and got.count() == len(want)


def test_ties_and_chains(docs):
    texts = ["abcdef " * 5, "abcdeg " * 25, "abcdex " * 25, "abcdeyx " * 125, "abcdeyxx " * 625, "Abcdeyxx " * 5]
    got = {r.word: (r.form, r.root, r.n, r.n_near) for r in spelling_variants.spelling_variants(docs(*texts)).collect()}
    assert got["abcdef"] == ("abcdeg", "abcdeg", 5, 2) and got["abcdeyxx"] == (None, "abcdeyxx", 630, 1)
    assert got["abcdex"] == ("abcdeyx", "abcdeyxx", 25, 3) and got["abcdeg"] == (None, "abcdeg", 25, 2)


def test_empty_tables(docs):
    assert spelling_variants.spelling_variants(docs("a").limit(0)).count() == 0
    assert spelling_variants.spelling_variants(docs("short wor", None)).count() == 0


def test_word_table_is_sent_on_in_parts(docs, monkeypatch):
    monkeypatch.setattr(spelling_variants, "HELD", 3)
    rows = random_rows(9)
    df = docs(*[t for _, t in rows], ids=[i for i, _ in rows])
    got = {r.word: r.n for r in spelling_variants.word_counts(df, letters=2, least=1).collect()}
    assert got == counts(rows, 2, 1, None)
