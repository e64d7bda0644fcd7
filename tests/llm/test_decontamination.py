"""Suffix-array search for benchmark passages against a search of every window in every text."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from plaintide.llm import decontamination
from plaintide.llm.byte_words import Chunks, Vocabulary, stretches


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items, window=10):
    windows = {}
    for name, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + size]), set()).add(name)
    answers = []
    for text in texts:
        words, hit, names = words_of(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(words) - size + 1):
                if tuple(words[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    names |= windows[tuple(words[i : i + size])]
        answers.append((len(words), len(hit), sorted(str(n) for n in names if n is not None), bool(hit)))
    return answers


def benchmark(spark, items):
    rows = [(i, t, 1, "x") for i, t in items]
    return spark.createDataFrame(rows, "item_id bigint, text string, doc_id int, spans string")


def random_tables(seed, n=40):
    r = random.Random(seed)
    some = ["a", "b", "éé", "cdefghijklmnop", "cdefghijklmnoq", "cdefghij", "7", "漢字"]
    def text(most):
        return "".join(r.choice(some) + r.choice([" ", ", ", "\n", "-"]) for _ in range(r.randrange(most)))
    return [text(80) for _ in range(n)], [(i // 2, text(14)) for i in range(12)]


def checked(spark, docs, texts, items, ids=None, **options):
    df = docs(*texts, ids=ids)
    got = decontamination.contamination(df, benchmark(spark, items), **options)
    rows = sorted((r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got.collect())
    assert rows == sorted(brute(texts, items, options.get("window", 10)))
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_every_window_in_every_text(spark, docs, seed):
    texts, items = random_tables(seed)
    texts += ["", None, texts[0], texts[0], "the " * 50]
    got = checked(spark, docs, texts, [*items, (99, "The the"), (98, None), (97, "--"), (None, texts[1])], window=4)
    spans = [(r.n_words, [(s.start, s.end) for s in r.spans]) for r in got.collect()]
    assert all(0 <= a < b <= n for n, own in spans for a, b in own)
    assert all(x[1] < y[0] for _, own in spans for x, y in zip(own, own[1:]))


def test_portions_of_the_benchmark_give_the_same(spark, docs):
    texts, items = random_tables(3)
    checked(spark, docs, texts, items, ids=[1] * 20 + [None] * 20, window=4, portion=200)
    dirty = decontamination.decontaminate(docs(*texts), benchmark(spark, items), window=4, portion=200)
    kept = decontamination.decontaminate(docs(*texts), benchmark(spark, items), window=4)
    clean = [i + 1 for i, a in enumerate(brute(texts, items, 4)) if not a[3]]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in dirty.collect()) == clean
    assert kept.columns == docs("x").columns and kept.filter("text IS NULL").count() == 0


def test_empty_tables(spark, docs):
    checked(spark, docs, ["a b c", None], [])
    assert decontamination.contamination(docs("a").limit(0), benchmark(spark, [(1, "a")])).count() == 0
    assert decontamination.decontaminate(docs("a b"), benchmark(spark, [])).count() == 1


def test_longest_matches(spark, docs):
    passage = " ".join(f"w{i}" for i in range(30))
    texts = [f"x y {passage}", "q " + " ".join(passage.split()[5:20]), passage, "nothing"]
    found = decontamination.longest_matches(docs(*texts), benchmark(spark, [(5, passage)]))
    rows = {r.item_word: (r.item_id, r.n_words, r.doc_id, r.doc_word) for r in found.collect()}
    assert rows == {i: ("5", 30 - i, 1, 2 + i) for i in range(21)}
    short = decontamination.longest_matches(docs(*texts[1:2]), benchmark(spark, [(5, passage)])).collect()
    assert sorted((r.item_word, r.n_words, r.doc_word) for r in short) == [(i, 20 - i, i - 4) for i in range(5, 11)]


def test_shards_of_a_long_text_are_searched_over_their_edges():
    r = random.Random(4)
    texts = [" ".join(r.choice("abc") for _ in range(3000)), "", " ".join(r.choice("abc") for _ in range(500))]
    items = [(str(i), " ".join(r.choice("abc") for _ in range(r.randrange(1, 12)))) for i in range(30)]
    tests = decontamination.TestSuffixes(items, 6)
    held = decontamination.Documents(pa.array(texts), tests)
    places, kinds = decontamination.occurrences(held, tests, 50)
    assert len(places) > 200 and len(places) == len(decontamination.occurrences(held, tests)[0])
    own = held.row_of(places)
    for k, answer in enumerate(brute(texts, items, 6)):
        hit = set()
        for p, n in zip(places[own == k] - held.first[k], tests.size[tests.kind_first[kinds[own == k]]]):
            hit |= set(range(int(p), int(p + n)))
        assert len(hit) == answer[1]


def test_long_words_and_stretches():
    inside = np.zeros(256, bool)
    inside[97:123] = True
    r = random.Random(5)
    texts = [" ".join("".join(r.choice("ab") for _ in range(r.randrange(1, 30))) for _ in range(40)) for _ in range(9)]
    texts += ["", None, "a" * 500, " "]
    want = [w.encode() for t in texts for w in (t or "").split()]
    wanted = sorted(set(want))[::2]
    vocabulary = Vocabulary(wanted)
    words, numbers, rows = [], [], []
    for part in stretches(pa.array(texts).slice(0), inside, 50):
        starts, lengths, owner = part.words(inside[part.data])
        words += [part.data[a : a + n].tobytes() for a, n in zip(starts, lengths)]
        numbers += vocabulary.numbers(Chunks(part.data), starts, lengths).tolist()
        rows += owner.tolist()
    assert words == want and rows == [i for i, t in enumerate(texts) for _ in (t or "").split()]
    assert [wanted[n - 1] if n else None for n in numbers] == [w if w in set(wanted) else None for w in want]
