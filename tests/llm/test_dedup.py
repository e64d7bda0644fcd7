"""Exact and near duplicates of texts and vectors against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from plaintide.llm import alignment, embedding_dedup, exact_dedup, heavy, links, order_minhash
from tests.llm.conftest import answers


def grouped(pairs, nodes):
    up = {n: n for n in nodes}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_heavy_hitters_hold_every_frequent_value(spark):
    r = random.Random(1)
    values = ["hot"] * 3000 + ["warm"] * 300 + [f"v{r.randrange(5000)}" for _ in range(6000)]
    r.shuffle(values)
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v string").repartition(7)
    found = {r.v for r in heavy.heavy_hitters(df, "v", 50).collect()}
    assert {v for v, n in Counter(values).items() if n >= len(values) / 50} <= found and len(found) <= 100
    assert heavy.heavy_hitters(df.limit(0), "v").count() == 0


def test_exact_duplicates(docs):
    texts = ["a b", "ab", " a\tb\n", "c", None, "", "  ", "x y", "xy", "a b"]
    ids = [7, 3, 5, 1, 8, 9, 4, 11, 12, 2]
    got = answers(exact_dedup.exact_duplicates(docs(*texts, ids=ids)), "keep_id", "group_size", "kept")
    assert {got[i][0] for i in (7, 3, 5, 2)} == {5} and got[5] == (5, 4, True) and got[7][2] is False
    assert got[8] == got[9] == (4, 3, False) and got[4] == (4, 3, True)
    assert got[11] == (11, 1, True) and got[12] == (12, 1, True)


def test_exact_duplicates_with_a_hot_text_and_ties(docs):
    texts = ["hot  text"] * 500 + [f"t{i % 400}" for i in range(1000)]
    got = exact_dedup.exact_duplicates(docs(*texts), most_heavy=5).toPandas()
    want = pd.DataFrame({"doc_id": range(1, 1501), "text": texts})
    assert got.set_index("doc_id").sort_index().keep_id.tolist() == want.groupby("text").doc_id.transform("min").tolist()
    assert got.kept.sum() == 401 and got.group_size.max() == 500


def test_repeated_rows_and_null_ids(docs):
    df = docs("a", "a", "a ", "b", "b", ids=[1, 1, 1, None, 2])
    got = exact_dedup.exact_duplicates(df).toPandas()
    assert sorted(got.kept.tolist()) == [False, False, False, True, True]
    kept = exact_dedup.drop_exact_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == [(1, "a "), (None, "b")]
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_components_of_any_shape(spark):
    r = random.Random(5)
    chain = [(i, i + 1) for i in range(60)]
    star = [(100, i) for i in range(101, 200)]
    loose = [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(60)]
    pairs = [*chain, *star, *loose, (7, 7)]
    got = answers(links.components(spark.createDataFrame(pairs, "a bigint, b bigint").repartition(3)), "component")
    nodes = {n for p in pairs if p[0] != p[1] for n in p}
    assert got == grouped([p for p in pairs if p[0] != p[1]], nodes)
    assert links.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_components_extended_by_links(spark):
    r = random.Random(6)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(60)]
    first = links.components(spark.createDataFrame(pairs[:30], "a bigint, b bigint"))
    got = answers(links.extended(first, spark.createDataFrame(pairs[30:], "a bigint, b bigint")), "component")
    heads = grouped([p for p in pairs if p[0] != p[1]], {n for p in pairs for n in p})
    assert all(heads[n] == c for n, c in got.items())
    assert {n for p in pairs if p[0] != p[1] for n in p} <= set(got)


def vectors_near(r, base, cosine):
    other = r.standard_normal(len(base))
    other -= other @ base * base / (base @ base)
    return cosine * base / np.linalg.norm(base) + np.sqrt(1 - cosine**2) * other / np.linalg.norm(other)


def test_vectors_equal_brute_force(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [r.standard_normal(16) for _ in range(150)]
    rows += [vectors_near(r, rows[i % 20], c) for i in range(150) for c in (0.91, 0.97)]
    hot = rows[0]
    rows += [vectors_near(r, hot, 0.99) for _ in range(250)] + [hot] * 5 + [hot * 1e200, hot * 1e-200]
    table = [(i, x.tolist(), 0, "z") for i, x in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] + [1.0] * 15, [float("inf")] * 16]
    table += [(1000 + i, v, 0, "z") for i, v in enumerate(odd)] + [(2000, [1.0, 0.0], 0, "z"), (2001, [2.0, 0.1], 0, "z")]
    monkeypatch.setattr(embedding_dedup, "PART", 40)
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<double>, label int, n_links string").repartition(5)
    got = answers(embedding_dedup.near_duplicate_vectors(df), "n_links", "component_id", "kept")
    unit = np.array([x / np.abs(x).max() for x in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    heads = grouped(np.argwhere(close).tolist(), range(len(rows)))
    for i in range(len(rows)):
        assert got[i] == (close[i].sum(), heads[i], heads[i] == i)
    for i in range(len(odd)):
        assert got[1000 + i] == (0, 1000 + i, True)
    assert got[2000] == (1, 2000, True) and got[2001] == (1, 2000, False)
    assert len(got) == len(table)


@pytest.mark.parametrize("crowd, part", [(0.8, 1024), (0.8, 150), (0.6, 1024)])
def test_pairs_in_a_crowd_of_unlinked_vectors(spark, monkeypatch, crowd, part):
    """A third of the vectors lie around one direction, too far apart for links but under the same hashes."""
    r = np.random.default_rng(5)
    topic = r.standard_normal(64)
    rows = [vectors_near(r, topic, np.sqrt(crowd)) for _ in range(1500)]
    rows += [vectors_near(r, rows[i], 0.92) for i in range(300)] + [vectors_near(r, topic, 0.99) for _ in range(200)]
    rows += [r.standard_normal(64) for _ in range(3000)]
    unit = np.array(rows) / np.linalg.norm(rows, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    heads = grouped(np.argwhere(np.triu(close)).tolist(), range(len(rows)))
    monkeypatch.setattr(embedding_dedup, "PART", part)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id bigint, embedding array<double>")
    got = answers(embedding_dedup.near_duplicate_vectors(df.repartition(4)), "n_links", "component_id", "kept")
    right = sum(got[i] == (close[i].sum(), heads[i], heads[i] == i) for i in range(len(rows)))
    linked = np.flatnonzero(close.any(1))
    met = sum(got[i][1] == heads[i] for i in linked)
    assert len(got) == len(rows) and met >= 0.99 * len(linked) and right >= 0.99 * len(rows)


@pytest.mark.parametrize("size", [1, 3, 64, 700])
def test_codes_bound_cosines(size):
    r = np.random.default_rng(size)
    rows = np.vstack([r.standard_normal((40, size)), r.standard_normal((20, size)) ** 9, np.eye(size)[:5]])
    rows = np.vstack([rows, rows[:30] + 0.3 * r.standard_normal((30, size))])
    codes, steps, off = embedding_dedup._codes(rows)
    packed = np.hstack([np.column_stack([steps, off]).view(np.int8), codes])
    values, far = embedding_dedup._decoded([p.tobytes() for p in packed])
    slack = far[:, None] + far[None, :] + np.outer(far, far) + (size + 12) * 2.0**-23
    assert (np.abs(values @ values.T - embedding_dedup._cosines(rows, rows)) <= slack).all()


def test_pairs_at_the_threshold_are_decided_in_doubles(spark):
    """Cosines closer to 0.9 than a byte a component can tell."""
    r = np.random.default_rng(9)
    rows = []
    for gap in [1e-3, -1e-3, 1e-5, -1e-5, 1e-9, -1e-9] * 10:
        base = r.standard_normal(32)
        rows += [base, vectors_near(r, base, 0.9 + gap) * 3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rows)], "vec_id bigint, embedding array<double>")
    got = answers(embedding_dedup.near_duplicate_vectors(df), "n_links", "component_id")
    for i in range(0, len(rows), 2):
        linked = i // 2 % 2 == 0
        assert got[i] == (linked, i) and got[i + 1] == (linked, i if linked else i + 1)


def test_vectors_repeated_rows_and_empty_table(spark):
    table = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0, 2.0]), (3, [-1.0, -2.0])]
    df = spark.createDataFrame(table, "vec_id bigint, embedding array<float>")
    found = embedding_dedup.near_duplicate_vectors(df).collect()
    assert sorted((r.n_links, r.component_id, r.kept) for r in found) == [(0, 3, True), (2, 1, False), (2, 1, True), (2, 1, True)]
    assert embedding_dedup.near_duplicate_vectors(df.limit(0)).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


@pytest.mark.parametrize("cells", [0, 1 << 22])
def test_alignment_equals_edit_distance(monkeypatch, cells):
    monkeypatch.setattr(alignment, "CELLS", cells)
    r = random.Random(6)
    for _ in range(400):
        a = [r.randrange(4) for _ in range(r.randrange(14))]
        b = [x for x in a if r.random() < 0.8] + [r.randrange(4) for _ in range(r.randrange(3))]
        want = edit_distance(a, b)
        for limit in (0, 1, 3, 20):
            assert alignment.distance_within(np.array(a, int), np.array(b, int), limit) == (want if want <= limit else None)


def corpus(r):
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    out = [[r.choice(words) for _ in range(r.randrange(60, 160))] for _ in range(60)]
    out += [x[:30] + passage + x[30:60] for x in out[:30]]
    near = []
    for i in range(90):
        copy = list(out[i % 15])
        for _ in range(2):
            copy[r.randrange(len(copy))] = r.choice(words)
        near.append(copy)
    return [" ".join(x) for x in out + near]


def test_near_duplicates_equal_brute_force(docs, monkeypatch):
    texts = corpus(random.Random(7)) + ["A  B c", "a b C", None, "", " \n", "one", "ä " * 4000, "ä " * 3900]
    got = answers(order_minhash.near_duplicates(docs(*texts).repartition(4)), "component_id", "group_size", "kept")
    words, _ = order_minhash.word_hashes([t or "" for t in texts])
    pairs = [
        (i + 1, j + 1) for i in range(len(texts)) for j in range(i)
        if (len(words[i]) and len(words[j]) and alignment.similar(alignment.Words(words[i].astype('<u4')), alignment.Words(words[j].astype('<u4')), 0.8)) or not len(words[i]) + len(words[j])
    ]
    heads = grouped(pairs, range(1, len(texts) + 1))
    sizes = Counter(heads.values())
    assert got == {i: (h, sizes[h], h == i) for i, h in heads.items()}


def test_buckets_left_open_are_compared_in_full(spark):
    """Two alike and one unlike text in a bucket; of two shared keys only the first counts."""
    passage = [f"p{i}" for i in range(40)]
    base = passage + [f"y{i}" for i in range(60)]
    texts = [passage + [f"x{i}" for i in range(60)], base, base[:70] + ["z"] * 12 + base[82:]]
    hashes, _ = order_minhash.word_hashes([" ".join(x) for x in texts])
    rows = [(k, 3, i, i, len(w), order_minhash.profile(h), [1, 5], h.astype("<u4").tobytes())
            for k in (1, 5) for i, (w, h) in enumerate(zip(texts, hashes))]
    table = spark.createDataFrame(rows, "key bigint, _rows bigint, cid bigint, component bigint, n_words bigint, "
                                        "profile binary, keys array<bigint>, words binary")
    assert [(x.a, x.b) for x in order_minhash._cross_links(table, 0.8).collect()] == [(1, 2)]


def test_near_duplicate_rows(docs):
    df = docs("a b c d e f g", "a b c d e f g", "a b c d e f g", "q", ids=[4, 4, None, 9])
    got = order_minhash.near_duplicates(df).collect()
    assert sorted((r.component_id, r.group_size, r.kept) for r in got) == [(4, 3, False), (4, 3, True), (4, 3, True), (9, 1, True)]
    kept = order_minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [4, 9]
    assert order_minhash.near_duplicates(df.limit(0)).count() == 0


def test_sketches_keep_order_and_repeats():
    words, _ = order_minhash.word_hashes(["a b c d e f g h i j k l m n o p", "i j k l m n o p a b c d e f g h", "a a a a a a a a"])
    first, turned, same = (order_minhash.sketches(w) for w in words)
    assert len(first) == order_minhash.SKETCHES and first == order_minhash.sketches(words[0])
    assert set(first) != set(turned)
    counts = defaultdict(int)
    for key in same:
        counts[key] += 1
    assert len(same) == order_minhash.SKETCHES and not order_minhash.sketches(words[0][:0])


def test_words_whose_sums_collide_are_no_duplicates(docs):
    def word(n, one, other):
        return "".join(other if bin(i).count("1") % 2 else one for i in range(n))

    texts = [word(n, *own) for n in (1024, 4096) for own in ("ab", "ba")] + ["x  y", " X y "]
    got = answers(order_minhash.near_duplicates(docs(*texts).coalesce(1)), "kept")
    assert got == {1: True, 2: True, 3: True, 4: True, 5: True, 6: False}
