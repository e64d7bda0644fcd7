import itertools
import math
import random
import re
from collections import Counter

import pytest

from plaintide.operators import components, skew, themes, vectors

SCHEMA = "issue_label string, text string, copies bigint, text_id bigint"


def terms_of(text, stop):
    words = [w for w in re.findall(r"\b\w\w+\b", text.lower()) if w not in stop]
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def unit_vectors(texts, stop=()):
    """TF-IDF of {id: text} by hand."""
    counts = {i: Counter(terms_of(t, stop)) for i, t in texts.items()}
    holding = Counter(term for c in counts.values() for term in c)
    result = {}
    for i, c in counts.items():
        raw = {t: n * (math.log((1 + len(texts)) / (1 + holding[t])) + 1) for t, n in c.items()}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        result[i] = {t: w / norm for t, w in raw.items()}
    return result


def components_by_hand(texts, stop=()):
    found = unit_vectors(texts, stop)
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        if sum(w * found[b].get(t, 0.0) for t, w in found[a].items()) >= 0.45:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: find(i) for i in texts}


def random_texts(seed, n, vocabulary, words):
    rng = random.Random(seed)
    return {i * 3 + 1: " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(0, words)))
            for i in range(n)}


@pytest.mark.parametrize("small_blocks", [False, True])
def test_themes_equal_all_pairs(spark, monkeypatch, small_blocks):
    """Also with tiny limits, so that every key is hot and every bucket is split."""
    if small_blocks:
        monkeypatch.setattr(themes, "BLOCK", 2)
        monkeypatch.setattr(skew, "HOT_ROWS", 1)
        monkeypatch.setattr(skew, "HOT_SHARE", 0.01)
        monkeypatch.setattr(themes, "SEGMENT", 1)
        monkeypatch.setattr(themes, "ROUND_PAIRS", 20)
    groups = {"x": random_texts(1, 40, 25, 6), "y": random_texts(2, 30, 8, 4)}
    rows, expected = [], {}
    for offset, (label, texts) in enumerate(groups.items()):
        texts = {i + 1000 * offset: t for i, t in texts.items()}
        rows += [(label, t, 1, i) for i, t in texts.items()]
        expected |= components_by_hand(texts)
    found = themes.theme_members(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.text_id: r.theme_id for r in found} == expected


def test_pieces_hold_every_term_once(spark, monkeypatch):
    monkeypatch.setattr(themes, "SEGMENT", 3)
    rows = [(1, i, 1 / (i + 1)) for i in range(100)] + [(2, i, 0.5) for i in (7, 5, 9)] + [(3, i, 0.5) for i in range(4)]
    found = themes.segments(spark.createDataFrame(rows, "text_id int, place bigint, weight double")).collect()
    for text in (1, 2, 3):
        own = sorted((r for r in found if r.text_id == text), key=lambda r: r.seg)
        want = sorted((p, w) for t, p, w in rows if t == text)
        assert [(e.place, e.weight) for r in own for e in r.entries] == want
        assert [len(r.entries) for r in own[:-1]] == [3, 12, 48][: len(own) - 1] and len(own[-1].entries) > 0
        for r in own:
            assert r.until == r.entries[-1].place and r.more == (r is not own[-1])
            assert r.ahead == pytest.approx(sum(w * w for p, w in want if p > r.until))


def test_first_terms_settle_most_pairs(spark):
    """Candidates grow slower than the square of a term's texts: rows that reach no other component go."""
    def texts(n):
        rng = random.Random(n)
        return {i: f"shared word {' '.join(f'own{i}x{k}' for k in range(rng.randint(6, 12)))}" for i in range(n)}

    for n in (50, 100):
        df = spark.createDataFrame([("x", t, 1, i) for i, t in texts(n).items()], SCHEMA)
        postings = themes.prefix_postings(vectors.text_weights(df, []))
        none = spark.createDataFrame([], "node bigint, component bigint")
        assert themes.possible_rows(postings, none, 10_000).count() == 0


def test_chain_and_loner(spark):
    texts = {1: "red apple pie", 2: "red apple pie with cream cake", 3: "cream cake sold", 9: "nothing alike"}
    rows = [("x", t, 1, i) for i, t in texts.items()]
    stop = ["with"]
    expected = components_by_hand(texts, stop)
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.text_id: r.theme_id for r in themes.theme_members(df, stop).collect()} == expected
    assert expected[9] == 9


def test_largest_themes(spark):
    rows = [("x", "late parcel again", 4, 1), ("x", "parcel late again", 6, 2), ("x", "rude agent", 3, 3),
            ("x", "broken lid", 2, 4), ("x", "wet box", 1, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = themes.themes(df, themes.theme_members(df)).orderBy("theme").collect()
    sizes = [(r.theme, r.example, r["count"]) for r in found]
    assert sizes[0] == (1, "parcel late again", 10)
    assert len(sizes) == 3
    arrays = themes.themes_array(themes.themes(df, themes.theme_members(df))).first()
    assert arrays.themes[0].example == "parcel late again"


def test_components_of_a_long_path_and_a_star(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 5)
    monkeypatch.setattr(skew, "HOT_SHARE", 0.05)
    path = [(i, i + 1) for i in range(100, 140)]
    star = [(1, i) for i in range(2, 60)]
    links = spark.createDataFrame(path + star, "a bigint, b bigint")
    found = {r.node: r.component for r in components.connected_components(links).collect()}
    assert {found[i] for i in range(100, 141)} == {100}
    assert {found[i] for i in range(1, 60)} == {1}


def test_top_terms_skip_contained_ones(spark):
    rows = [("x", "late parcel", 5, 1), ("x", "late parcel again today", 2, 2)]
    ranked = vectors.ranked_terms(spark.createDataFrame(rows, SCHEMA), [])
    keywords = vectors.top_terms(ranked).first().keywords
    assert len(keywords) <= 4
    assert not any(a in b for a, b in itertools.permutations(keywords, 2))


def test_vocabulary_limit_by_corpus_count(spark):
    rows = [("x", "aa bb", 3, 1), ("x", "cc", 1, 2)]
    ranked = vectors.ranked_terms(spark.createDataFrame(rows, SCHEMA), [], vocabulary=2)
    assert sorted(r.term for r in ranked.collect()) == ["aa", "aa bb"]


def test_lookup_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 10)
    monkeypatch.setattr(skew, "HOT_SHARE", 0.1)
    big = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k int, v int")
    table = spark.createDataFrame([(i, -i) for i in range(300)], "k int, w int")
    found = skew.lookup(big, table, ["k"], 300).collect()
    assert len(found) == 300 and all(r.w == -r.k for r in found)


def test_prefixes_are_summed_once_a_term(spark):
    """A frame that ends at the last row is summed anew for every row: quadratic in the terms of a text."""
    rows = [("x", 1, f"t{i}", 0.1, 1, i) for i in range(50)]
    weights = spark.createDataFrame(rows, "issue_label string, text_id int, term string, weight double, holding int, place int")
    found = themes.prefix_postings(weights)
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert {r.term: round(r.rest, 9) for r in found.collect()} == {f"t{i}": round(0.01 * (49 - i), 9) for i in range(30)}


def test_pieces_are_met_without_maps(spark):
    """Products and what lies ahead, against loops; maps of every pair's pieces took most of the time."""
    rng = random.Random(3)
    rows = [(i, p, rng.random()) for i in range(12) for p in sorted(rng.sample(range(40), rng.randint(1, 25)))]
    vectors_of = {i: {p: w for t, p, w in rows if t == i} for i in range(12)}
    pieces = themes.segments(spark.createDataFrame(rows, "text_id int, place bigint, weight double"))
    pairs = list(itertools.combinations(range(12), 2))
    found = themes.similar(spark.createDataFrame(pairs, "a int, b int"), pieces, 0.0)
    assert "map_zip_with" not in found._jdf.queryExecution().toString().lower()
    want = {(a, b): sum(w * vectors_of[b].get(p, 0.0) for p, w in vectors_of[a].items()) for a, b in pairs}
    assert {(r.a, r.b): round(r.cosine, 9) for r in found.collect()} == {k: round(v, 9) for k, v in want.items()}


@pytest.mark.parametrize("few", [0, 1000])
def test_components_of_random_links(spark, monkeypatch, few):
    """In Spark's rounds and without them; loops and nulls are no links, and repeated ones count once."""
    monkeypatch.setattr(components, "FEW_LINKS", few)
    rng = random.Random(few)
    links = [(rng.randrange(200) * 5 - 300, rng.randrange(200) * 5 - 300) for _ in range(110)]
    path = [(2000 + (i * 37) % 101, 2000 + ((i + 1) * 37) % 101) for i in range(100)]
    rows = links + path + links[:9] + [(7777, 7777), (None, 3), (3, None)]
    found = components.connected_components(spark.createDataFrame(rows, "a bigint, b bigint")).collect()
    root = {n: n for pair in links + path for n in pair if pair[0] != pair[1]}
    for _ in root:
        for a, b in links + path:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.component for r in found} == root and len(found) == len(root)


def test_few_links_need_no_rounds(spark, monkeypatch):
    """A table of links was written twice a round, in rounds by the length of the longest path."""
    written = []
    cut = components.cut_lineage
    monkeypatch.setattr(components, "cut_lineage", lambda df: written.append(1) or cut(df))
    path = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert {r.component for r in components.connected_components(path).collect()} == {0}
    assert len(written) == 2
    none = components.connected_components(path.limit(0))
    assert none.count() == 0 and none.columns == ["node", "component"]


def test_terms_of_one_text_count_in_its_length_only(spark):
    """They were sorted, joined and shipped with the others, though they add to no product."""
    texts = {1: "red apple pie pie", 2: "red apple tart", 3: "lone words only"}
    df = spark.createDataFrame([("x", t, 1, i) for i, t in texts.items()], SCHEMA)
    found = {(r.text_id, r.term): r.weight for r in vectors.text_weights(df, []).collect()}
    want = {(i, t): w for i, v in unit_vectors(texts).items() for t, w in v.items() if i < 3 and t in ("red", "apple", "red apple")}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(w) for k, w in want.items())


@pytest.mark.parametrize("spread", [1, 1 << 44])
def test_sketches_lose_no_similar_pair(spread, spark):
    """Long texts share buckets; pairs far below the threshold go without their vectors being shipped."""
    rng = random.Random(spread)
    rows = []
    for i in range(12):
        places = rng.sample(range(3000), 2500) if i < 3 else rng.sample(range(300), rng.randint(1, 60))
        raw = {p: rng.random() ** 3 + 1e-6 for p in places}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        rows += [(i, p * spread, w / norm) for p, w in raw.items()]
    rows += [(20, 5 * spread, 1.0), (21, 5 * spread, 1.0), (22, 6 * spread, 1.0)]
    vectors_of = {}
    for i, p, w in rows:
        vectors_of.setdefault(i, {})[p] = w
    pieces = themes.packed(themes.segments(spark.createDataFrame(rows, "text_id int, place bigint, weight double")))
    pairs = list(itertools.combinations(vectors_of, 2))
    cosine = {(a, b): sum(w * vectors_of[b].get(p, 0.0) for p, w in vectors_of[a].items()) for a, b in pairs}
    found = themes.possible_pairs(spark.createDataFrame(pairs, "a int, b int"), themes.sketches(pieces), 0.3).collect()
    left = {(r.a, r.b) for r in found}
    assert left >= {p for p, c in cosine.items() if c >= 0.3} and (20, 21) in left and (20, 22) not in left
    assert len(left) < len(pairs) / 2 and len(found) == len(left)
