import math
import re

import pytest
from pyspark.sql import functions as F

from plaintide.functions import lexicon as lex
from plaintide.functions import sentiment as sen
from plaintide.operators import scoring
from plaintide.operators import lexicon as lexicon_operators
from plaintide.operators.lexicon import with_compound
from plaintide.rules import lexicon as rules


def test_rating_labels(spark):
    values = ["0", "1", "2", "2.5", "3", "3.9", "4", "5", "6", "NaN", "good", None]
    df = spark.createDataFrame([(v,) for v in values], "r string")
    found = [r[0] for r in df.select(sen.rating_to_sentiment(F.col("r"))).collect()]
    assert found == [None, "Negative", "Negative", "Neutral", "Neutral", "Neutral", "Positive", "Positive",
                     None, None, None, None]


@pytest.mark.parametrize(
    "text, label, confidence",
    [
        ("I love this product! It is excellent and amazing.", "Positive", 65.0),
        ("The product is terrible and I hate it. Worst purchase ever.", "Negative", 65.0),
        ("good good bad", "Neutral", 60.0),
        ("   ", "Neutral", 50.0),
        (None, "Neutral", 50.0),
    ],
)
def test_text_sentiment(feedback, text, label, confidence):
    row = scoring.score_sentiment(feedback(text), "feedback").first()
    assert (row.sentiment, row.sentiment_confidence, row.sentiment_source) == (label, confidence, "text")


def test_rating_wins_and_provided_labels_stay(spark):
    rows = [(1, "great and easy", 5.0, "Positive"), (2, "great and easy", 1.0, "Positive"),
            (3, "great and easy", 9.0, None)]
    df = spark.createDataFrame(rows, "feedback_id int, feedback string, rating double, sentiment string")
    scored = scoring.score_sentiment(df, "feedback", "rating").orderBy("feedback_id")
    found = [(r.sentiment, r.sentiment_confidence, r.sentiment_source) for r in scored.collect()]
    assert found == [("Positive", 95.0, "rating"), ("Negative", 80.0, "rating"), ("Positive", 65.0, "text")]
    agreement = scoring.sentiment_agreement(scored).first()
    assert (agreement.compared, agreement.agreement) == (2, 0.5)


def test_compound_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(x / 50,) for x in range(-50, 51)], "c double")
    for row in df.select("c", sen.compound_to_probabilities(F.col("c")).alias("p")).select("c", "p.*").collect():
        assert math.isclose(row.negative + row.neutral + row.positive, 1.0)
        assert min(row.negative, row.neutral, row.positive) > 0
        if row.c >= 0.05:
            assert row.positive > max(row.negative, row.neutral)


def test_ensemble_falls_back(spark):
    df = spark.range(1)
    m, x, k = sen.probabilities(1.0, 0.0, 0.0), sen.probabilities(0.0, 1.0, 0.0), sen.probabilities(0.0, 0.0, 1.0)
    none = F.when(F.lit(False), m)

    def mixed(a, b):
        return tuple(df.select(sen.ensemble_probabilities(a, b, k).alias("p")).select("p.*").first())

    assert mixed(m, x) == (0.7, 0.3, 0.0)
    assert mixed(none, x) == (0.0, 1.0, 0.0)
    assert mixed(m, none) == (1.0, 0.0, 0.0)
    assert mixed(none, none) == (0.0, 0.0, 1.0)


def by_hand(text, lexicon):
    """The valence rules once more, word by word."""
    punctuation = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    words = []
    for word in text.split():
        inner = re.sub(rf"^[{punctuation}]+|[{punctuation}]+$", "", word)
        words.append(word if len(inner) <= 2 else inner)
    capitals = sum(w.isupper() for w in words)
    mixed = 0 < capitals < len(words)
    total = 0.0
    lower = [w.lower() for w in words]
    for i, word in enumerate(lower):
        value = 0.0 if word in rules.DEGREE_WORDS else lexicon.get(word, 0.0)
        if not value:
            continue
        value += math.copysign(rules.CAPS_BOOST, value) if words[i].isupper() and mixed else 0.0
        for distance in (1, 2, 3):
            j = i - distance
            if j < 0 or lower[j] in lexicon:
                continue
            if lower[j] in rules.DEGREE_WORDS:
                push = rules.DEGREE_WORDS[lower[j]] * rules.BOOSTER
                push += rules.CAPS_BOOST if words[j].isupper() and mixed else 0.0
                value += math.copysign(1, value) * push * lex.DISTANCE_SCALE[distance - 1]
            if lower[j] in rules.NEGATION_WORDS or "n't" in lower[j]:
                value *= rules.NEGATION_SCALE
        if "but" in lower:
            at = lower.index("but")
            value *= 0.5 if i < at else 1.5 if i > at else 1.0
        total += value
    marks = min(text.count("!"), 4) * 0.292
    questions = text.count("?")
    marks += 0.96 if questions > 3 else questions * 0.18 if questions > 1 else 0.0
    total += math.copysign(marks, total) if total else 0.0
    return total / math.sqrt(total * total + 15)


def test_lexicon_against_word_by_word_rules(feedback):
    texts = [
        "The product is good.", "The product is not good!", "It is VERY good but slow???", "GREAT value",
        "so very really good", "never so slow", "somewhat helpful, hardly fast", "isn't bad", "nothing",
        "a scam!!!!! worst refund ever", "EXTREMELY bad service", "good but not reliable", "",
    ]
    lexicon = lex.seed_lexicon()
    scored = with_compound(feedback(*texts), "feedback").orderBy("feedback_id").collect()
    for row in scored:
        assert row.compound == pytest.approx(by_hand(row.feedback, lexicon), abs=6e-5), row.feedback


LEXICON_TEXTS = ["The product is good.", "not GOOD at all!!", "w7 w19999 but w20000", "W5 w5 but never w6", "", None, "unknown words only",
                 "so w3, hardly w4???"]


def test_large_lexicons_score_as_small_ones_do(spark, feedback, monkeypatch):
    lexicon = {f"w{i}": (i % 9 - 4) / 2 for i in range(20_001)} | {"good": 1.9}
    want = {t: by_hand(t, lexicon) for t in LEXICON_TEXTS if t}
    table = spark.createDataFrame([*lexicon.items(), ("good", None), (None, 1.0), ("w3", 9.0)], "word string, valence double")
    df = feedback(*LEXICON_TEXTS)
    for given, bound in ((lexicon, None), (table, None), (table, 0)):
        if bound is not None:
            monkeypatch.setattr(lexicon_operators, "BROADCAST_BYTES", bound)
        found = {r.feedback: r.compound for r in with_compound(df, "feedback", given).collect()}
        assert len(found) == len(LEXICON_TEXTS) and found[None] is None
        for text, score in want.items():
            assert found[text] == pytest.approx(score, abs=6e-5), text
    monkeypatch.undo()
    plans = [len(with_compound(df, "feedback", {f"w{i}": 1.0 for i in range(n)})._jdf.queryExecution().optimizedPlan().toString())
             for n in (1_000, 100_000)]
    assert abs(plans[0] - plans[1]) < 100


def test_empty_lexicon(spark, feedback):
    empty = spark.createDataFrame([], "word string, valence double")
    assert [r.compound for r in with_compound(feedback("good", "", None), "feedback", empty).orderBy("feedback_id").collect()] == [0.0, 0.0, None]
