import pytest
from pyspark.sql import functions as F

from plaintide.operators import issues, scoring


def emotion_of(df):
    row = scoring.detect_emotion(df, "feedback").first()
    return row.emotion, row.emotion_confidence


@pytest.mark.parametrize(
    "text, expected",
    [
        ("ok", ("Neutral", 50.0)),
        (" a ", ("Neutral", 50.0)),
        (None, ("Neutral", 50.0)),
        ("it is a box", ("Neutral", 55.0)),
        ("I am furious", ("Angry", 95.0)),
        ("so furious but happy", ("Angry", 77.0)),
        ("fantastic but furious", ("Happy", 80.0)),
        ("not happy", ("Disappointed", 82.7)),
        ("I’m not sure", ("Confused", 95.0)),
        ("still  waiting", ("Frustrated", 95.0)),
        ("still, waiting", ("Neutral", 55.0)),
        ("happyish", ("Neutral", 55.0)),
        ("frustratingly", ("Frustrated", 95.0)),
        ("rated 10/10", ("Happy", 95.0)),
        ("rated 10/100", ("Neutral", 55.0)),
    ],
)
def test_detect_emotion(feedback, text, expected):
    assert emotion_of(feedback(text)) == expected


def test_boost_looks_at_the_first_word_that_starts_alike(feedback):
    found = scoring.emotion_keyword_hits(feedback("very workshop works", "works very works"), "feedback")
    assert [r.boosted_satisfied for r in found.orderBy("feedback_id").collect()] == [1.5, 1.0]


def test_reconciled_with_sentiment(spark):
    rows = [("Negative", "so happy"), ("Positive", "so furious"), ("Positive", "it is a box"),
            ("Neutral", "happy yet furious and unclear"), ("Neutral", "happy"), ("Negative", "furious")]
    df = spark.createDataFrame(rows, "sentiment string, feedback string")
    found = [(r.emotion, r.emotion_confidence) for r in scoring.score_emotion(df, "feedback").collect()]
    assert found == [("Disappointed", 60.0), ("Satisfied", 60.0), ("Satisfied", 60.0),
                     ("Angry", 66.9), ("Happy", 95.0), ("Angry", 95.0)]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("it is a box", ("Other", 50.0)),
        ("my parcels were late", ("Delivery", 95.0)),
        ("charged twice", ("Payment", 95.0)),
        ("unhappy quiteapp", ("Other", 50.0)),
        ("haven’t received", ("Delivery", 95.0)),
        ("order confirmation", ("Payment", 95.0)),
        ("any follow-ups?", ("Customer Support", 95.0)),
        ("late refund", ("Refund", 83.8)),
        ("late color", ("Delivery", 72.5)),
    ],
)
def test_detect_topic(feedback, text, expected):
    row = scoring.detect_topic(feedback(text), "feedback").first()
    assert (row.topic_detected, row.topic_confidence) == expected


def test_given_category_wins(spark):
    rows = [("late refund", " Billing "), ("late refund", "  "), ("late refund", None), ("late refund", "NaN")]
    df = spark.createDataFrame(rows, "feedback string, kind string")
    scored = scoring.score_topic(df, "feedback", "kind")
    assert [r.topic for r in scored.collect()] == ["Billing", "Refund", "Refund", "Refund"]
    agreement = issues.topic_agreement(scored).first()
    assert (agreement.compared, agreement.agreed) == (1, 0)


def test_scores_do_not_depend_on_partitions_and_keep_rows(feedback):
    texts = ["late refund", "so happy", "it is a box", "not worth the price"] * 25
    df = feedback(*texts)
    once = scoring.score_all(df.repartition(1), "feedback").drop("priority_reasons")
    many = scoring.score_all(df.repartition(9), "feedback").drop("priority_reasons")
    assert once.count() == 100
    assert sorted(map(str, once.collect())) == sorted(map(str, many.collect()))


def test_all_scorers_at_once_equal_one_by_one(spark):
    rows = [(1, "late refund, so rude", 2.0, "Billing"), (2, "so happy", None, None), (3, "not worth it", 3.0, " ")]
    df = spark.createDataFrame(rows, "feedback_id int, feedback string, rating double, kind string")
    chain = scoring.score_sentiment(df, "feedback", "rating")
    chain = scoring.score_topic(scoring.score_emotion(chain, "feedback"), "feedback", "kind")
    chain = scoring.score_priority(scoring.score_issue(chain, "feedback"), "feedback")
    together = scoring.score_all(df, "feedback", "rating", "kind").select(*chain.columns)
    assert sorted(map(str, chain.collect())) == sorted(map(str, together.collect()))


def test_filter_on_a_label_scores_once(feedback):
    scored = scoring.score_all(feedback("late refund"), "feedback")
    plan = scored.filter(F.col("topic") == "Refund")._jdf.queryExecution().optimizedPlan().toString()
    whole = scored._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") <= whole.count("RLIKE")


def test_columns_of_the_same_name_are_replaced(spark):
    schema = "feedback_id int, feedback string, topic string, priority string, emotion string"
    df = spark.createDataFrame([(1, "late refund", "Billing", "P1", "sad")], schema)
    row = scoring.score_all(df, "feedback", category="topic").first()
    assert (row.topic, row.topic_source, row.topic_detected) == ("Billing", "dataset", "Refund")
    assert row.priority in {"HIGH", "MEDIUM", "LOW"} and row.emotion == "Disappointed"
    again = scoring.reconcile_emotion(scoring.detect_emotion(df.selectExpr("*", "'Negative' AS sentiment"), "feedback"))
    assert again.first().emotion == "Disappointed"


def test_work_is_skipped_only_where_it_changes_nothing(spark):
    """Sums over tokens run where a text has one; words of ASCII texts are found without Unicode's classes."""
    from plaintide.functions import emotion, lexicon, text, topic
    from pyspark.sql import functions as F

    for group in (*topic.GROUPS.values(), *emotion.GROUPS.values()):
        assert "exists(" in str(group.weighted_hits()) and "exists(" in str(group.boosted_hits(emotion.boost))
    given = ["plain words, it's", "café naïve ٣_x", "  tab\there \x07 ", "", None, "a b", "x  y", "wow!!! (great) 'tis"]
    df = spark.createDataFrame([(t,) for t in given], "t string")
    unicode = F.regexp_extract_all("t", F.lit(text.WORD_OR_APOSTROPHE), F.lit(0))
    cleaned = F.coalesce(F.trim(F.regexp_replace("t", r"(?U)[\s\x00-\x1f\x7f]+", " ")), F.lit(""))
    facts = lexicon.word_facts(F.split("t", " "), F.transform(F.split("t", " "), lambda w: F.lit(None).cast("double")))
    for row in df.select(
        text.tokens(F.col("t"), text.WORD_OR_APOSTROPHE).alias("a"), unicode.alias("b"),
        text.clean_text(F.col("t")).alias("c"), cleaned.alias("d"), facts.alias("e"), "t",
    ).collect():
        assert row.a == row.b and row.c == row.d and row.e == (None if row.t is None else [])
