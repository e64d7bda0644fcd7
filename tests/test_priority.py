import pytest
from pyspark.sql import functions as F

from plaintide.functions.priority import classify_priority
from plaintide.operators import scoring

SCHEMA = ("sentiment string, emotion string, is_complaint boolean, detected_issue string, feedback string, "
          "rating string")


@pytest.mark.parametrize("score, expected", [(12, "HIGH"), (7, "HIGH"), (6, "MEDIUM"), (4, "MEDIUM"), (3, "LOW"), (0, "LOW")])
def test_thresholds(spark, score, expected):
    assert spark.range(1).select(classify_priority(F.lit(score))).first()[0] == expected


@pytest.mark.parametrize(
    "row, score, reasons",
    [
        (("Negative", "Neutral", False, "General Feedback", "", None), 3, ["Negative sentiment (Negative)"]),
        (("Neutral", "Neutral", False, "", "", "5"), 1, ["Negative sentiment (Neutral)"]),
        (("Positive", "Happy", False, "", "", "3"), 1, []),
        (("Positive", "Happy", False, "", "", "0"), 2, ["Very low rating (0.0)"]),
        (("Positive", "Happy", False, "", "", "NaN"), 0, []),
        (("Positive", "Happy", False, "", "", "bad"), 0, []),
        (
            ("Negative", "Angry", True, "Delivery Delay", "URGENT, unacceptable, broken; want refund", "1"),
            3 + 4 + 2 + 2 + 3 + 1 + 2,
            ["Negative sentiment (Negative)", "Strong negative emotion (Angry)", "Complaint detected",
             "High-impact issue type (Delivery Delay)", "Urgency signals: urgent, broken",
             "Business impact signals: refund", "Very low rating (1.0)"],
        ),
    ],
)
def test_scores_and_reasons(spark, row, score, reasons):
    found = scoring.score_priority(spark.createDataFrame([row], SCHEMA), "feedback").first()
    assert (found.priority_score, found.priority_reasons) == (score, reasons)


def test_missing_columns_score_nothing(feedback):
    row = scoring.score_priority(feedback("a quiet text"), "feedback").first()
    assert (row.priority_score, row.priority) == (1, "LOW")
