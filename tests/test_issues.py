import random
import re
from re import _constants as c
from re import _parser

import pytest

from plaintide import ColumnRoles
from plaintide.operators import issues, recurring, scoring
from plaintide.rules.issue import ISSUE_HINTS, ISSUE_PATTERNS


def sample(pattern, rng):
    """A random text that the parsed pattern matches."""
    out = []
    for op, arg in pattern:
        if op is c.LITERAL:
            out.append(chr(arg))
        elif op is c.ANY:
            out.append(rng.choice("ab '"))
        elif op is c.BRANCH:
            out.append(sample(rng.choice(arg[1]), rng))
        elif op is c.SUBPATTERN:
            out.append(sample(arg[-1], rng))
        elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
            low, high, inner = arg
            out += [sample(inner, rng) for _ in range(rng.randint(low, min(high, low + 3)))]
        elif op is c.IN:
            kind = arg[0][1]
            out.append(rng.choice("0123456789" if kind is c.CATEGORY_DIGIT else "abz"))
        elif op is not c.AT:
            raise AssertionError(op)
    return "".join(out)


@pytest.mark.parametrize("label", ISSUE_PATTERNS)
def test_every_match_holds_a_hint(label):
    rng = random.Random(7)
    parsed = _parser.parse(ISSUE_PATTERNS[label])
    for _ in range(3000):
        text = sample(parsed, rng)
        match = re.search(ISSUE_PATTERNS[label], text)
        if match:
            assert any(hint in match.group(0) for hint in ISSUE_HINTS[label]), text


@pytest.mark.parametrize(
    "text, issue",
    [
        ("My order was delayed by several days and arrived late.", "Delivery Delay"),
        ("I was charged twice for the same order. Payment error.", "Payment Issue"),
        ("My refund has not been processed after 15 days.", "Refund Not Processed"),
        ("Customer service did not respond to my complaint.", "Poor Customer Support"),
        ("My package is missing. I never received it and it is lost.", "Missing / Lost Package"),
        ("I love this product. Very happy with the purchase.", "General Feedback"),
        ("My REFUND hasn’t arrived", "Refund Not Processed"),
    ],
)
def test_detected_without_sentiment(feedback, text, issue):
    row = scoring.score_issue(feedback(text), "feedback").first()
    assert row.detected_issue == issue
    assert row.is_complaint == (issue != "General Feedback")


def test_sentiment_decides(spark):
    rows = [("Positive", "charged twice"), ("Negative", "it is a box"), ("Neutral", "it is a box"),
            ("Neutral", "charged twice")]
    df = spark.createDataFrame(rows, "sentiment string, feedback string")
    found = [(r.detected_issue, r.issue_confidence, r.is_complaint)
             for r in scoring.score_issue(df, "feedback").collect()]
    assert found == [("General Feedback", 45.0, False), ("General Complaint", 55.0, True),
                     ("General Feedback", 45.0, False), ("Payment Issue", 72.0, True)]


def labelled(spark, counts, filler=0):
    """Complaints by issue label, plus rows that are none."""
    rows = [(issue, "Negative", True) for issue, n in counts.items() for _ in range(n)]
    rows += [("General Feedback", "Positive", False)] * filler
    rows = [(i, f"text {i % 2}", *r) for i, r in enumerate(rows)]
    schema = "feedback_id int, feedback string, detected_issue string, sentiment string, is_complaint boolean"
    return spark.createDataFrame(rows, schema)


def test_recurring_thresholds(spark):
    counts = {"A": 2, "B": 3, "C": 5, "D": 9, "E": 10, "Payment Issue": 6, "Delivery Delay": 5}
    found = recurring.recurring_counts(labelled(spark, counts, filler=5000), ColumnRoles()).collect()
    assert {r.issue_label: r.priority for r in found} == {
        "B": "LOW", "C": "MEDIUM", "D": "MEDIUM", "E": "HIGH", "Payment Issue": "HIGH",
        "Delivery Delay": "MEDIUM",
    }
    assert {r.issue_label: r.cluster_id for r in found}["B"] == 1


def test_recurring_shares(spark):
    counts = {"A": 4, "B": 8, "C": 3}
    found = recurring.recurring_counts(labelled(spark, counts, filler=85), ColumnRoles()).collect()
    assert {r.issue_label: (r.priority, r.percentage) for r in found} == {
        "A": ("MEDIUM", 4.0), "B": ("HIGH", 8.0), "C": ("LOW", 3.0)}
    assert all(r.avg_rating is None for r in found)


def test_recurring_from_texts_alone(spark):
    late = ["My order was very late. Delivery took 10 days.", "Delivery was delayed by several days.",
            "Package arrived after a week. Very late.", "Shipping was very slow and delayed.",
            "Order delayed significantly. Not acceptable."]
    other = ["Customer service was rude and unhelpful.", "Refund not processed after 2 weeks.",
             "App keeps crashing when I try to checkout.", "Product quality is terrible.",
             "Wrong item was delivered."]
    rows = [(i, t, "Negative") for i, t in enumerate(late * 5 + other * 3)]
    df = spark.createDataFrame(rows, "feedback_id int, feedback string, sentiment string")
    ranked = recurring.ranked_by_volume(recurring.recurring_counts(df, ColumnRoles())).orderBy("rank").collect()
    assert ranked[0].issue_label == "Delivery Delay"
    assert [r.occurrences for r in ranked] == sorted((r.occurrences for r in ranked), reverse=True)
    assert all(r.occurrences >= 3 and r.priority in {"HIGH", "MEDIUM", "LOW"} for r in ranked)
    texts = recurring.complaint_texts(recurring.complaint_rows(df, "feedback"), ColumnRoles())
    samples = {r.issue_label: r.sample_feedbacks for r in recurring.sample_feedbacks(texts).collect()}
    assert samples["Refund Not Processed"] == ["Refund not processed after 2 weeks."]
    assert len(samples["Delivery Delay"]) == 3


def test_summary_and_priority_mode(spark):
    df = labelled(spark, {"B": 3, "A": 3}, filler=2).withColumnRenamed("x", "y")
    df = df.selectExpr("*", "72.0D AS issue_confidence", "if(feedback_id % 3 = 0, 'HIGH', 'LOW') AS priority")
    summary = issues.issue_summary(df).collect()
    assert [(r.detected_issue, r.occurrences, r.percentage, r.avg_sentiment) for r in summary] == [
        ("A", 3, 37.5, "Negative"), ("B", 3, 37.5, "Negative")]
    modes = issues.issue_priority_mode(df, ["LOW"]).collect()
    assert [(r.detected_issue, r.priority) for r in modes] == [("A", "LOW"), ("B", "LOW")]
    assert tuple(issues.priority_distribution(df).first()) == (3, 0, 5)
