import datetime

import pytest
from pyspark.sql import functions as F

from plaintide import ColumnRoles, analyze
from plaintide.operators import insights, recommend, report, trends

ROWS = [
    ("late refund and rude agent", "2024-01-05", 1.0, "web"),
    ("refund not processed", "2024-02-05", 1.0, "web"),
    ("no refund yet, still waiting", "2024-02-06", 2.0, "app"),
    ("love it, great value", "2024-02-07", 5.0, None),
    ("my parcel is lost", "not a date", 1.0, "app"),
    ("it is a box", None, 3.0, "app"),
    ("refund denied twice", "2024-03-01", 1.0, "web"),
]


@pytest.fixture(scope="module")
def analysis(spark):
    rows = [(i, *r) for i, r in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "feedback_id int, feedback string, date string, rating double, channel string")
    return analyze(df, ColumnRoles(date="date", rating="rating"))


def test_periods_of_many_formats(spark):
    values = ["2024-03-01", "2024-03-01 10:00:00", "03/28/2024", "28-03-2024", "nonsense", None]
    df = spark.createDataFrame([(v,) for v in values], "d string")
    assert [r.period for r in trends.with_period(df, "d").collect()] == ["2024-03"] * 4
    typed = spark.createDataFrame([(datetime.date(2024, 3, 1),)], "d date")
    assert trends.with_period(typed, "d").first().period == "2024-03"


def test_trends_skip_unreadable_dates(analysis):
    months = {r.period: r["count"] for r in trends.volume_trend(analysis.dated).collect()}
    assert months == {"2024-01": 1, "2024-02": 3, "2024-03": 1}
    assert analysis.quality.first().valid_records == 7


@pytest.mark.parametrize("counts, rises", [([10, 12], False), ([10, 13], True), ([5], False), ([4, 9, 9], True)])
def test_rising_negatives(spark, counts, rises):
    rows = [(f"2024-{i + 1:02}", "Negative", n) for i, n in enumerate(counts)]
    trend = spark.createDataFrame(rows, "period string, sentiment string, count bigint")
    assert insights.rising_negative_trend(trend).count() == int(rises)


@pytest.mark.parametrize(
    "negative, title",
    [(249, None), (250, "Elevated Negative Feedback"), (399, "Elevated Negative Feedback"),
     (400, "High Negative Feedback Rate")],
)
def test_negative_rate_limits(spark, negative, title):
    df = spark.range(1000).select(F.when(F.col("id") < negative, "Negative").otherwise("Neutral").alias("sentiment"))
    found = insights.negative_rate(df).collect()
    assert [r.title for r in found] == ([title] if title else [])


def test_analysis_hangs_together(analysis):
    issues = {r.issue_label: r.asDict() for r in analysis.recurring_issues.collect()}
    refund = issues["Refund Not Processed"]
    assert refund["occurrences"] == 3 and refund["priority"] == "HIGH"
    assert refund["top_channel"] == "web" and refund["top_channel_count"] == 2
    assert refund["avg_rating"] == 1.33
    assert sum(t["count"] for t in refund["themes"]) <= 3
    titles = [r.title for r in analysis.insights.collect()]
    assert "High Negative Feedback Rate" in titles
    assert len(titles) == len(set(titles))
    first = analysis.recommendations.first()
    assert (first.issue, first.action) == ("Refund Not Processed", "Streamline Refund Processing Pipeline")
    assert first.evidence == "3 occurrences detected (42.9% of all feedback) with Negative average sentiment."
    kpis = analysis.kpis.first()
    assert (kpis.total, kpis.negative, kpis.positive, kpis.recurring_issues) == (7, 5, 1, 1)


def test_report_tables(analysis):
    rows = report.sentiment_table(analysis.enriched).collect()
    assert [(r.sentiment, r["count"]) for r in rows] == [("Positive", 1), ("Neutral", 1), ("Negative", 5)]
    metrics = {r.metric: r["count"] for r in report.quality_table(analysis.quality).collect()}
    assert metrics["Records Received"] == 7
    shown = report.explore(analysis.enriched, "feedback", "feedback_id", search="REFUND|box", limit=3)
    assert [r.feedback_id for r in shown.collect()] == [0, 1, 2]
    nothing = report.kpi_summary(analysis.enriched.filter("false")).first()
    assert nothing.total == 0 and nothing.negative_pct == 0.0


def test_priorities_sum_to_the_rows(analysis):
    from plaintide.operators.issues import priority_distribution

    assert sum(priority_distribution(analysis.enriched).first()) == analysis.enriched.count()


def test_summary_recommendations_leave_covered_actions_out(spark):
    recurring = spark.createDataFrame(
        [("Payment Issue", 9, 9.0, "Negative", "HIGH", 1)],
        "issue_label string, occurrences bigint, percentage double, avg_sentiment string, priority string, rank bigint",
    )
    summary = spark.createDataFrame(
        [("Payment Issue", 9, 9.0, "Negative"), ("Odd Issue", 4, 4.0, "Neutral"), ("Other Odd", 3, 3.0, "Neutral"),
         ("Delivery Delay", 2, 2.0, "Negative")],
        "detected_issue string, occurrences bigint, percentage double, avg_sentiment string",
    )
    found = recommend.recommendations(recurring, summary).collect()
    assert [(r.issue, r.priority) for r in found] == [("Payment Issue", "HIGH"), ("Odd Issue", "MEDIUM")]
    assert recommend.recommendations(recurring, summary, ["HIGH"]).count() == 1


def test_enriched_table_on_disk(spark, tmp_path):
    rows = [(i, t) for i, (t, *_) in enumerate(ROWS)]
    df = spark.createDataFrame(rows, "feedback_id int, feedback string")
    found = analyze(df, enriched_path=str(tmp_path / "enriched"))
    assert found.dated is None
    assert found.enriched.count() == 7 and found.kpis.first().total == 7
