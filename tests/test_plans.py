"""What the optimized plans hold, and answers on repeated ids."""

import pytest
from pyspark.sql import functions as F

from plaintide import ColumnRoles, TextSentiment, analyze, enrich
from plaintide.operators import trends

TEXTS = ["refund not processed at all", "my refund is still missing", "the refund never came to me", "delivery was late again"]


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_only_the_scorers_that_are_read(feedback):
    df = enrich(feedback(*TEXTS), ColumnRoles(feedback="feedback"), ["sentiment"])
    plan = optimized(df.groupBy("sentiment").count())
    assert df.columns == ["feedback_id", "feedback", "sentiment"]
    assert "_topic" not in plan and "_emotion" not in plan and "_urgency" not in plan
    issue = enrich(feedback(*TEXTS), ColumnRoles(feedback="feedback"), ["detected_issue", "is_complaint"])
    assert "_match" in optimized(issue) and "_topic" not in optimized(issue) and "_emotion" not in optimized(issue)
    with pytest.raises(ValueError):
        enrich(feedback(*TEXTS), ColumnRoles(feedback="feedback"), ["mood"])


def test_wanted_columns_equal_those_of_all_scorers(feedback):
    df, roles = feedback(*TEXTS), ColumnRoles(feedback="feedback")
    every = {r.feedback_id: r for r in enrich(df, roles).collect()}
    for name in ("emotion", "topic", "is_complaint", "priority_score", "sentiment_confidence"):
        for r in enrich(df, roles, [name]).collect():
            assert r[name] == every[r.feedback_id][name]


def test_repeated_ids_are_renumbered(spark):
    texts = [*TEXTS, "refund refused by the shop", "no refund for this order", "refund lost somewhere"]
    rows = list(zip([1, 1, 2, 2, 3, 3, 4], texts))
    found = analyze(spark.createDataFrame(rows, "feedback_id bigint, feedback string"), ColumnRoles(feedback="feedback"))
    assert sorted(r.feedback_id for r in found.enriched.collect()) == list(range(1, 8))
    for issue in found.recurring_issues.collect():
        assert sum(t["count"] for t in issue.themes) <= issue.occurrences


def test_analyze_cleans_once(spark, monkeypatch):
    from plaintide.operators import cleaning

    calls = []
    clean_feedback = cleaning.clean_feedback
    monkeypatch.setattr(cleaning, "clean_feedback", lambda *a: calls.append(1) or clean_feedback(*a))
    rows = [(1, TEXTS[0], 2), (2, TEXTS[0], 2), (3, " ", 1), (4, None, 5), (5, "short", 1), (6, TEXTS[1], 1), (7, TEXTS[1], 3)]
    source = spark.createDataFrame(rows, "feedback_id bigint, feedback string, rating int")
    found = analyze(source, ColumnRoles(feedback="feedback", rating="rating"))
    for result in (found.cleaned, found.profile, found.quality, found.recurring_core, found.insights):
        plan = optimized(result)
        assert "regexp_replace(cast(feedback" not in plan and "regexp_replace(feedback" not in plan
        result.collect()
    assert len(calls) == 1
    assert found.quality.first().asDict() == cleaning.quality_report(source, ColumnRoles(feedback="feedback")).first().asDict() == {
        "records_received": 7, "records_processed": 3, "duplicates_removed": 1, "missing_handled": 2,
        "short_removed": 1, "valid_records": 3}
    assert sorted(r.feedback_id for r in found.cleaned.collect()) == [1, 6, 7]
    kept = cleaning.clean_records(source, ColumnRoles(feedback="feedback")).collect()
    assert sorted(map(tuple, kept)) == sorted(map(tuple, found.cleaned.collect()))
    assert found.labelled.columns[-1] == "priority" and "priority_reasons" in found.enriched.columns


def test_text_sentiment_of_a_lexicon_table(spark, feedback):
    table = spark.createDataFrame([("zwonk", 3.0), ("frabb", -3.0), ("frabb", None), (None, 1.0)], "word string, valence double")
    df = feedback("all zwonk here", "all frabb here", "nothing at all")
    for lexicon in (table, {"zwonk": 3.0, "frabb": -3.0}):
        found = enrich(df, ColumnRoles(feedback="feedback"), ["sentiment"], TextSentiment(lexicon=lexicon))
        assert [r.sentiment for r in found.orderBy("feedback_id").collect()] == ["Positive", "Negative", "Neutral"]
    large = {f"word{i}": 1.0 for i in range(25_000)} | {"zwonk": 3.0}
    found = enrich(df, ColumnRoles(feedback="feedback"), ["sentiment"], TextSentiment(lexicon=large))
    assert found.orderBy("feedback_id").first().sentiment == "Positive"


@pytest.mark.parametrize("texts, periods", [
    (["1/5/2024", "01/06/2024 10:30", "12/30/2023"], ["2024-01", "2024-01", "2023-12"]),
    (["1/5/2024", "25/12/2023", "3/4/2024"], ["2024-05", "2023-12", "2024-04"]),
    (["2024/1/5", "January 5, 2024", "Jan 05 2024", "20240105", "2024-01-05T10:00:00", "5 jan 2024", "05-Jan-2024"], ["2024-01"] * 7),
    (["1/5/2024 3:15 PM", "5.1.2024", "soon", None, ""], ["2024-01", "2024-01", None, None, None]),
    (["Sept 5, 2024", "March 2024", "5th March 2024", "Fri, 05 Jan 2024", "12/31/99", "1/31/68", "Monday, March 4th, 2024 10:30 am"],
     ["2024-09", "2024-03", "2024-03", "2024-01", "1999-12", "2068-01", "2024-03"]),
    (["31/2/2024", "13/13/2024", "Juno 5, 2024", "2024-03", "2024/13/1", "5 Sep. 2024 23:59:59 UTC", "123456", "2024"],
     [None, None, None, "2024-03", None, "2024-09", None, "2024-01"]),
    (["13/1/2024", "1/14/2024", "1/2/2024", "13-1-24", "2-1-24", "2-1-2024"],
     ["2024-01", "2024-01", "2024-01", "2024-01", "2024-01", "2024-02"]),
])
def test_text_dates(spark, texts, periods):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, d string")
    assert [r.period for r in trends.add_period(df, "d").orderBy("i").collect()] == periods


def test_number_dates(spark):
    df = spark.createDataFrame([(1704412800 * 10**9,), (None,)], "d bigint")
    assert [r.period for r in trends.add_period(df, "d").collect()] == ["2024-01", None]
    assert trends.with_period(df.withColumn("d", F.lit(True)), "d").count() == 0
