"""Some queries against their SQL at the smallest scale; `python -m checks.compare` runs all."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import compare, database

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")

CHOSEN = ["clean_records", "quality_report", "score_sentiment", "enriched_rows", "issue_summary", "recurring_counts",
          "theme_examples", "kpi_summary", "text_only_profile", "assign_feedback_id", "recurring_themes_repeated_ids",
          "text_dates", "csv_quality", "enriched_with_lexicon", "training_folds", "recommendations_from_both",
          "insight_rising_negatives_of_orders", "top_terms", "conversation_profile"]


@pytest.fixture(scope="module")
def connection():
    return database(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, connection, name):
    same, note = compare(spark, connection, SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert same, note


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).count() == 15
