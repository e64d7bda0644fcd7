"""Report tables and exploration."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.functions.text import pct
from plaintide.operators.frames import count_where, counts_by, row_count, row_weight
from plaintide.operators.recurring import THRESHOLD, complaint_flag
from plaintide.rules.issue import NO_ISSUE
from plaintide.rules.report import SENTIMENTS


def kpi_summary(df: DataFrame) -> DataFrame:
    """The headline numbers, one row; the recurring issues are counted in the same pass."""
    weight = row_weight(df)
    complaint = complaint_flag(df)

    def rows(condition):
        return F.coalesce(F.sum(F.when(condition, weight)), F.lit(0)).cast("bigint")

    per_issue = df.groupBy("detected_issue").agg(
        row_count(df).alias("n"),
        *[rows(F.col("sentiment") == s).alias(s) for s in SENTIMENTS],
        rows(F.col("priority") == "HIGH").alias("high"),
        rows(complaint).alias("complaints"),
    )
    recurs = (F.col("detected_issue") != NO_ISSUE) & (F.col("complaints") >= THRESHOLD)

    def total(column):
        return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")

    sums = per_issue.agg(
        total("n").alias("total"),
        *[total(s).alias(s.lower()) for s in SENTIMENTS],
        total("high").alias("high_priority"),
        total("complaints").alias("complaints"),
        total(F.when(recurs, 1)).alias("recurring_issues"),
    )
    shares = {f"{s.lower()}_pct": pct(F.col(s.lower()), F.col("total")) for s in SENTIMENTS}
    return sums.withColumns(shares)


def quality_table(report: DataFrame) -> DataFrame:
    """The quality counters as rows of metric and count."""
    rows = {
        "Records Received": "records_received",
        "Duplicates Removed": "duplicates_removed",
        "Missing Values Handled": "missing_handled",
        "Short Records Removed": "short_removed",
        "Valid Records Processed": "valid_records",
    }
    return report.select(
        F.inline(
            F.array(
                *[F.struct(F.lit(m).alias("metric"), F.col(c).alias("count")) for m, c in rows.items()]
            )
        )
    )


def sentiment_table(df: DataFrame) -> DataFrame:
    """Count and share of each sentiment, zeros kept."""
    sums = df.agg(
        row_count(df).alias("total"),
        *[count_where(df, F.col("sentiment") == s).alias(s) for s in SENTIMENTS],
    )
    rows = [
        F.struct(
            F.lit(s).alias("sentiment"), F.col(s).alias("count"),
            pct(F.col(s), F.col("total")).alias("percentage"),
        )
        for s in SENTIMENTS
    ]
    return sums.select(F.inline(F.array(*rows)))


def recurring_table(recurring: DataFrame, n: int = 10) -> DataFrame:
    """The first `n` recurring issues as shown in the report."""
    columns = ["issue_label", "occurrences", "percentage", "avg_sentiment", "priority"]
    return recurring.filter(F.col("rank") <= n).orderBy("rank").select("rank", *columns)


def first_by_order(found: DataFrame, n: int = 8) -> DataFrame:
    """The first `n` insights or recommendations."""
    return found.orderBy("ord").limit(n)


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    counted = counts_by(df.filter(F.col(column).isNotNull()), column)
    return counted.orderBy(F.desc("count"), column)


def matching_rows(
    df: DataFrame,
    feedback: str,
    sentiments: list[str] = (),
    priorities: list[str] = (),
    topics: list[str] = (),
    search: str = "",
) -> DataFrame:
    """Rows that pass the filters; an empty filter passes all. `search` is a regular expression."""
    for column, values in (("sentiment", sentiments), ("priority", priorities), ("topic", topics)):
        if values and column in df.columns:
            df = df.filter(F.col(column).isin(list(values)))
    return df.filter(F.col(feedback).rlike("(?iuU)" + search)) if search else df


def explore(df: DataFrame, feedback: str, key: str, limit: int = 200, **filters) -> DataFrame:
    """The first rows by key that pass the filters, in display columns."""
    shown = [feedback, "sentiment", "emotion", "topic", "detected_issue", "priority",
             "sentiment_confidence"]
    found = matching_rows(df, feedback, **filters).orderBy(key).limit(limit)
    return found.select(key, *[c for c in shown if c in df.columns])


def distinct_topics(df: DataFrame) -> DataFrame:
    return df.select("topic").distinct().orderBy("topic")


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first rows by key."""
    return df.orderBy(key).limit(n)


def non_null_count(df: DataFrame, feedback: str) -> DataFrame:
    return df.agg(F.count(feedback).alias("non_null"), F.count("*").alias("rows"))
