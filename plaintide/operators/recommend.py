"""Recommendations: action templates for the issues found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaintide.rules.actions import ACTIONS, DEFAULT_ACTION
from plaintide.rules.issue import NO_ISSUE
from plaintide.rules.report import PRIORITIES

FIELDS = ["action", "details", "kpi", "department"]
COLUMNS = ["issue", "occurrences", "percentage", "priority", "avg_sentiment", *FIELDS, "evidence"]


def template(issue: Column) -> Column:
    """The action template of an issue as a struct of its four texts."""

    def texts(values) -> Column:
        return F.struct(*[F.lit(v).alias(f) for f, v in zip(FIELDS, values)])

    known = [F.when(issue == label, texts(values)) for label, values in ACTIONS.items()]
    return F.coalesce(*known, texts(DEFAULT_ACTION))


def _with_template(df: DataFrame) -> DataFrame:
    df = df.withColumn("_template", template(F.col("issue")))
    return df.withColumns({f: F.col(f"_template.{f}") for f in FIELDS}).drop("_template")


def _first_per_action(df: DataFrame, order: list[Column]) -> DataFrame:
    """One row per action. At most one row per issue label comes in."""
    number = F.row_number().over(Window.partitionBy("action").orderBy(*order))
    return df.withColumn("_number", number).filter("_number = 1").drop("_number")


def recommend_from_recurring(recurring: DataFrame) -> DataFrame:
    """One recommendation per action, for the highest-ranked recurring issue that calls for it."""
    issues = recurring.withColumnRenamed("issue_label", "issue")
    first = _first_per_action(_with_template(issues), [F.asc("rank")])
    evidence = F.format_string(
        "%d occurrences detected (%s%% of all feedback) with %s average sentiment.",
        "occurrences", F.col("percentage").cast("string"), "avg_sentiment",
    )
    return first.withColumn("evidence", evidence).select(F.col("rank").alias("ord"), *COLUMNS)


def recommend_from_summary(
    summary: DataFrame, recurring: DataFrame | None = None, threshold: int = 3
) -> DataFrame:
    """Recommendations for summary issues with enough rows whose action is not covered yet."""
    issues = summary.withColumnRenamed("detected_issue", "issue").filter(
        (F.col("issue") != NO_ISSUE) & (F.col("issue") != "") & (F.col("occurrences") >= threshold)
    )
    if "avg_sentiment" not in issues.columns:
        issues = issues.withColumn("avg_sentiment", F.lit("Neutral"))
    found = _with_template(issues.withColumn("priority", F.lit("MEDIUM")))
    if recurring is not None:
        covered = recommend_from_recurring(recurring).select("action")
        found = found.join(covered, "action", "left_anti")
    order = [F.desc("occurrences"), F.asc("issue")]
    first = _first_per_action(found, order)
    numbered = first.withColumn("ord", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    evidence = F.format_string(
        "%d occurrences detected (%s%% of feedback).",
        "occurrences", F.col("percentage").cast("string"),
    )
    return numbered.withColumn("evidence", evidence).select("ord", *COLUMNS)


def recommendations(
    recurring: DataFrame, summary: DataFrame | None = None, priorities: list[str] | None = None
) -> DataFrame:
    """Both kinds, HIGH before MEDIUM before LOW, else in the order they were found."""
    every = recommend_from_recurring(recurring).withColumn("_source", F.lit(0))
    if summary is not None:
        more = recommend_from_summary(summary, recurring).withColumn("_source", F.lit(1))
        every = every.unionByName(more)
    level = F.coalesce(
        *[F.when(F.col("priority") == p, F.lit(i)) for i, p in enumerate(PRIORITIES)],
        F.lit(len(PRIORITIES)),
    )
    order = Window.orderBy(level, "_source", "ord")
    ranked = every.withColumn("ord", F.row_number().over(order).cast("bigint")).drop("_source")
    if priorities is not None:
        ranked = ranked.filter(F.col("priority").isin(priorities))
    return ranked.orderBy("ord")
