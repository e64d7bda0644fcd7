"""Issue aggregates over enriched rows or the label profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.functions.text import pct
from plaintide.operators.frames import counts_by, mode_by, row_count, row_weight, with_total
from plaintide.rules.issue import NO_ISSUE


def issue_summary(df: DataFrame) -> DataFrame:
    """Per issue: occurrences, mean confidence, share of all rows, most frequent sentiment."""
    by = ["detected_issue"] + (["sentiment"] if "sentiment" in df.columns else [])
    weight = row_weight(df)
    grouped = df.groupBy(*by).agg(
        row_count(df).alias("_rows"), F.sum(F.col("issue_confidence") * weight).alias("_confidence")
    )
    per_issue = grouped.groupBy("detected_issue").agg(
        F.sum("_rows").alias("occurrences"),
        (F.sum("_confidence") / F.sum("_rows")).alias("avg_confidence"),
        *(
            [F.min(F.when(F.col("sentiment").isNotNull(),
                          F.struct(-F.col("_rows"), F.col("sentiment").alias("label"))))
             .alias("_mode")]
            if "sentiment" in df.columns
            else []
        ),
    )
    summary = with_total(per_issue, "occurrences").filter(F.col("detected_issue") != NO_ISSUE)
    columns = ["detected_issue", "occurrences", "avg_confidence",
               pct(F.col("occurrences"), F.col("_total")).alias("percentage")]
    if "sentiment" in df.columns:
        columns.append(F.col("_mode.label").alias("avg_sentiment"))
    return summary.select(*columns).orderBy(F.desc("occurrences"), "detected_issue")


def issue_priority_mode(df: DataFrame, priorities: list[str] | None = None) -> DataFrame:
    """Most frequent priority per issue, LOW where there is none; optionally only some of them."""
    issues = counts_by(df.filter(F.col("detected_issue") != NO_ISSUE), "detected_issue",
                       name="occurrences")
    modes = mode_by(df, "detected_issue", "priority", "priority")
    found = issues.join(modes, "detected_issue", "left").fillna("LOW", ["priority"])
    if priorities is not None:
        found = found.filter(F.col("priority").isin(priorities))
    return found.orderBy(F.desc("occurrences"), "detected_issue")


def topic_distribution(df: DataFrame) -> DataFrame:
    return counts_by(df.filter("topic IS NOT NULL"), "topic").orderBy(F.desc("count"), "topic")


def topic_agreement(df: DataFrame) -> DataFrame:
    """How often the detected topic equals the category given in the data; one row."""
    given = F.col("topic_source") == "dataset"
    same = given & (F.col("topic") == F.col("topic_detected"))
    weight = row_weight(df)
    compared = F.coalesce(F.sum(F.when(given, weight)), F.lit(0)).cast("bigint")
    agreed = F.coalesce(F.sum(F.when(same, weight)), F.lit(0)).cast("bigint")
    return df.agg(compared.alias("compared"), agreed.alias("agreed")).withColumn(
        "agreement", F.when(F.col("compared") > 0, F.col("agreed") / F.col("compared"))
    )


def priority_distribution(df: DataFrame) -> DataFrame:
    """Rows per priority, zeros kept; one row."""
    weight = row_weight(df)
    return df.agg(
        *[
            F.coalesce(F.sum(F.when(F.col("priority") == p, weight)), F.lit(0)).cast("bigint").alias(p)
            for p in ("HIGH", "MEDIUM", "LOW")
        ]
    )
