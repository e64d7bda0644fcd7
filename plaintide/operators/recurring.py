"""Recurring issues: complaints grouped by issue label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaintide.functions import issue as iss
from plaintide.functions.text import folded_both, pct
from plaintide.operators.cleaning import dense_ids
from plaintide.operators.frames import computed_once, mode_by, with_total
from plaintide.roles import ColumnRoles
from plaintide.rules.issue import NO_ISSUE
from plaintide.rules.priority import HIGH_IMPACT_RECURRING

THRESHOLD = 3
RATING_COLUMNS = ["rating", "score", "stars"]
SEGMENTS = ["product", "channel"]


def complaint_flag(df: DataFrame) -> Column:
    """Whether a row counts as a complaint, by the best column the table has for it."""
    if "is_complaint" in df.columns:
        return F.coalesce(F.col("is_complaint").cast("boolean"), F.lit(False))
    if "sentiment" in df.columns:
        return F.coalesce(F.col("sentiment") == "Negative", F.lit(False))
    return F.lit(True)


def with_issue(df: DataFrame, feedback: str) -> DataFrame:
    """Adds `issue_label`: the detected issue, or the one the text would get as a negative one."""
    if "detected_issue" in df.columns:
        return df.withColumn("issue_label", F.col("detected_issue"))
    layers = [
        {"_issue_text": folded_both(F.col(feedback))},
        {"_match": iss.first_match()},
        {"issue_label": iss.issue_label(F.col("_match"), F.lit("Negative"))},
    ]
    return computed_once(df, layers, ["issue_label"])


def complaint_rows(df: DataFrame, feedback: str) -> DataFrame:
    """The complaints with a specific or general issue, with `issue_label` added."""
    labelled = with_issue(df.filter(complaint_flag(df)), feedback)
    return labelled.filter(F.col("issue_label") != NO_ISSUE)


def recurring_priority(label: Column, occurrences: Column, share: Column) -> Column:
    severe = label.isin(HIGH_IMPACT_RECURRING) & (occurrences >= 6)
    return (
        F.when((occurrences >= 10) | (share >= 0.08) | severe, "HIGH")
        .when((occurrences >= 5) | (share >= 0.04), "MEDIUM")
        .otherwise("LOW")
    )


def recurring_counts(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """One row per recurring issue with every number that one grouped pass can give.

    issue_label, occurrences, percentage, avg_sentiment, priority, avg_rating, cluster_id (rank of
    the issue's first row among all issues, counting those that do not recur).
    """
    rating = next((c for c in RATING_COLUMNS if c in df.columns), None)
    value = F.col(rating).try_cast("double") if rating else F.lit(None).cast("double")
    flagged = with_issue(df, roles.feedback).select(
        complaint_flag(df).alias("_complaint"),
        "issue_label",
        (F.col("sentiment") if "sentiment" in df.columns else F.lit("Negative")).alias("_sentiment"),
        F.nanvl(value, F.lit(None)).alias("_rating"),
        F.col(roles.key).alias("_key"),
    )
    # Rows that are no complaints only add to the total.
    group = F.when(F.col("_complaint") & (F.col("issue_label") != NO_ISSUE), F.col("issue_label"))
    sentiment = F.when(group.isNotNull(), F.col("_sentiment"))
    grouped = flagged.groupBy(group.alias("issue_label"), sentiment.alias("_sentiment")).agg(
        F.count("*").alias("_n"),
        F.sum("_rating").alias("_rating_sum"),
        F.count("_rating").alias("_ratings"),
        F.min("_key").alias("_first"),
    )
    mode = F.when(
        F.col("_sentiment").isNotNull(),
        F.struct(-F.col("_n"), F.col("_sentiment").alias("label")),
    )
    per_issue = grouped.groupBy("issue_label").agg(
        F.sum("_n").alias("occurrences"),
        F.min(mode)["label"].alias("avg_sentiment"),
        (F.sum("_rating_sum") / F.nullif(F.sum("_ratings"), F.lit(0))).alias("_mean"),
        F.min("_first").alias("_first"),
    )
    # One row per label from here on.
    ranked = (
        with_total(per_issue, "occurrences")
        .filter("issue_label IS NOT NULL")
        .withColumn("cluster_id", F.row_number().over(Window.orderBy("_first")).cast("bigint") - 1)
        .filter(F.col("occurrences") >= THRESHOLD)
    )
    share = F.col("occurrences") / F.col("_total")
    return ranked.select(
        "issue_label",
        "occurrences",
        pct(F.col("occurrences"), F.col("_total")).alias("percentage"),
        F.coalesce("avg_sentiment", F.lit("Negative")).alias("avg_sentiment"),
        recurring_priority(F.col("issue_label"), F.col("occurrences"), share).alias("priority"),
        F.bround("_mean", 2).alias("avg_rating"),
        "cluster_id",
    )


def complaint_texts(complaints: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Distinct texts per issue: issue_label, text, copies, text_id (rank of the first copy's key).

    Ids are dense over all issues, ties by issue and text, so no two rows share one even if keys repeat.
    """
    texts = complaints.groupBy("issue_label", F.col(roles.feedback).alias("text")).agg(
        F.count("*").alias("copies"), F.min(roles.key).alias("_first")
    )
    return dense_ids(texts, ["_first", "issue_label", "text"], "text_id").drop("_first")


def sample_feedbacks(texts: DataFrame, n: int = 3) -> DataFrame:
    """The `n` most frequent texts per issue as an array; earlier texts first on ties.

    The rank filter lets Spark keep only `n` rows per issue and task before the shuffle.
    """
    order = Window.partitionBy("issue_label").orderBy(F.desc("copies"), "text_id")
    ranked = texts.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n)
    listed = F.array_sort(F.collect_list(F.struct("_rank", "text")))
    return ranked.groupBy("issue_label").agg(listed.getField("text").alias("sample_feedbacks"))


def top_segment(complaints: DataFrame, segment: str) -> DataFrame:
    """Most affected value of a segment column per issue, with its row count."""
    rows = complaints.withColumn(segment, F.col(segment).cast("string"))
    return mode_by(rows, "issue_label", segment, f"top_{segment}", f"top_{segment}_count")


def ranked_by_volume(recurring: DataFrame) -> DataFrame:
    """Adds `rank`: occurrences first, HIGH before others, then first appearance."""
    order = Window.orderBy(
        F.desc("occurrences"), F.desc(F.col("priority") == "HIGH"), F.asc("cluster_id")
    )
    return recurring.withColumn("rank", F.row_number().over(order).cast("bigint"))


def segments_of(df: DataFrame) -> list[str]:
    return [s for s in SEGMENTS if s in df.columns]
