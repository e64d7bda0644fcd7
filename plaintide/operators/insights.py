"""Insights: rules over aggregates. Each rule yields one row (ord, title, description, severity) or none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaintide.functions.text import pct
from plaintide.operators.frames import count_where, counts_by, row_count, top_row, with_total
from plaintide.operators.trends import rising_negatives, sentiment_trend


def _text(template: str, **values: Column) -> Column:
    """`template` with each {name} replaced by the column of that name."""
    parts, rest = [], template
    while "{" in rest:
        before, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def _insight(found: DataFrame, order: int, title: Column, description: Column, severity: Column):
    return found.select(
        F.lit(order).cast("bigint").alias("ord"), title.alias("title"),
        description.alias("description"), severity.alias("severity"),
    )


def _sentiment_share(df: DataFrame, label: str) -> DataFrame:
    totals = df.agg(
        row_count(df).alias("total"), count_where(df, F.col("sentiment") == label).alias("n")
    )
    return totals.withColumn("pct", pct(F.col("n"), F.col("total")))


def negative_rate(df: DataFrame) -> DataFrame:
    share = _sentiment_share(df, "Negative").filter("pct >= 25")
    p, high = F.col("pct"), F.col("pct") >= 40
    return _insight(
        share,
        1,
        F.when(high, "High Negative Feedback Rate").otherwise("Elevated Negative Feedback"),
        F.when(
            high,
            _text(
                "{p}% of customer feedback is negative — this significantly exceeds the healthy "
                "threshold of 20%. Immediate review of the main complaint areas is recommended.",
                p=p,
            ),
        ).otherwise(
            _text(
                "{p}% of customer feedback is negative. "
                "This is above the ideal range and warrants attention.",
                p=p,
            )
        ),
        F.when(high, "critical").otherwise("warning"),
    )


def positive_rate(df: DataFrame) -> DataFrame:
    return _insight(
        _sentiment_share(df, "Positive").filter("pct >= 60"),
        2,
        F.lit("Strong Positive Customer Sentiment"),
        _text(
            "{p}% of feedback is positive, indicating high customer satisfaction. "
            "Focus on maintaining current standards.",
            p=F.col("pct"),
        ),
        F.lit("info"),
    )


def top_topic(df: DataFrame) -> DataFrame:
    counts = counts_by(df, "topic", name="n")
    # One row: a category column may have any number of values.
    total = counts.agg(F.sum("n").alias("_total"))
    best = top_row(counts.filter("topic IS NOT NULL"), "n", "topic").join(F.broadcast(total))
    best = best.withColumn("pct", pct(F.col("n"), F.col("_total")))
    return _insight(
        best,
        3,
        _text("Top Feedback Topic: {t}", t=F.col("topic")),
        _text(
            "{p}% of all feedback is related to '{t}'. "
            "This is the primary area of customer concern and should be prioritized.",
            p=F.col("pct"),
            t=F.col("topic"),
        ),
        F.when(F.col("pct") > 30, "warning").otherwise("info"),
    )


def worst_topic(df: DataFrame) -> DataFrame:
    negative = df.filter((F.col("sentiment") == "Negative") & F.col("topic").isNotNull())
    return _insight(
        top_row(counts_by(negative, "topic", name="n"), "n", "topic"),
        4,
        _text("Most Negative Topic: {t}", t=F.col("topic")),
        _text(
            "'{t}' has the highest concentration of negative feedback with {n} negative reviews. "
            "This represents a critical pain point.",
            t=F.col("topic"),
            n=F.col("n"),
        ),
        F.when(F.col("n") >= 20, "critical").otherwise("warning"),
    )


def high_priority_share(df: DataFrame) -> DataFrame:
    totals = df.agg(
        row_count(df).alias("total"), count_where(df, F.col("priority") == "HIGH").alias("n")
    ).filter("n > 0")
    totals = totals.withColumn("pct", pct(F.col("n"), F.col("total")))
    return _insight(
        totals,
        5,
        _text("{n} High-Priority Issues Detected", n=F.col("n")),
        _text(
            "{p}% of feedback ({n} records) has been classified as HIGH priority based on "
            "sentiment, emotion, complaint type, and urgency signals. "
            "These require immediate business action.",
            p=F.col("pct"),
            n=F.col("n"),
        ),
        F.when(F.col("pct") > 20, "critical").otherwise("warning"),
    )


def top_recurring(recurring: DataFrame) -> DataFrame:
    return _insight(
        recurring.filter("rank = 1"),
        6,
        _text("Most Frequent Recurring Issue: {i}", i=F.col("issue_label")),
        _text(
            "'{i}' appears {n} times ({p}% of all feedback), making it the most critical "
            "recurring problem. This pattern suggests a systemic operational issue.",
            i=F.col("issue_label"),
            n=F.col("occurrences"),
            p=F.col("percentage"),
        ),
        F.when(F.col("priority") == "HIGH", "critical").otherwise("warning"),
    )


def systemic_issues(recurring: DataFrame) -> DataFrame:
    high = recurring.filter("priority = 'HIGH'").agg(F.count("*").alias("n")).filter("n >= 3")
    return _insight(
        high,
        7,
        _text("{n} Systemic High-Priority Issues Found", n=F.col("n")),
        _text(
            "Analysis detected {n} distinct recurring issues at HIGH priority, suggesting multiple "
            "systemic operational failures that need strategic intervention.",
            n=F.col("n"),
        ),
        F.lit("critical"),
    )


def dominant_emotion(df: DataFrame) -> DataFrame:
    counts = with_total(counts_by(df, "emotion", name="n"), "n")
    best = top_row(counts.filter("emotion IS NOT NULL"), "n", "emotion")
    best = best.withColumn("pct", pct(F.col("n"), F.col("_total")))
    return _insight(
        best.filter(F.col("emotion").isin("Angry", "Frustrated", "Disappointed")),
        8,
        _text("Dominant Customer Emotion: {e}", e=F.col("emotion")),
        _text(
            "{p}% of customers express '{e}' emotion in their feedback. High levels of this emotion "
            "indicate a poor customer experience that needs addressing.",
            p=F.col("pct"),
            e=F.col("emotion"),
        ),
        F.lit("warning"),
    )


def complaint_rate(df: DataFrame) -> DataFrame:
    totals = df.agg(
        row_count(df).alias("total"), count_where(df, F.col("is_complaint")).alias("n")
    ).filter("total > 0")
    totals = totals.withColumn("pct", pct(F.col("n"), F.col("total")))
    return _insight(
        totals,
        9,
        _text("Complaint Rate: {p}%", p=F.col("pct")),
        _text(
            "{n} out of {t} feedback records contain identifiable complaints. "
            "A complaint rate of {p}% requires systematic response management.",
            n=F.col("n"),
            t=F.col("total"),
            p=F.col("pct"),
        ),
        F.when(F.col("pct") > 40, "critical").when(F.col("pct") > 20, "warning").otherwise("info"),
    )


def rising_negative_trend(trend: DataFrame) -> DataFrame:
    return _insight(
        rising_negatives(trend),
        10,
        F.lit("Increasing Negative Sentiment Trend"),
        F.lit(
            "Negative feedback volume has increased over time. The trend shows growing customer "
            "dissatisfaction that requires urgent attention."
        ),
        F.lit("critical"),
    )


def insights(
    profile: DataFrame, recurring: DataFrame | None = None, severities: list[str] | None = None
) -> DataFrame:
    """All insights in rule order, the first per title.

    `profile` is a materialised label profile, as every rule reads it; its `period` column, if any,
    feeds the trend rule.
    """
    have = set(profile.columns)
    found = []
    if "sentiment" in have:
        found += [negative_rate(profile), positive_rate(profile)]
    if "topic" in have:
        found.append(top_topic(profile))
        if "sentiment" in have:
            found.append(worst_topic(profile))
    if "priority" in have:
        found.append(high_priority_share(profile))
    if recurring is not None:
        found += [top_recurring(recurring), systemic_issues(recurring)]
    if "emotion" in have:
        found.append(dominant_emotion(profile))
    if "is_complaint" in have:
        found.append(complaint_rate(profile))
    if {"period", "sentiment"} <= have:
        dated = profile.filter("period IS NOT NULL")
        found.append(rising_negative_trend(sentiment_trend(dated)))
    every = reduce(DataFrame.unionByName, found)
    # At most ten rows.
    first = F.row_number().over(Window.partitionBy("title").orderBy("ord")) == 1
    unique = every.withColumn("_first", first).filter("_first").drop("_first")
    if severities is not None:
        unique = unique.filter(F.col("severity").isin(severities))
    return unique.orderBy("ord")
