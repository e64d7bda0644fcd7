"""Priority expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaintide.functions.matching import text
from plaintide.rules.priority import (
    EMOTION_POINTS,
    HIGH_IMPACT_ISSUES,
    IMPACT_TERMS,
    SENTIMENT_POINTS,
    URGENCY_TERMS,
)


def points(label: Column, table: dict[str, int]) -> Column:
    """Points of a label, 0 for labels that score nothing."""
    chain = F
    for name, value in table.items():
        if value:
            chain = chain.when(label == name, value)
    return chain.otherwise(0)


def terms_found(terms: list[str]) -> Column:
    """How many of the terms occur anywhere in the lower-cased `_lower_text`."""
    return F.expr(" + ".join(f"int(contains(_lower_text, {text(t)}))" for t in terms))


def first_terms(terms: list[str], n: int = 2) -> Column:
    found = ", ".join(f"if(contains(_lower_text, {text(t)}), {text(t)}, NULL)" for t in terms)
    return F.expr(f"array_join(slice(array_compact(array({found})), 1, {n}), ', ')")


def rating_points(rating: Column) -> Column:
    """2 points up to a rating of 2, 1 up to 3; the range is not checked."""
    return F.when(rating <= 2, 2).when(rating <= 3, 1).otherwise(0)


def priority_score(sentiment, emotion, complaint, issue, urgency, impact, rating) -> Column:
    return (
        points(sentiment, SENTIMENT_POINTS)
        + points(emotion, EMOTION_POINTS)
        + F.when(complaint, 2).otherwise(0)
        + F.when(issue.isin(HIGH_IMPACT_ISSUES), 2).otherwise(0)
        + F.coalesce(urgency, F.lit(0))
        + F.coalesce(impact, F.lit(0))
        + rating_points(rating)
    ).cast("bigint")


def classify_priority(score: Column) -> Column:
    return F.when(score >= 7, "HIGH").when(score >= 4, "MEDIUM").otherwise("LOW")


def priority_reasons(sentiment, emotion, complaint, issue, urgency, impact, rating) -> Column:
    """The messages behind a score, in the order the points are given."""
    return F.array_compact(
        F.array(
            F.when(
                points(sentiment, SENTIMENT_POINTS) > 0,
                F.concat(F.lit("Negative sentiment ("), sentiment, F.lit(")")),
            ),
            F.when(
                points(emotion, EMOTION_POINTS) > 0,
                F.concat(F.lit("Strong negative emotion ("), emotion, F.lit(")")),
            ),
            F.when(complaint, F.lit("Complaint detected")),
            F.when(
                issue.isin(HIGH_IMPACT_ISSUES),
                F.concat(F.lit("High-impact issue type ("), issue, F.lit(")")),
            ),
            F.when(
                urgency > 0, F.concat(F.lit("Urgency signals: "), first_terms(URGENCY_TERMS))
            ),
            F.when(
                impact > 0,
                F.concat(F.lit("Business impact signals: "), first_terms(IMPACT_TERMS)),
            ),
            F.when(
                rating <= 2, F.concat(F.lit("Very low rating ("), rating.cast("string"), F.lit(")"))
            ),
        )
    )
