"""The profile of single texts: every scorer on the text alone. Works on tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.operators.recommend import template
from plaintide.operators.scoring import score_text_only
from plaintide.operators.text_sentiment import TextSentiment


def text_only_profile(
    df: DataFrame,
    text: str = "feedback",
    keep: list[str] = (),
    text_sentiment: TextSentiment | None = None,
) -> DataFrame:
    """Labels, priority and recommended action per text; `keep` names columns to carry along.

    Unlike in the analysis of a table, the issue does not know the sentiment, the emotion is not
    reconciled with it and there is no rating.
    """
    chosen = df.select(*keep, text)
    if text_sentiment is None:
        scored = score_text_only(chosen, text)
    else:
        scored = score_text_only(text_sentiment.add(chosen, text, "_probs"), text, "_probs").drop("_probs")
    action = template(F.col("detected_issue"))
    return scored.withColumn("_action", action).withColumns(
        {
            "recommended_action": F.col("_action.action"),
            "recommendation_details": F.col("_action.details"),
        }
    ).drop("_action")
