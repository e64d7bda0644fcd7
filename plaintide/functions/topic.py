"""Topic expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaintide.functions.matching import WORD_EDGES, KeywordGroup, first_best
from plaintide.rules.topic import TOPIC_KEYWORDS

HITS = "_topic_hits"
GROUPS = {topic: KeywordGroup(terms, WORD_EDGES, HITS) for topic, terms in TOPIC_KEYWORDS.items()}


def topic_label(scores: dict[str, Column], best: Column) -> Column:
    return F.when(best == 0, "Other").otherwise(first_best(scores, best))


def topic_confidence(best: Column, total: Column) -> Column:
    share = F.when(total > 0, best / total)
    return F.when(best == 0, 50.0).otherwise(F.bround(F.least(F.lit(95.0), 50 + share * 45), 1))


def provided_category(category: Column) -> Column:
    """The category as given, null when it says nothing."""
    value = F.regexp_replace(category.cast("string"), r"(?U)^\s+|\s+$", "")
    return F.when((value != "") & (F.lower(value) != "nan"), value)
