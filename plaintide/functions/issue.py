"""Issue expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaintide.functions.matching import text
from plaintide.rules.issue import ANY_ISSUE, ISSUE_HINTS, ISSUE_PATTERNS, NO_ISSUE


def _matches(label: str) -> str:
    hinted = " OR ".join(f"contains(_issue_text, {text(hint)})" for hint in ISSUE_HINTS[label])
    return f"({hinted}) AND rlike(_issue_text, {text('(?Ud)' + ISSUE_PATTERNS[label])})"


def matches_issue(label: str) -> Column:
    """Whether the normalised `_issue_text` matches the label's rule; the regex only runs on a hint."""
    return F.expr(_matches(label))


def first_match() -> Column:
    """The first label in rule order that `_issue_text` matches; later rules are not evaluated."""
    tests = [f"if({_matches(label)}, {text(label)}, NULL)" for label in ISSUE_PATTERNS]
    return F.expr(f"coalesce({', '.join(tests)})")


def issue_label(match: Column, sentiment: Column) -> Column:
    return (
        F.when(sentiment == "Positive", NO_ISSUE)
        .when(match.isNotNull(), match)
        .when(sentiment == "Negative", ANY_ISSUE)
        .otherwise(NO_ISSUE)
    )


def issue_confidence(match: Column, sentiment: Column) -> Column:
    return (
        F.when(sentiment == "Positive", 45.0)
        .when(match.isNotNull(), 72.0)
        .when(sentiment == "Negative", 55.0)
        .otherwise(45.0)
    )


def is_complaint(match: Column, sentiment: Column) -> Column:
    return (
        F.when(sentiment == "Negative", True)
        .when(sentiment == "Positive", False)
        .otherwise(match.isNotNull())
    )
