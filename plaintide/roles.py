"""Which column of a feedback table plays which part."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ColumnRoles:
    """Column names by role; `key` orders the rows, as Spark rows have no order of their own."""

    feedback: str = "feedback"
    date: str | None = None
    rating: str | None = None
    category: str | None = None
    key: str = "feedback_id"
