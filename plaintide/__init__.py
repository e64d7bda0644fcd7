"""plaintide: customer-feedback analytics as Spark DataFrame operators."""

from plaintide.plans.analysis import Analysis, analyze, enrich
from plaintide.operators.text_sentiment import TextSentiment
from plaintide.roles import ColumnRoles

__all__ = ["Analysis", "ColumnRoles", "TextSentiment", "analyze", "enrich"]
