"""Fixed label orders and column-name candidates shared by the operators."""

# Accepted column names per role, best first.
FEEDBACK_NAMES = [
    "feedback", "review", "comment", "customer_feedback", "review_text", "complaint", "text",
    "message", "description",
]
DATE_NAMES = ["date", "created_at", "timestamp", "review_date", "feedback_date", "time"]
RATING_NAMES = ["rating", "score", "stars", "review_score", "customer_rating"]

PRIORITIES = ["HIGH", "MEDIUM", "LOW"]
SENTIMENTS = ["Positive", "Neutral", "Negative"]
SEVERITIES = ["critical", "warning", "info"]
