"""Priority rules: points per label and per signal word."""

# Fixed values.
SENTIMENT_POINTS = {"Negative": 3, "Neutral": 1, "Positive": 0}

EMOTION_POINTS = {
    "Angry": 4, "Frustrated": 3, "Disappointed": 2, "Confused": 1, "Neutral": 0, "Satisfied": 0,
    "Happy": 0,
}

URGENCY_TERMS = [
    "urgent", "immediately", "asap", "critical", "emergency", "broken", "lawsuit", "legal",
    "unacceptable", "escalate", "demand", "threatening",
]

IMPACT_TERMS = [
    "refund", "chargeback", "cancel", "switch", "competitor", "never again", "will not recommend",
    "public review", "social media", "report",
]

HIGH_IMPACT_ISSUES = [
    "Delivery Delay", "Missing / Lost Package", "Refund Not Processed", "Payment Issue",
    "Poor Customer Support",
]

# Issues that turn HIGH at a lower count when they recur.
HIGH_IMPACT_RECURRING = [
    "Delivery Delay", "Missing / Lost Package", "Refund Not Processed", "Payment Issue",
    "Poor Customer Support", "Pricing / Overcharge",
]
