"""Sentiment rules: word lists of the keyword scorer and domain valences."""

LABELS = ["Negative", "Neutral", "Positive"]

# Words of the keyword scorer.
POSITIVE_WORDS = [
    "good", "great", "excellent", "love", "perfect", "amazing", "wonderful", "fantastic", "happy",
    "satisfied", "best", "recommend", "helpful", "fast", "quick", "easy", "smooth", "nice", "awesome",
    "sturdy", "premium",
]

NEGATIVE_WORDS = [
    "bad", "worst", "terrible", "horrible", "awful", "hate", "slow", "broken", "useless",
    "disappointed", "angry", "frustrated", "never", "problem", "issue", "wrong", "delayed", "late",
    "missing", "damaged", "refund", "cancel", "failed", "error", "poor", "flimsy", "overcharged",
]

# Valence of customer-feedback terms on the usual -4..4 lexicon scale.
DOMAIN_VALENCE = {
    "flimsy": -2.2, "overcharged": -2.6, "unresolved": -2.0, "glitch": -1.6, "glitches": -1.6,
    "hiccup": -1.0, "mediocre": -1.4, "refund": -0.4, "delayed": -1.8, "delay": -1.4, "damaged": -2.4,
    "defective": -2.6, "wear": -0.8, "lagging": -1.6, "crashes": -2.2, "crashed": -2.2, "sturdy": 1.8,
    "premium": 1.8, "courteous": 1.8, "seamless": 2.0, "smooth": 1.6, "reliable": 1.8, "worth": 1.2,
    "polite": 0.8, "eventually": -0.6, "unhelpful": -2.2, "ignored": -2.2, "pathetic": -2.8,
    "scam": -3.0, "fraud": -3.0, "ripoff": -2.8, "misleading": -2.0,
}
