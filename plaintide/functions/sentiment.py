"""Sentiment expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaintide.functions.matching import texts
from plaintide.functions.text import is_blank, tokens
from plaintide.rules.sentiment import LABELS, NEGATIVE_WORDS, POSITIVE_WORDS


def probabilities(negative, neutral, positive) -> Column:
    """The three class probabilities as one struct."""
    return F.struct(
        F.lit(negative).alias("negative"), F.lit(neutral).alias("neutral"),
        F.lit(positive).alias("positive"),
    )


def rating_to_sentiment(rating: Column) -> Column:
    """Label of a rating in [1, 5]; null for anything else, also for text and NaN."""
    value = rating.try_cast("double")
    return F.when(~value.between(1, 5), F.lit(None)).when(value <= 2, "Negative").when(
        value < 4, "Neutral"
    ).when(value <= 5, "Positive")


def keyword_words(text: Column) -> Column:
    """The distinct words of a text as the keyword scorer sees them."""
    return F.array_distinct(tokens(F.lower(text), "[a-z']+"))


def keyword_counts() -> tuple[Column, Column]:
    """How many positive and negative words are in `_plain_words`."""
    positive, negative = (
        F.expr(f"size(filter(_plain_words, w -> w IN ({texts(words)})))")
        for words in (POSITIVE_WORDS, NEGATIVE_WORDS)
    )
    return positive, negative


def keyword_probabilities(positive: Column, negative: Column) -> Column:
    return F.when(positive > negative, probabilities(0.15, 0.2, 0.65)).when(
        negative > positive, probabilities(0.65, 0.2, 0.15)
    ).otherwise(probabilities(0.2, 0.6, 0.2))


def compound_to_probabilities(compound: Column) -> Column:
    """Class probabilities of a compound score in [-1, 1], floored at .01 and normalised."""
    size = F.abs(compound)
    strong, weak = 0.7 + 0.25 * size, 0.25 - 0.1 * size
    raw = [
        F.when(compound >= 0.05, 0.05).when(compound <= -0.05, strong).otherwise(0.2),
        F.when(size >= 0.05, weak).otherwise(0.6),
        F.when(compound >= 0.05, strong).when(compound <= -0.05, 0.05).otherwise(0.2),
    ]
    floored = [F.greatest(p, F.lit(0.01)) for p in raw]
    total = floored[0] + floored[1] + floored[2]
    return probabilities(*[p / total for p in floored])


def ensemble_probabilities(model: Column, lexicon: Column, keyword: Column) -> Column:
    """.7 model + .3 lexicon; whichever is there alone; the keyword scorer if neither is."""
    mixed = probabilities(
        *[0.7 * model[c] + 0.3 * lexicon[c] for c in ("negative", "neutral", "positive")]
    )
    return F.when(model.isNotNull() & lexicon.isNotNull(), mixed).otherwise(
        F.coalesce(model, lexicon, keyword)
    )


def text_label(text: Column, probs: Column) -> Column:
    """Likeliest label; ties go to the first of Negative, Neutral, Positive."""
    scores = [probs["negative"], probs["neutral"], probs["positive"]]
    best = F.greatest(*scores)
    label = F.coalesce(*[F.when(s == best, F.lit(name)) for name, s in zip(LABELS, scores)])
    return F.when(is_blank(text), "Neutral").otherwise(label)


def text_confidence(text: Column, probs: Column) -> Column:
    best = F.greatest(probs["negative"], probs["neutral"], probs["positive"])
    return F.when(is_blank(text), 50.0).otherwise(F.bround(best * 100, 1))
