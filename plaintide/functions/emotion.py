"""Emotion expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaintide.functions.matching import APOSTROPHE_EDGES, KeywordGroup, first_best, texts
from plaintide.rules.emotion import (
    EMOTION_KEYWORDS,
    EMOTION_WEIGHTS,
    INTENSIFIERS,
    NEGATION_FACTORS,
    NEGATIONS,
    NEGATIVE_EMOTIONS,
    POSITIVE_EMOTIONS,
)

HITS = "_emotion_hits"
GROUPS = {e: KeywordGroup(terms, APOSTROPHE_EDGES, HITS) for e, terms in EMOTION_KEYWORDS.items()}


def spaced_words(words: Column) -> Column:
    """The words of a text with one space before and after each."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def boost(first_word: str) -> str:
    """Factor of a hit: 1.5 if an intensifier stands before the first word starting like it.

    SQL over `_spaced`, the spaced words of the text.
    """
    before = f"substring_index(_spaced, concat(' ', {first_word}), 1)"
    return f"if(substring_index({before}, ' ', -1) IN ({texts(INTENSIFIERS)}), 1.5D, 1.0D)"


def has_negation(text: Column) -> Column:
    # Every negation holds one of the three substrings, so most texts settle without the regex.
    hinted = text.contains("no") | text.contains("never") | text.contains("n't")
    return hinted & text.rlike(r"(?U)\b(" + "|".join(NEGATIONS) + r")\b")


def emotion_score(emotion: str, boosted: Column, negated: Column) -> Column:
    score = boosted * float(EMOTION_WEIGHTS[emotion])
    factor = NEGATION_FACTORS.get(emotion)
    return score if factor is None else F.when(negated, score * factor).otherwise(score)


def too_short(text: Column) -> Column:
    """Fewer than three characters once trimmed."""
    return F.coalesce(text.rlike(r"(?U)^\s*(\S\S?)?\s*$"), F.lit(True))


def emotion_label(text: Column, scores: dict[str, Column], best: Column) -> Column:
    return F.when(too_short(text) | (best == 0), "Neutral").otherwise(first_best(scores, best))


def emotion_confidence(text: Column, best: Column, total: Column) -> Column:
    share = F.when(total > 0, best / total)
    return F.when(too_short(text), 50.0).when(best == 0, 55.0).otherwise(
        F.bround(F.least(F.lit(95.0), 50 + share * 45), 1)
    )


def reconciled(emotion: Column, confidence: Column, sentiment: Column) -> tuple[Column, Column]:
    """Emotion and confidence brought in line with the sentiment."""
    cheerful = emotion.isin(POSITIVE_EMOTIONS)
    gloomy = emotion.isin(NEGATIVE_EMOTIONS)
    neutral = emotion == "Neutral"
    replacement = (
        F.when((sentiment == "Negative") & (cheerful | neutral), "Disappointed")
        .when((sentiment == "Positive") & (gloomy | neutral), "Satisfied")
        .when((sentiment == "Neutral") & cheerful & (confidence < 70), "Neutral")
    )
    return (
        F.coalesce(replacement, emotion),
        F.when(replacement.isNotNull(), 60.0).otherwise(confidence),
    )
