"""Row scorers: sentiment, emotion, topic, issue and priority.

Every scorer is a list of layers, each a set of columns computed from the ones before, and needs no
shuffle. `score_all` runs the layers of all scorers side by side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plaintide.functions import emotion as emo
from plaintide.functions import issue as iss
from plaintide.functions import priority as pri
from plaintide.functions import sentiment as sen
from plaintide.functions import topic as top
from plaintide.functions.matching import keyword_hits
from plaintide.functions.text import WORD, WORD_OR_APOSTROPHE, folded, folded_both, single_spaced, tokens
from plaintide.operators.frames import computed_once, merged
from plaintide.rules.priority import IMPACT_TERMS, URGENCY_TERMS

Layers = list[dict[str, Column]]

SENTIMENT = ["sentiment", "sentiment_confidence", "sentiment_source"]
EMOTION = ["emotion", "emotion_confidence"]
TOPIC = ["topic_detected", "topic", "topic_confidence", "topic_source"]
ISSUE = ["detected_issue", "issue_confidence", "is_complaint"]
PRIORITY = ["priority", "priority_score", "priority_reasons"]


def _slug(label: str) -> str:
    return "_".join(label.lower().replace("/", " ").split())


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _nothing(kind: str) -> Column:
    return F.lit(None).cast(kind)


# Sentiment


def keyword_layers(feedback: str, name: str) -> Layers:
    positive, negative = sen.keyword_counts()
    return [
        {"_plain_words": sen.keyword_words(F.col(feedback))},
        {"_positive": positive, "_negative": negative},
        {name: sen.keyword_probabilities(F.col("_positive"), F.col("_negative"))},
    ]


def with_keyword_probabilities(df: DataFrame, feedback: str, name: str = "_probs") -> DataFrame:
    """Adds the class probabilities of the keyword scorer as a struct."""
    return computed_once(df, keyword_layers(feedback, name), [name])


def sentiment_layers(feedback: str, rating: str | None, probabilities: str | None) -> Layers:
    name = probabilities or "_probs"
    text, probs = F.col(feedback), F.col(name)
    rated = sen.rating_to_sentiment(F.col(rating)) if rating else _nothing("string")
    label, known = F.col("_label"), F.col("_rated")
    return [
        *([] if probabilities else keyword_layers(feedback, name)),
        {
            "_label": sen.text_label(text, probs),
            "_label_confidence": sen.text_confidence(text, probs),
            "_rated": rated,
        },
        {
            "_sentiment": F.coalesce(known, label),
            "_sentiment_confidence": F.when(known.isNull(), F.col("_label_confidence"))
            .when(known == label, 95.0)
            .otherwise(80.0),
            "_sentiment_source": F.when(known.isNull(), "text").otherwise("rating"),
        },
    ]


def _with_provided(df: DataFrame) -> DataFrame:
    """A `sentiment` column that is already there is kept as `sentiment_provided`."""
    if "sentiment" not in df.columns:
        return df
    return df.withColumn("sentiment_provided", F.col("sentiment")).drop("sentiment")


def _present(df: DataFrame, column: str | None) -> str | None:
    return column if column and column in df.columns else None


def _public(names: list[str]) -> dict[str, Column]:
    return {name: F.col(f"_{name}") for name in names}


def score_sentiment(
    df: DataFrame, feedback: str, rating: str | None = None, probabilities: str | None = None
) -> DataFrame:
    """Adds sentiment, its confidence and its source; a usable rating wins over the text.

    `probabilities` names a struct column with the class probabilities of the text; without it the
    keyword scorer gives them.
    """
    df = _with_provided(df)
    layers = sentiment_layers(feedback, _present(df, rating), probabilities)
    return computed_once(df, layers, _public(SENTIMENT))


def sentiment_agreement(df: DataFrame) -> DataFrame:
    """Share of rows whose provided sentiment equals the one found; one row."""
    both = F.col("sentiment_provided").isNotNull()
    same = F.when(both, (F.col("sentiment") == F.col("sentiment_provided")).cast("int"))
    return df.agg(F.count(same).alias("compared"), F.avg(same).alias("agreement"))


# Emotion

EMOTION_COLUMNS = {e: f"_emotion_{_slug(e)}" for e in emo.GROUPS}


def _text_layer(feedback: str) -> dict[str, Column]:
    return {"_text": single_spaced(folded(F.col(feedback)))}


def _emotion_word_layers(feedback: str) -> Layers:
    text, words = F.col("_text"), F.col("_emotion_words")
    return [
        _text_layer(feedback),
        {"_emotion_words": tokens(text, WORD_OR_APOSTROPHE), "_negated": emo.has_negation(text)},
        {
            emo.HITS: keyword_hits("_emotion_words", list(emo.GROUPS.values())),
            "_spaced": emo.spaced_words(words),
        },
    ]


def emotion_keyword_hits(df: DataFrame, feedback: str) -> DataFrame:
    """Adds `hits_<emotion>`, the number of listed keywords found, and its boosted sum."""
    counted = {f"hits_{_slug(e)}": g.count_hits() for e, g in emo.GROUPS.items()}
    boosted = {f"boosted_{_slug(e)}": g.boosted_hits(emo.boost) for e, g in emo.GROUPS.items()}
    layers = [*_emotion_word_layers(feedback), {**counted, **boosted}]
    return computed_once(df, layers, [*counted, *boosted])


def emotion_score_layers(feedback: str) -> Layers:
    scores = {
        EMOTION_COLUMNS[e]: emo.emotion_score(e, g.boosted_hits(emo.boost), F.col("_negated"))
        for e, g in emo.GROUPS.items()
    }
    return [*_emotion_word_layers(feedback), scores]


def with_emotion_scores(df: DataFrame, feedback: str) -> DataFrame:
    """Adds one score column per emotion (EMOTION_COLUMNS)."""
    return computed_once(df, emotion_score_layers(feedback), list(EMOTION_COLUMNS.values()))


def emotion_layers(feedback: str) -> Layers:
    scores = {e: F.col(c) for e, c in EMOTION_COLUMNS.items()}
    text, best, total = F.col(feedback), F.col("_emotion_best"), F.col("_emotion_total")
    return [
        *emotion_score_layers(feedback),
        {"_emotion_best": F.greatest(*scores.values()), "_emotion_total": _sum(scores.values())},
        {
            "_raw_emotion": emo.emotion_label(text, scores, best),
            "_raw_confidence": emo.emotion_confidence(text, best, total),
        },
    ]


def _reconciled_layer(emotion: str, confidence: str, sentiment: str) -> dict[str, Column]:
    label, sure = emo.reconciled(F.col(emotion), F.col(confidence), F.col(sentiment))
    return {"_emotion": label, "_emotion_confidence": sure}


def detect_emotion(df: DataFrame, feedback: str) -> DataFrame:
    """Adds emotion and emotion_confidence from the text alone."""
    named = {"emotion": F.col("_raw_emotion"), "emotion_confidence": F.col("_raw_confidence")}
    return computed_once(df, emotion_layers(feedback), named)


def reconcile_emotion(df: DataFrame) -> DataFrame:
    """Brings the emotion of scored rows in line with their sentiment."""
    layer = _reconciled_layer("emotion", "emotion_confidence", "sentiment")
    return computed_once(df, [layer], _public(EMOTION))


def score_emotion(df: DataFrame, feedback: str) -> DataFrame:
    """Emotion of the text, in line with the sentiment where there is one."""
    if "sentiment" not in df.columns:
        return detect_emotion(df, feedback)
    fixed = _reconciled_layer("_raw_emotion", "_raw_confidence", "sentiment")
    return computed_once(df, [*emotion_layers(feedback), fixed], _public(EMOTION))


# Topic

TOPIC_COLUMNS = {t: f"score_{_slug(t)}" for t in top.GROUPS}


def topic_score_layers(feedback: str) -> Layers:
    return [
        _text_layer(feedback),
        {"_topic_words": tokens(F.col("_text"), WORD)},
        {top.HITS: keyword_hits("_topic_words", list(top.GROUPS.values()))},
        {TOPIC_COLUMNS[t]: g.weighted_hits() for t, g in top.GROUPS.items()},
    ]


def topic_scores(df: DataFrame, feedback: str) -> DataFrame:
    """Adds one BIGINT score column per topic (TOPIC_COLUMNS)."""
    return computed_once(df, topic_score_layers(feedback), list(TOPIC_COLUMNS.values()))


def topic_layers(feedback: str, category: str | None) -> Layers:
    scores = {t: F.col(c) for t, c in TOPIC_COLUMNS.items()}
    best, total = F.col("_topic_best"), F.col("_topic_total")
    given = F.col("_given")
    return [
        *topic_score_layers(feedback),
        {
            "_topic_best": F.greatest(*scores.values()),
            "_topic_total": _sum(scores.values()),
            "_given": top.provided_category(F.col(category)) if category else _nothing("string"),
        },
        {
            "_topic_detected": top.topic_label(scores, best),
            "_detected_confidence": top.topic_confidence(best, total),
        },
        {
            "_topic": F.coalesce(given, F.col("_topic_detected")),
            "_topic_confidence": F.when(given.isNotNull(), 98.0).otherwise(
                F.col("_detected_confidence")
            ),
            "_topic_source": F.when(given.isNotNull(), "dataset").otherwise("detected"),
        },
    ]


def score_topic(df: DataFrame, feedback: str, category: str | None = None) -> DataFrame:
    """Adds the topic columns; a category given in the data wins over the detected topic."""
    layers = topic_layers(feedback, _present(df, category))
    return computed_once(df, layers, _public(TOPIC))


def detect_topic(df: DataFrame, feedback: str) -> DataFrame:
    """Adds topic_detected and topic_confidence from the text."""
    return score_topic(df, feedback).drop("topic", "topic_source")


# Issue


def issue_matches(df: DataFrame, feedback: str) -> DataFrame:
    """Adds one BOOLEAN column per issue label."""
    flags = {f"is_{_slug(i)}": iss.matches_issue(i) for i in iss.ISSUE_PATTERNS}
    return computed_once(df, [{"_issue_text": folded_both(F.col(feedback))}, flags], list(flags))


def issue_layers(feedback: str, sentiment: Column) -> Layers:
    # A positive text reports no issue whatever it says, so its rules need not run.
    happy = F.coalesce(sentiment == "Positive", F.lit(False))
    match = F.col("_match")
    return [
        {"_issue_text": folded_both(F.col(feedback))},
        {"_match": F.when(~happy, iss.first_match())},
        {
            "_detected_issue": iss.issue_label(match, sentiment),
            "_issue_confidence": iss.issue_confidence(match, sentiment),
            "_is_complaint": iss.is_complaint(match, sentiment),
        },
    ]


def score_issue(df: DataFrame, feedback: str) -> DataFrame:
    """Adds detected_issue, issue_confidence and is_complaint."""
    sentiment = F.col("sentiment") if "sentiment" in df.columns else _nothing("string")
    return computed_once(df, issue_layers(feedback, sentiment), _public(ISSUE))


# Priority


def signal_layers(feedback: str, rating: str | None) -> Layers:
    value = F.col(rating).try_cast("double") if rating else F.lit(5.0)
    return [
        {"_lower_text": F.lower(F.col(feedback)), "_points_rating": value},
        {"_urgency": pri.terms_found(URGENCY_TERMS), "_impact": pri.terms_found(IMPACT_TERMS)},
    ]


def priority_layers(sentiment: Column, emotion: Column, complaint: Column, issue: Column) -> Layers:
    labels = (sentiment, emotion, complaint, issue)
    signals = (F.col("_urgency"), F.col("_impact"), F.col("_points_rating"))
    return [
        {"_priority_score": pri.priority_score(*labels, *signals)},
        {
            "_priority": pri.classify_priority(F.col("_priority_score")),
            "_priority_reasons": pri.priority_reasons(*labels, *signals),
        },
    ]


def score_priority(df: DataFrame, feedback: str, rating: str | None = "rating") -> DataFrame:
    """Adds priority, priority_score and priority_reasons.

    Points for a low rating come from the column named `rating` whatever the rating role is.
    """

    def label(name: str, default) -> Column:
        return F.col(name) if name in df.columns else F.lit(default)

    layers = [
        *signal_layers(feedback, _present(df, rating)),
        *priority_layers(
            label("sentiment", "Neutral"), label("emotion", "Neutral"),
            label("is_complaint", False), label("detected_issue", ""),
        ),
    ]
    return computed_once(df, layers, _public(PRIORITY))


# All of them


def score_all(
    df: DataFrame,
    feedback: str,
    rating: str | None = None,
    category: str | None = None,
    probabilities: str | None = None,
    outputs: list[str] | None = None,
) -> DataFrame:
    """The same columns as all scorers in order, with their layers side by side.

    `outputs` names the columns that are wanted (all by default). Only the scorers that these need run:
    nothing behind the generator of `computed_once` is pruned, so what is not read must not be built.
    """
    every = [*SENTIMENT, *EMOTION, *TOPIC, *ISSUE, *PRIORITY]
    unknown = set(outputs or ()) - set(every)
    if unknown:
        raise ValueError(f"no scorer gives {sorted(unknown)}")
    names = [n for n in every if outputs is None or n in outputs]

    def wanted(group: list[str]) -> bool:
        return any(n in names for n in group)

    priority = wanted(PRIORITY)
    issue = priority or wanted(ISSUE)
    emotion = priority or wanted(EMOTION)
    if "sentiment" in names:
        df = _with_provided(df)
    sentiment = F.col("_sentiment")
    before = merged(
        sentiment_layers(feedback, _present(df, rating), probabilities)
        if issue or emotion or wanted(SENTIMENT) else [],
        emotion_layers(feedback) if emotion else [],
        topic_layers(feedback, _present(df, category)) if wanted(TOPIC) else [],
        signal_layers(feedback, _present(df, "rating")) if priority else [],
    )
    reconciled = [_reconciled_layer("_raw_emotion", "_raw_confidence", "_sentiment")]
    layers = [
        *before,
        *merged(issue_layers(feedback, sentiment) if issue else [], reconciled if emotion else []),
        *(
            priority_layers(sentiment, F.col("_emotion"), F.col("_is_complaint"), F.col("_detected_issue"))
            if priority else []
        ),
    ]
    return computed_once(df, layers, _public(names))


def score_text_only(df: DataFrame, feedback: str, probabilities: str | None = None) -> DataFrame:
    """Every scorer on the text alone: no rating, no category, no scorer knows another's result but
    the priority."""
    before = merged(
        sentiment_layers(feedback, None, probabilities),
        emotion_layers(feedback),
        topic_layers(feedback, None),
        issue_layers(feedback, _nothing("string")),
        signal_layers(feedback, None),
    )
    priority = priority_layers(
        F.col("_sentiment"), F.col("_raw_emotion"), F.col("_is_complaint"), F.col("_detected_issue")
    )
    renamed = {"emotion": F.col("_raw_emotion"), "emotion_confidence": F.col("_raw_confidence")}
    topic = ["topic", "topic_confidence"]
    names = [*SENTIMENT[:2], *topic, *ISSUE, *PRIORITY]
    return computed_once(df, [*before, *priority], {**_public(names), **renamed})
