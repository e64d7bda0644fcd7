"""One query per operator, each over whole tables."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.fixture import feedback, table
from plaintide import ColumnRoles, TextSentiment, analyze, enrich
from plaintide.functions import sentiment as sen
from plaintide.functions.lexicon import seed_lexicon
from plaintide.functions.text import clean_text, word_count
from plaintide.operators import (
    cleaning,
    columns,
    insights,
    issues,
    lexicon,
    model,
    recommend,
    recurring,
    report,
    scoring,
    single,
    themes,
    trends,
    vectors,
)
from plaintide.runtime import checkpoint_folder, cut_lineage
from plaintide.sources import csv, tables

ROLES = ColumnRoles(date="date", rating="rating", category="feedback_category")
TEXT = "feedback"


def cleaned(spark, sf) -> DataFrame:
    return cleaning.clean_records(feedback(spark, sf), ROLES)


def enriched(spark, sf, *columns) -> DataFrame:
    """The cleaned rows with the named scorer outputs, or all of them."""
    return enrich(cleaned(spark, sf), ROLES, list(columns) or None)


ISSUE = ("sentiment", "detected_issue", "is_complaint")


def analysis(spark, sf):
    return analyze(feedback(spark, sf), ROLES)


def complaints(spark, sf) -> DataFrame:
    return recurring.complaint_rows(enriched(spark, sf, *ISSUE), TEXT)


def complaint_texts(spark, sf) -> DataFrame:
    """Written once, as the term and theme operators read it several times."""
    return cut_lineage(recurring.complaint_texts(complaints(spark, sf), ROLES))


def document_texts(spark, sf) -> DataFrame:
    """The distinct documents with at least two words, grouped by language."""
    docs = cleaning.clean_feedback(table(spark, sf, "documents"), "text")
    docs = cleaning.min_words(docs, "text").withColumnRenamed("lang", "issue_label")
    return cut_lineage(recurring.complaint_texts(docs, ColumnRoles(feedback="text", key="doc_id")))


# Sources, sinks and column roles


def read_feedback_table(spark, sf):
    orders = tables.read_feedback_table(spark, f"{sf}/orders.parquet")
    return orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


def csv_round_trip(spark, sf):
    path = f"{checkpoint_folder(spark)}/analyzed-{uuid.uuid4().hex}"
    csv.write_analyzed_csv(enriched(spark, sf), path)
    return csv.read_feedback_csv(spark, path).select(
        "feedback_id", "customer_id", "product", "channel", "rating", "feedback_category", "feedback",
        "sentiment", "emotion", "topic", "detected_issue", "priority", "priority_score",
    )


def csv_codes(spark, sf):
    """Codes that casts would take for numbers, and texts with line breaks, as they were written."""
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey"), F.concat("o_orderkey", F.lit("d")).alias("code"), F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat_ws("\n", "o_orderpriority", F.lit('said "no"')))
        .otherwise(F.col("o_orderstatus")).alias("note"))
    path = f"{checkpoint_folder(spark)}/codes-{uuid.uuid4().hex}"
    csv.write_analyzed_csv(orders, path)
    return csv.read_feedback_csv(spark, path)


def normalize_headers(spark, sf):
    docs = table(spark, sf, "documents")
    return cleaning.normalize_headers(docs.toDF(" doc_id ", "label", "label ", " label", "n_chars")).select(
        "doc_id", "label_1", "label_2", "n_chars"
    )


def training_rows(spark, sf):
    rated = scoring.score_sentiment(cleaned(spark, sf), TEXT, "rating")
    return model.training_rows(rated, TEXT, "sentiment", "feedback_id")


def preview(spark, sf):
    return report.preview(feedback(spark, sf).select("feedback_id", "product", TEXT), "feedback_id")


def non_null_count(spark, sf):
    return report.non_null_count(feedback(spark, sf), TEXT)


def text_lengths(spark, sf):
    return columns.text_lengths(table(spark, sf, "documents"))


def feedback_column(spark, sf):
    df = table(spark, sf, "conversations").withColumnRenamed("text", "utterance")
    name = columns.detect_feedback_column(df)
    return df.agg(F.lit(name).alias("column"), F.count(name).alias("values"))


def date_column(spark, sf):
    df = table(spark, sf, "orders")
    name = columns.detect_date_column(df)
    return df.agg(F.lit(name).alias("column"), F.count(name).alias("values"))


def numeric_ranges(spark, sf):
    return columns.numeric_ranges(table(spark, sf, "events"))


def rating_column(spark, sf):
    df = feedback(spark, sf).withColumn("points", F.col("customer_id") % 5 + 1).drop("rating")
    name = columns.detect_rating_column(df)
    return df.agg(F.lit(name).alias("column"), F.count(name).alias("values"))


def category_candidates(spark, sf):
    return columns.category_candidates(feedback(spark, sf), TEXT)


def category_column(spark, sf):
    df = feedback(spark, sf)
    name = columns.detect_category_column(df, TEXT)
    return df.agg(F.lit(name).alias("column"), F.count(name).alias("values"))


def csv_quality(spark, sf):
    """Rows whose fields are all missing count as received and missing."""
    path = f"{checkpoint_folder(spark)}/feedback-{uuid.uuid4().hex}"
    rows = feedback(spark, sf).select(F.when(F.col(TEXT).isNotNull(), F.col("channel")).alias("channel"), TEXT)
    csv.write_analyzed_csv(rows, path)
    return cleaning.quality_report(csv.read_feedback_csv(spark, path), ColumnRoles())


# Cleaning


def drop_missing(spark, sf):
    return cleaning.drop_missing(feedback(spark, sf), TEXT).select("feedback_id", TEXT)


def clean_feedback(spark, sf):
    return cleaning.clean_feedback(feedback(spark, sf), TEXT).select("feedback_id", TEXT)


def clean_conversations(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", clean_text(F.col("text")).alias("text"),
        word_count(clean_text(F.col("text"))).cast("bigint").alias("words"),
    )


def drop_empty(spark, sf):
    return cleaning.drop_empty(cleaning.clean_feedback(feedback(spark, sf), TEXT), TEXT).select(
        "feedback_id", TEXT
    )


def dedupe_records(spark, sf):
    kept = cleaning.drop_empty(cleaning.clean_feedback(feedback(spark, sf), TEXT), TEXT)
    return cleaning.dedupe_records(kept, TEXT).select("feedback_id", "customer_id", "product", TEXT)


def dedupe_documents(spark, sf):
    docs = cleaning.clean_feedback(table(spark, sf, "documents").select("doc_id", "lang", "text"), "text")
    return cleaning.dedupe_records(docs, "text", "doc_id").select("doc_id", "lang", "text")


def min_words(spark, sf):
    docs = cleaning.clean_feedback(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return cleaning.min_words(docs, "text").select("doc_id")


def clean_records(spark, sf):
    return cleaned(spark, sf).select("feedback_id", "customer_id", "channel", "rating", TEXT)


def assign_feedback_id(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return cleaning.assign_feedback_id(turns, ["conv_id", "turn"])


def keep_feedback_id(spark, sf):
    return cleaning.assign_feedback_id(cleaned(spark, sf)).select("feedback_id", TEXT)


def quality_report(spark, sf):
    return cleaning.quality_report(feedback(spark, sf), ROLES)


def quality_of_documents(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return cleaning.quality_report(docs, ColumnRoles(feedback="text", key="doc_id"))


# Sentiment


def rating_to_sentiment(spark, sf):
    return feedback(spark, sf).select(
        "feedback_id", sen.rating_to_sentiment(F.col("rating")).alias("sentiment")
    )


def keyword_sentiment(spark, sf):
    scored = scoring.with_keyword_probabilities(cleaned(spark, sf), TEXT, "p")
    return scored.select("feedback_id", "p.negative", "p.neutral", "p.positive")


def lexicon_sentiment(spark, sf):
    return lexicon.with_compound(cleaned(spark, sf), TEXT).select("feedback_id", "compound")


def lexicon_labels(spark, sf):
    df = lexicon.with_lexicon_probabilities(cleaned(spark, sf), TEXT, "probs")
    scored = scoring.score_sentiment(df, TEXT, probabilities="probs")
    return scored.select("feedback_id", "sentiment", "sentiment_confidence")


def compound_to_probabilities(spark, sf):
    orders = table(spark, sf, "orders")
    compound = (F.col("o_orderkey") % 201).cast("double") / 100 - 1
    scored = orders.select("o_orderkey", sen.compound_to_probabilities(compound).alias("p"))
    return scored.select(
        "o_orderkey", *[F.bround(f"p.{c}", 9).alias(c) for c in ("negative", "neutral", "positive")]
    )


def ensemble_probabilities(spark, sf):
    """Stand-in scores from two numeric columns, each missing for some rows."""
    df = scoring.with_keyword_probabilities(cleaned(spark, sf), TEXT, "k")
    first = F.when(F.col("rating").isNotNull(), sen.compound_to_probabilities(F.col("rating") / 3 - 1))
    second = F.when(
        F.col("channel").isNotNull(),
        sen.compound_to_probabilities((F.col("customer_id") % 201).cast("double") / 100 - 1),
    )
    mixed = sen.ensemble_probabilities(F.col("m"), F.col("l"), F.col("k"))
    return df.withColumns({"m": first, "l": second}).withColumn("p", mixed).select(
        "feedback_id",
        *[F.bround(f"p.{c}", 12).alias(c) for c in ("negative", "neutral", "positive")],
    )


def model_probabilities(spark, sf):
    """Predictions of a model with given weights: the 400 terms that most texts hold, weights by a rule."""
    texts = cut_lineage(cleaned(spark, sf).select(F.col(TEXT).alias("text")).distinct()
                        .withColumn("id", F.monotonically_increasing_id()))
    counts = cut_lineage(model.term_counts(texts))
    holding = counts.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("n"))
    known = holding.orderBy(F.desc("n"), "term").limit(400).toPandas()
    given = model.TextModel(
        known["term"].tolist(), np.log((1 + texts.count()) / (1 + known["n"].to_numpy())) + 1,
        np.array([(known["n"].to_numpy() * c % 7 - 3) / 2 for c in (1, 2, 3)]), np.array([0.1, 0.0, -0.2]))
    scored = given.with_probabilities(cleaned(spark, sf), TEXT, "p")
    return scored.select("feedback_id", *[F.bround(f"p.{c}", 9).alias(c) for c in model.SHARES])


def text_model_confusion(spark, sf):
    rows = cut_lineage(training_rows(spark, sf))
    trained = model.train_text_model(rows)
    scored = trained.with_probabilities(rows, "text", "p")
    return scored.groupBy("label", model.predicted_label(F.col("p")).alias("predicted")).agg(
        F.count("*").alias("texts")
    )


def text_model_labels(spark, sf):
    """The analysis' sentiment with the trained model and the lexicon together."""
    trained = model.train_text_model(cut_lineage(training_rows(spark, sf)))
    df = lexicon.with_lexicon_probabilities(cleaned(spark, sf), TEXT, "l")
    df = trained.with_probabilities(df, TEXT, "m")
    df = scoring.with_keyword_probabilities(df, TEXT, "k")
    probs = sen.ensemble_probabilities(F.col("m"), F.col("l"), F.col("k"))
    return df.withColumn("p", probs).select(
        "feedback_id", sen.text_label(F.col(TEXT), F.col("p")).alias("sentiment"),
        sen.text_confidence(F.col(TEXT), F.col("p")).alias("sentiment_confidence"),
    )


def cross_validated_accuracy(spark, sf):
    return model.cross_validated_accuracy(training_rows(spark, sf))


def training_folds(spark, sf):
    """How many texts of each label every fold holds."""
    return model.training_folds(training_rows(spark, sf)).groupBy("label", F.col("fold").cast("bigint").alias("fold")).agg(
        F.count("*").alias("texts")
    )


def enriched_with_lexicon(spark, sf):
    names = ["sentiment", "sentiment_confidence", "sentiment_source", "emotion", "detected_issue", "is_complaint", "priority"]
    found = enrich(cleaned(spark, sf), ROLES, names, TextSentiment(lexicon=seed_lexicon()))
    return found.select("feedback_id", *names)


def text_sentiment(spark, sf):
    scored = scoring.score_sentiment(cleaned(spark, sf), TEXT)
    return scored.select("feedback_id", "sentiment", "sentiment_confidence", "sentiment_source")


def score_sentiment(spark, sf):
    scored = scoring.score_sentiment(cleaned(spark, sf), TEXT, "rating")
    return scored.select("feedback_id", "sentiment", "sentiment_confidence", "sentiment_source")


def sentiment_agreement(spark, sf):
    given = cleaned(spark, sf).withColumn("sentiment", sen.rating_to_sentiment(F.col("rating")))
    return scoring.sentiment_agreement(scoring.score_sentiment(given, TEXT))


# Emotion and topic


def emotion_keyword_hits(spark, sf):
    found = scoring.emotion_keyword_hits(cleaned(spark, sf), TEXT)
    return found.select("feedback_id", *[c for c in found.columns if c.startswith("hits_")])


def intensifier_boost(spark, sf):
    found = scoring.emotion_keyword_hits(cleaned(spark, sf), TEXT)
    return found.select("feedback_id", *[c for c in found.columns if c.startswith("boosted_")])


def emotion_scores(spark, sf):
    found = scoring.with_emotion_scores(cleaned(spark, sf), TEXT)
    return found.select(
        "feedback_id",
        *[F.bround(c, 9).alias(f"score_{e.lower()}") for e, c in scoring.EMOTION_COLUMNS.items()],
    )


def detect_emotion(spark, sf):
    found = scoring.detect_emotion(cleaned(spark, sf), TEXT)
    return found.select("feedback_id", "emotion", "emotion_confidence")


def score_emotion(spark, sf):
    scored = scoring.score_sentiment(cleaned(spark, sf), TEXT, "rating")
    found = scoring.score_emotion(scored, TEXT)
    return found.select("feedback_id", "sentiment", "emotion", "emotion_confidence")


def topic_scores(spark, sf):
    found = scoring.topic_scores(cleaned(spark, sf), TEXT)
    return found.select("feedback_id", *scoring.TOPIC_COLUMNS.values())


def detect_topic(spark, sf):
    found = scoring.detect_topic(cleaned(spark, sf), TEXT)
    return found.select("feedback_id", "topic_detected", "topic_confidence")


def score_topic(spark, sf):
    found = scoring.score_topic(cleaned(spark, sf), TEXT, "feedback_category")
    return found.select("feedback_id", "topic_detected", "topic", "topic_confidence", "topic_source")


def topic_distribution(spark, sf):
    return issues.topic_distribution(scoring.score_topic(cleaned(spark, sf), TEXT, "feedback_category"))


def topic_agreement(spark, sf):
    return issues.topic_agreement(scoring.score_topic(cleaned(spark, sf), TEXT, "feedback_category"))


# Issues and priority


def issue_matches(spark, sf):
    found = scoring.issue_matches(cleaned(spark, sf), TEXT)
    return found.select("feedback_id", *[c for c in found.columns if c.startswith("is_")])


def detect_issue(spark, sf):
    scored = scoring.score_sentiment(cleaned(spark, sf), TEXT, "rating")
    found = scoring.score_issue(scored, TEXT)
    return found.select("feedback_id", "sentiment", "detected_issue", "issue_confidence")


def is_complaint(spark, sf):
    scored = scoring.score_sentiment(cleaned(spark, sf), TEXT, "rating")
    return scoring.score_issue(scored, TEXT).select("feedback_id", "sentiment", "is_complaint")


def issue_summary(spark, sf):
    """Cleaning, sentiment and issue rules up to the summary."""
    scored = scoring.score_sentiment(cleaned(spark, sf), TEXT, "rating")
    summary = issues.issue_summary(scoring.score_issue(scored, TEXT))
    return summary.withColumn("avg_confidence", F.bround("avg_confidence", 9))


def issue_priority_mode(spark, sf):
    return issues.issue_priority_mode(enriched(spark, sf, "detected_issue", "priority"), ["HIGH", "MEDIUM"])


def priority_score(spark, sf):
    return enriched(spark, sf, "priority_score").select("feedback_id", "priority_score")


def score_priority(spark, sf):
    return enriched(spark, sf, "priority", "priority_score").select("feedback_id", "priority", "priority_score")


def priority_reasons(spark, sf):
    return enriched(spark, sf, "priority_reasons").select(
        "feedback_id", F.array_join("priority_reasons", "; ").alias("reasons")
    )


def priority_distribution(spark, sf):
    return issues.priority_distribution(enriched(spark, sf, "priority"))


def enriched_rows(spark, sf):
    return enriched(spark, sf).select(
        "feedback_id", "sentiment", "sentiment_confidence", "sentiment_source", "emotion",
        "emotion_confidence", "topic", "topic_confidence", "topic_source", "detected_issue",
        "issue_confidence", "is_complaint", "priority", "priority_score",
    )


# Recurring issues


def complaint_rows(spark, sf):
    return complaints(spark, sf).select("feedback_id", "issue_label")


def _recurring(spark, sf):
    return recurring.recurring_counts(enriched(spark, sf, *ISSUE), ROLES)


def recurring_counts(spark, sf):
    return _recurring(spark, sf).select("issue_label", "occurrences", "percentage", "avg_sentiment")


def recurring_priority(spark, sf):
    return _recurring(spark, sf).select("issue_label", "priority")


def recurring_rating(spark, sf):
    return _recurring(spark, sf).select("issue_label", "avg_rating")


def sample_feedbacks(spark, sf):
    found = recurring.sample_feedbacks(complaint_texts(spark, sf))
    return found.select("issue_label", F.array_join("sample_feedbacks", " | ").alias("samples"))


def top_product(spark, sf):
    return recurring.top_segment(complaints(spark, sf), "product")


def top_channel(spark, sf):
    return recurring.top_segment(complaints(spark, sf), "channel")


def ranked_terms(spark, sf):
    return vectors.ranked_terms(complaint_texts(spark, sf))


def top_terms(spark, sf):
    found = vectors.top_terms(vectors.ranked_terms(complaint_texts(spark, sf)))
    return found.select("issue_label", F.array_join("keywords", ", ").alias("keywords"))


def similarity_links(spark, sf):
    found = themes.similarity_links(complaint_texts(spark, sf))
    return found.select("issue_label", "a", "b")


def theme_members(spark, sf):
    return themes.theme_members(complaint_texts(spark, sf))


def theme_examples(spark, sf):
    texts = complaint_texts(spark, sf)
    return themes.themes(texts, themes.theme_members(texts))


def document_theme_members(spark, sf):
    return themes.theme_members(document_texts(spark, sf))


def recurring_issues(spark, sf):
    found = analysis(spark, sf).recurring_issues
    return found.select(
        "rank", "issue_label", "occurrences", "percentage", "avg_sentiment", "priority", "avg_rating",
        "cluster_id", "top_product", "top_product_count", "top_channel", "top_channel_count",
        F.array_join("sample_feedbacks", " | ").alias("samples"),
        F.array_join(F.transform("themes", lambda t: t["example"]), " | ").alias("themes"),
        F.array_join(F.transform("themes", lambda t: t["count"].cast("string")), ", ").alias("theme_counts"),
        F.array_join("keywords", ", ").alias("keywords"),
    )


def recurring_themes_repeated_ids(spark, sf):
    """Ids that repeat are replaced, so themes are those of the same rows with ids of their own."""
    repeated = feedback(spark, sf).withColumn("feedback_id", F.col("feedback_id") % 1000)
    found = analyze(repeated, ROLES).recurring_issues
    return found.select(
        "issue_label", "occurrences", "percentage", "priority",
        F.array_join(F.transform("themes", lambda t: t["count"].cast("string")), ", ").alias("theme_counts"),
    )


# Trends


def with_period(spark, sf):
    return trends.with_period(feedback(spark, sf), "date").select("feedback_id", "period")


def volume_trend(spark, sf):
    return trends.volume_trend(trends.with_period(cleaned(spark, sf), "date"))


def text_dates(spark, sf):
    """Dates as texts in several layouts, most of them with the day first."""
    layouts = ["d/M/yyyy", "dd/MM/yyyy HH:mm", "yyyy-MM-dd", "MMMM d, yyyy", "yyyyMMdd", "dd-MMM-yyyy", "d/M/yyyy h:mm a"]
    texts = F.coalesce(*[
        F.when(F.col("o_orderkey") % len(layouts) == i, F.date_format("o_orderdate", x)) for i, x in enumerate(layouts)
    ])
    return trends.volume_trend(trends.with_period(table(spark, sf, "orders").select(texts.alias("date")), "date"))


def text_date_shapes(spark, sf):
    """Dates as texts with weekdays, ordinals, months alone, full stops and two-digit years."""
    layouts = ["EEE, dd MMM yyyy", "d'th' MMMM yyyy", "MMMM yyyy", "M/d/yy", "yyyy.M.d", "MMM d, yyyy h:mm a"]
    texts = F.coalesce(*[
        F.when(F.col("o_orderkey") % len(layouts) == i, F.date_format("o_orderdate", x)) for i, x in enumerate(layouts)
    ])
    return trends.volume_trend(trends.with_period(table(spark, sf, "orders").select(texts.alias("date")), "date"))


def event_volume_trend(spark, sf):
    return trends.volume_trend(trends.with_period(table(spark, sf, "events"), "ts"))


def sentiment_trend(spark, sf):
    scored = scoring.score_sentiment(cleaned(spark, sf), TEXT, "rating")
    return trends.sentiment_trend(trends.with_period(scored, "date"))


def topic_trend(spark, sf):
    scored = scoring.score_topic(cleaned(spark, sf), TEXT, "feedback_category")
    return trends.topic_trend(trends.with_period(scored, "date"))


def issue_trend(spark, sf):
    return trends.issue_trend(trends.with_period(enriched(spark, sf, "detected_issue"), "date"))


# Insights


def _ranked(spark, sf):
    return recurring.ranked_by_volume(_recurring(spark, sf))


def insight_negative_rate(spark, sf):
    return insights.negative_rate(enriched(spark, sf, "sentiment"))


def insight_positive_rate(spark, sf):
    """Large orders count as positive here, so that the rule fires."""
    label = F.when(F.col("o_totalprice") > 100_000, "Positive").otherwise("Neutral")
    return insights.positive_rate(table(spark, sf, "orders").select(label.alias("sentiment")))


def insight_top_topic(spark, sf):
    return insights.top_topic(enriched(spark, sf, "topic"))


def insight_worst_topic(spark, sf):
    return insights.worst_topic(enriched(spark, sf, "sentiment", "topic"))


def insight_high_priority(spark, sf):
    return insights.high_priority_share(enriched(spark, sf, "priority"))


def insight_top_recurring(spark, sf):
    return insights.top_recurring(_ranked(spark, sf))


def insight_systemic(spark, sf):
    return insights.systemic_issues(_recurring(spark, sf))


def insight_emotion(spark, sf):
    return insights.dominant_emotion(enriched(spark, sf, "emotion"))


def insight_complaint_rate(spark, sf):
    return insights.complaint_rate(enriched(spark, sf, "is_complaint"))


def insight_rising_negatives(spark, sf):
    return insights.rising_negative_trend(sentiment_trend(spark, sf))


def insight_rising_negatives_of_orders(spark, sf):
    """Orders count as negative ever more often over the years here, so that the rule fires."""
    bad = F.col("o_orderkey") % 10 < F.year("o_orderdate") - 1990
    label = F.when(bad, "Negative").otherwise("Neutral")
    orders = table(spark, sf, "orders").withColumn("sentiment", label)
    return insights.rising_negative_trend(trends.sentiment_trend(trends.with_period(orders, "o_orderdate")))


def rising_negatives(spark, sf):
    """The halves behind the trend rule, whatever their ratio."""
    found = trends.rising_negatives(sentiment_trend(spark, sf), factor=0.0)
    return found.select(
        "months", F.bround("first_half", 6).alias("first_half"),
        F.bround("second_half", 6).alias("second_half"),
    )


def all_insights(spark, sf):
    return analysis(spark, sf).insights


# Recommendations


def recommend_from_recurring(spark, sf):
    return recommend.recommend_from_recurring(_ranked(spark, sf))


def recommend_from_summary(spark, sf):
    """Without recurring issues, so every summary issue with enough rows gets its action."""
    return recommend.recommend_from_summary(issues.issue_summary(enriched(spark, sf, "sentiment", "detected_issue", "issue_confidence")))


def recommendations(spark, sf):
    found = analysis(spark, sf)
    return recommend.recommendations(found.recurring_core, found.issue_summary, ["HIGH", "MEDIUM"])


def recommendations_from_both(spark, sf):
    """With the first three recurring issues only, so that the summary has actions to add."""
    found = analysis(spark, sf)
    return recommend.recommendations(found.recurring_core.filter("rank <= 3"), found.issue_summary)


def text_only_profile(spark, sf):
    found = single.text_only_profile(cleaned(spark, sf), TEXT, keep=["feedback_id"])
    return found.withColumn("priority_reasons", F.array_join("priority_reasons", "; ")).drop(
        TEXT, "recommendation_details"
    )


def conversation_profile(spark, sf):
    turns = table(spark, sf, "conversations").filter("text IS NOT NULL")
    found = single.text_only_profile(turns, "text", keep=["conv_id", "turn"])
    return found.select("conv_id", "turn", "sentiment", "detected_issue", "priority_score")


# Report tables and exploration


def kpi_summary(spark, sf):
    return report.kpi_summary(enriched(spark, sf, *ISSUE, "priority"))


def quality_table(spark, sf):
    return report.quality_table(quality_report(spark, sf))


def sentiment_table(spark, sf):
    return report.sentiment_table(scoring.score_sentiment(cleaned(spark, sf), TEXT, "rating"))


def recurring_table(spark, sf):
    return report.recurring_table(_ranked(spark, sf))


def report_insights(spark, sf):
    return report.first_by_order(analysis(spark, sf).insights)


def report_recommendations(spark, sf):
    return report.first_by_order(analysis(spark, sf).recommendations).select(
        "ord", "issue", "action", "priority", "department"
    )


def emotion_distribution(spark, sf):
    return report.value_distribution(enriched(spark, sf, "emotion"), "emotion")


def sentiment_distribution(spark, sf):
    return report.value_distribution(enriched(spark, sf, "sentiment"), "sentiment")


EXPLORED = ("sentiment", "sentiment_confidence", "emotion", "topic", "detected_issue", "priority")


def explore(spark, sf):
    return report.explore(
        enriched(spark, sf, *EXPLORED), TEXT, "feedback_id", sentiments=["Negative", "Neutral"],
        priorities=["HIGH", "MEDIUM"], search="refund|ORDER",
    )


def explore_count(spark, sf):
    found = report.matching_rows(
        enriched(spark, sf, "topic"), TEXT, topics=["Delivery", "Billing"], search="(box|item) "
    )
    return found.agg(F.count("*").alias("rows"))


def distinct_topics(spark, sf):
    return report.distinct_topics(enriched(spark, sf, "topic"))


HELPERS = {"cut_lineage", "cleaned", "enriched", "analysis", "complaints", "complaint_texts",
           "document_texts", "feedback", "table", "enrich", "analyze", "label_profile",
           "checkpoint_folder", "clean_text", "word_count"}


def registry() -> dict:
    """All queries by name."""
    return {
        name: function
        for name, function in globals().items()
        if callable(function) and getattr(function, "__module__", "") == __name__
        and not name.startswith("_") and name not in HELPERS and name != "registry"
    }
