"""The analysis of a feedback table: enriched rows and everything derived from them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from plaintide.operators import (
    cleaning,
    columns,
    insights,
    issues,
    recommend,
    recurring,
    report,
    scoring,
    themes,
    trends,
    vectors,
)
from plaintide.operators.frames import PROFILE, label_profile
from plaintide.operators.text_sentiment import TextSentiment
from plaintide.roles import ColumnRoles
from plaintide.runtime import cut_lineage


PROBABILITIES = "_text_probabilities"


def detect_roles(df: DataFrame, key: str = "feedback_id") -> ColumnRoles:
    """Roles guessed from the column names and, failing that, the values."""
    feedback = columns.detect_feedback_column(df)
    return ColumnRoles(
        feedback=feedback,
        date=columns.detect_date_column(df),
        rating=columns.detect_rating_column(df),
        category=columns.detect_category_column(df, feedback),
        key=key,
    )


def enrich(
    cleaned: DataFrame,
    roles: ColumnRoles,
    columns: list[str] | None = None,
    text_sentiment: TextSentiment | None = None,
) -> DataFrame:
    """All row scorers, or those that `columns` need; no shuffle.

    `text_sentiment` says where a text's class probabilities come from; keywords by default.
    """
    if text_sentiment is None:
        return scoring.score_all(cleaned, roles.feedback, roles.rating, roles.category, outputs=columns)
    given = text_sentiment.add(cleaned, roles.feedback, PROBABILITIES)
    scored = scoring.score_all(given, roles.feedback, roles.rating, roles.category, PROBABILITIES, columns)
    return scored.drop(PROBABILITIES)


class Analysis:
    """Lazy results of one table. Build it with `analyze`.

    `records` are the distinct records with their copy counts, written once; ids, quality counters and all scored
    rows come from there. `scored` may already hold the enriched rows.
    """

    def __init__(self, records: DataFrame, cleaned: DataFrame, roles: ColumnRoles,
                 text_sentiment: TextSentiment | None = None, scored: DataFrame | None = None):
        self.records = records
        self.cleaned = cleaned
        self.roles = roles
        self.text_sentiment = text_sentiment
        self._scored = scored

    @cached_property
    def enriched(self) -> DataFrame:
        """The cleaned rows with the columns of all scorers, written."""
        if self._scored is not None:
            return self._scored
        return cut_lineage(enrich(self.cleaned, self.roles, text_sentiment=self.text_sentiment))

    @cached_property
    def labelled(self) -> DataFrame:
        """The cleaned rows with the label columns that the results below read, written.

        The enriched rows if these are there already; otherwise confidences and reasons are not computed.
        """
        if self._scored is not None or "enriched" in self.__dict__:
            return self.enriched
        return cut_lineage(enrich(self.cleaned, self.roles, PROFILE, self.text_sentiment))

    @cached_property
    def quality(self) -> DataFrame:
        return cleaning.quality_counters(self.records, self.roles.feedback)

    @cached_property
    def layouts(self) -> list[str] | None:
        """How dates in text are read, decided once."""
        date = self.roles.date
        if date in self.cleaned.columns and dict(self.cleaned.dtypes)[date] == "string":
            return trends.date_layouts(self.cleaned, date)
        return None

    @cached_property
    def dated(self) -> DataFrame | None:
        """The scored rows with a month; None without a date column."""
        date = self.roles.date
        if not date or date not in self.cleaned.columns:
            return None
        return trends.with_period(self.labelled, date, self.layouts)

    @cached_property
    def profile(self) -> DataFrame:
        """Label counts, from one pass over the scored rows; small, so kept."""
        date = self.roles.date
        if not date or date not in self.cleaned.columns:
            return cut_lineage(label_profile(self.labelled))
        return cut_lineage(label_profile(trends.add_period(self.labelled, date, self.layouts), "period"))

    @cached_property
    def issue_summary(self) -> DataFrame:
        return issues.issue_summary(self.profile)

    @cached_property
    def complaints(self) -> DataFrame:
        return recurring.complaint_rows(self.labelled, self.roles.feedback)

    @cached_property
    def complaint_texts(self) -> DataFrame:
        return cut_lineage(recurring.complaint_texts(self.complaints, self.roles))

    @cached_property
    def recurring_core(self) -> DataFrame:
        """The scalar columns of the recurring issues, ranked; a few rows, so kept."""
        counts = recurring.recurring_counts(self.labelled, self.roles)
        return cut_lineage(recurring.ranked_by_volume(counts))

    @cached_property
    def recurring_issues(self) -> DataFrame:
        """Recurring issues with samples, keywords, themes and the most affected segments."""
        texts = self.complaint_texts
        found = themes.themes(texts, themes.theme_members(texts))
        result = self.recurring_core
        parts = [
            recurring.sample_feedbacks(texts),
            vectors.top_terms(vectors.ranked_terms(texts)),
            themes.themes_array(found),
        ]
        segments = recurring.segments_of(self.labelled)
        parts += [recurring.top_segment(self.complaints, s) for s in segments]
        for part in parts:
            result = result.join(part, "issue_label", "left")
        return result.orderBy("rank")

    @cached_property
    def insights(self) -> DataFrame:
        return insights.insights(self.profile, self.recurring_core)

    @cached_property
    def recommendations(self) -> DataFrame:
        return recommend.recommendations(self.recurring_core, self.issue_summary)

    @cached_property
    def kpis(self) -> DataFrame:
        return report.kpi_summary(self.profile)


def analyze(
    df: DataFrame,
    roles: ColumnRoles | None = None,
    enriched_path: str | None = None,
    key: str = "feedback_id",
    text_sentiment: TextSentiment | None = None,
) -> Analysis:
    """Cleans `df` once; every result reads the distinct records written then.

    The scored rows are written as Parquet when a result first needs them, below the shared folder, or at once to
    `enriched_path`, and read back, so each result reads only the columns it needs. Results that read labels only
    compute only those; ask for `enriched` first if both are wanted. Rows keep their ids if these are unique and
    are numbered otherwise. `text_sentiment` names a trained model, a lexicon or both for the texts without a
    usable rating; without it the keyword scorer judges them.
    """
    source = cleaning.normalize_headers(df)
    roles = roles or detect_roles(source, key)
    records = cut_lineage(cleaning.distinct_records(source, roles))
    cleaned = cleaning.assign_feedback_id(cleaning.valid_records(records, roles.feedback), name=roles.key)
    scored = None
    if enriched_path:
        enrich(cleaned, roles, text_sentiment=text_sentiment).write.mode("overwrite").parquet(enriched_path)
        scored = df.sparkSession.read.parquet(enriched_path)
    return Analysis(records, cleaned, roles, text_sentiment, scored)
