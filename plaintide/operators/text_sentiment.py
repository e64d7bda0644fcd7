"""Where the sentiment of a text comes from."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.functions.sentiment import ensemble_probabilities
from plaintide.operators.lexicon import with_lexicon_probabilities
from plaintide.operators.model import TextModel
from plaintide.operators.scoring import with_keyword_probabilities


@dataclass(frozen=True)
class TextSentiment:
    """A trained model, a valence lexicon (a dictionary or a table of word and valence), or both.

    With both, the probabilities are mixed seven to three; with neither the keyword scorer gives them.
    """

    model: TextModel | None = None
    lexicon: dict[str, float] | DataFrame | None = None

    def add(self, df: DataFrame, feedback: str, name: str) -> DataFrame:
        """Adds the class probabilities as a struct; a projection, so it works on streams too."""
        parts = {"_by_model": None, "_by_lexicon": None, "_by_keywords": None}
        if self.model:
            df = self.model.with_probabilities(df, feedback, "_by_model")
        if self.lexicon is not None:
            df = with_lexicon_probabilities(df, feedback, "_by_lexicon", self.lexicon)
        df = with_keyword_probabilities(df, feedback, "_by_keywords")
        kind = df.schema["_by_keywords"].dataType
        given = [F.col(p) if p in df.columns else F.lit(None).cast(kind) for p in parts]
        return df.withColumn(name, ensemble_probabilities(*given)).drop(*parts)
