"""Terms of a text for vectors: lower-case words and pairs of neighbouring words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaintide.functions.text import tokens

WORDS = r"(?U)\b\w\w+\b"


def term_words(text: Column, stop_words: list[str] = ()) -> Column:
    """Words of two or more characters, stop words left out."""
    words = tokens(F.lower(text), WORDS)
    return F.filter(words, lambda w: ~w.isin(list(stop_words))) if stop_words else words


def with_pairs(words: Column) -> Column:
    """The words followed by each pair of neighbours."""
    heads = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    tails = F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    return F.concat(words, F.zip_with(heads, tails, lambda a, b: F.concat_ws(" ", a, b)))
