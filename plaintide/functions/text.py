"""Text normalisation and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"(?U)\w+"
WORD_OR_APOSTROPHE = r"(?U)[\w']+"


def clean_text(text: Column) -> Column:
    """Runs of white space and control characters become one space; null becomes ''."""
    # Printable ASCII with single spaces is so already; a class of plain ASCII is tested much faster than Unicode's.
    plain = ~text.rlike("[^ -~]|  ")
    spaced = F.when(plain, text).otherwise(F.regexp_replace(text, r"(?U)[\s\x00-\x1f\x7f]+", " "))
    return F.coalesce(F.trim(spaced), F.lit(""))


def single_spaced(text: Column) -> Column:
    """White space as single spaces. Plain ASCII text that is so already skips the regex."""
    plain = (F.length(text) == F.octet_length(text)) & ~text.contains("  ")
    for character in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f":
        plain = plain & ~text.contains(character)
    return F.when(plain, text).otherwise(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " "))


def folded(text: Column) -> Column:
    """Lower case with the closing curly quote as an apostrophe."""
    return F.replace(F.lower(text), F.lit("’"), F.lit("'"))


def folded_both(text: Column) -> Column:
    """Lower case with both curly single quotes as apostrophes."""
    lower = F.replace(F.lower(text), F.lit("’"), F.lit("'"))
    return F.replace(lower, F.lit("‘"), F.lit("'"))


def tokens(text: Column, pattern: str = WORD) -> Column:
    """All matches. On ASCII text Unicode's classes hold the same characters as the plain ones, which are faster."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if not pattern.startswith("(?U)"):
        return found
    ascii_found = F.regexp_extract_all(text, F.lit(pattern.removeprefix("(?U)")), F.lit(0))
    return F.when(F.length(text) == F.octet_length(text), ascii_found).otherwise(found)


def word_count(clean: Column) -> Column:
    """Words of a cleaned text."""
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def pct(part: Column, whole: Column) -> Column:
    """Percentage with one decimal, halves to even; 0 of nothing is 0."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(
        F.bround(part.cast("double") / whole * 100, 1)
    )
