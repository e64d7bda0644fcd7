"""Valence scoring of a text from a word lexicon by published rules.

Words add their valence, strengthened or weakened by degree words and turned by negations among the
three words before them, by capitals, by "but" and by exclamation and question marks. The sum s is
mapped to s / sqrt(s^2 + 15).
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaintide.rules.lexicon import (
    BOOSTER,
    CAPS_BOOST,
    DEGREE_WORDS,
    NEGATION_SCALE,
    NEGATION_WORDS,
    NORMALISER,
)
from plaintide.rules.sentiment import DOMAIN_VALENCE, NEGATIVE_WORDS, POSITIVE_WORDS

#: Words that share one literal map; a map is searched from its start.
MAP_WORDS = 64
FACTS = "array<struct<valence:double,known:boolean,degree:double,negates:boolean,upper:boolean,but:boolean>>"
DISTANCE_SCALE = [1.0, 0.95, 0.9]


def seed_lexicon(strength: float = 2.0) -> dict[str, float]:
    """The domain terms plus the keyword scorer's words; a full lexicon is up to the caller."""
    words = {w: strength for w in POSITIVE_WORDS} | {w: -strength for w in NEGATIVE_WORDS}
    return words | DOMAIN_VALENCE


def words_of(text: Column) -> Column:
    """Words split at white space without punctuation at their ends, unless hardly any would stay."""
    parts = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")

    def stripped(word: Column) -> Column:
        # Replaced only where a word begins or ends with a mark.
        marked = word.rlike(r"^\p{Punct}|\p{Punct}$")
        inner = F.when(marked, F.regexp_replace(word, r"^\p{Punct}+|\p{Punct}+$", "")).otherwise(word)
        return F.when(F.length(inner) <= 2, word).otherwise(inner)

    return F.transform(parts, stripped)


def is_upper(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def inline_valences(words: Column, lexicon: dict[str, float]) -> Column:
    """The valence of each word, null if unknown, from a small lexicon that becomes part of the expression."""
    parts = max(1, len(lexicon) // MAP_WORDS)
    pairs: list[list] = [[] for _ in range(parts)]
    for word, valence in lexicon.items():
        pairs[zlib.crc32(word.encode()) % parts] += [F.lit(word), F.lit(float(valence))]
    empty = F.create_map().cast("map<string,double>")
    maps = F.array(*[F.create_map(*own) if own else empty for own in pairs])
    known = list(lexicon)

    def valence(word: Column) -> Column:
        lower = F.lower(word)
        own = F.element_at(maps, (F.crc32(lower.cast("binary")) % parts + 1).cast("int"))
        return F.when(lower.isin(known), F.try_element_at(own, lower))

    return F.transform(words, valence)


def word_facts(words: Column, valences: Column) -> Column:
    """Per word: its valence (0 if unknown), degree (-1, 0, 1), negation and capitals."""
    strong = [w for w, sign in DEGREE_WORDS.items() if sign > 0]
    weak = [w for w, sign in DEGREE_WORDS.items() if sign < 0]

    def facts(pair: Column, own: Column) -> Column:
        word, lower = pair["word"], pair["lower"]
        degree = F.when(lower.isin(strong), 1.0).when(lower.isin(weak), -1.0).otherwise(0.0)
        return F.struct(
            F.when(own.isNotNull() & (degree == 0), own).otherwise(0.0).alias("valence"),
            own.isNotNull().alias("known"),
            degree.alias("degree"),
            (lower.isin(NEGATION_WORDS) | lower.contains("n't")).alias("negates"),
            ((F.upper(word) == word) & (lower != word)).alias("upper"),
            (lower == "but").alias("but"),
        )

    # A function over an array keeps no common parts, so lower case is taken beforehand.
    pairs = F.transform(words, lambda w: F.struct(w.alias("word"), F.lower(w).alias("lower")))
    # Without a known word the sum is 0 whatever the others are.
    return F.when(F.exists(valences, lambda v: v.isNotNull()), F.zip_with(pairs, valences, facts)).when(
        words.isNotNull(), F.array().cast(FACTS))


def valence_sum(facts: Column, mixed_case: Column) -> Column:
    """Sum of the word valences in context."""
    positions = F.array_compact(
        F.transform(facts, lambda word, i: F.when(word["valence"] != 0, i + 1))
    )
    but_at = F.array_position(F.transform(facts, lambda w: w["but"]), True)

    def in_context(i: Column) -> Column:
        word = F.element_at(facts, i)
        value = word["valence"]
        value = value + F.when(word["upper"] & mixed_case, F.signum(value) * CAPS_BOOST).otherwise(0.0)
        # The up to three words before, nearest first, each with its distance.
        before = F.reverse(F.slice(facts, F.greatest(i - 3, F.lit(1)), F.least(i - 1, F.lit(3))))
        context = F.transform(
            before,
            lambda w, k: F.struct(
                F.when(
                    (w["degree"] != 0) & ~w["known"],
                    (w["degree"] * BOOSTER + F.when(w["upper"] & mixed_case, CAPS_BOOST).otherwise(0.0))
                    * F.element_at(F.array(*[F.lit(s) for s in DISTANCE_SCALE]), k + 1),
                ).otherwise(0.0).alias("push"),
                F.when(w["negates"] & ~w["known"], NEGATION_SCALE).otherwise(1.0).alias("turn"),
            ),
        )
        value = F.aggregate(
            context, value, lambda v, c: (v + F.signum(v) * c["push"]) * c["turn"]
        )
        shift = F.when((but_at > 0) & (i < but_at), 0.5).when((but_at > 0) & (i > but_at), 1.5)
        return value * F.coalesce(shift, F.lit(1.0))

    return F.aggregate(positions, F.lit(0.0), lambda total, i: total + in_context(i))


def punctuation_emphasis(text: Column) -> Column:
    """What exclamation and question marks add to the size of the sum."""

    def marks(character: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))

    questions = marks("?")
    return F.least(marks("!"), F.lit(4)) * 0.292 + F.when(questions > 3, 0.96).when(
        questions > 1, questions * 0.18
    ).otherwise(0.0)


def compound(total: Column, emphasis: Column) -> Column:
    score = total + F.signum(total) * emphasis
    return F.bround(score / F.sqrt(score * score + NORMALISER), 4)
