"""Keyword matching.

Whole words are looked up in the token array: one hash-set filter keeps the few tokens that are
keywords, or begin one, and the labels then only look at those. A phrase is searched for only where
its first word is among them; its edges need a regular expression, which runs only where the phrase
occurs as a substring. Texts are expected with single spaces.

The expressions are SQL text over the column `_text` and a column of hits, as they come to hundreds
of terms and a Column takes a call to the JVM per node.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Term:
    text: str
    prefix: bool
    weight: int

    @property
    def is_word(self) -> bool:
        return not self.prefix and re.fullmatch(r"\w+", self.text) is not None

    @property
    def first_word(self) -> str:
        return self.text.split()[0]


def parse_term(spec: str) -> Term:
    """`text`, `text*` (prefix) or `text|weight`; the weight defaults to the number of words."""
    body, _, weight = spec.partition("|")
    text = body.rstrip("*")
    return Term(text, body.endswith("*"), int(weight) if weight else len(text.split()))


@dataclass(frozen=True)
class Edges:
    """What may not touch a term on either side, and the tokens that go with it."""

    left: str
    right: str
    token: str

    def pattern(self, term: Term) -> str:
        return "(?U)" + self.left + re.escape(term.text) + ("" if term.prefix else self.right)

    def first_token(self, term: Term) -> str | None:
        """The token any match starts with; None if only a part of the token is known."""
        token = re.match(self.token, term.text).group(0)
        return None if term.prefix and token == term.text else token


WORD_EDGES = Edges(r"\b", r"\b", r"\w+")
APOSTROPHE_EDGES = Edges(r"(?<![\w'])", r"(?![\w'])", r"[\w']+")


def text(value: str) -> str:
    """SQL literal of a text taken as it is."""
    return f'r"{value}"'


def texts(values) -> str:
    return ", ".join(text(v) for v in values)


class KeywordGroup:
    """The terms of one label."""

    def __init__(self, specs: list[str], edges: Edges, hits: str):
        self.hits = hits
        terms = [parse_term(spec) for spec in specs]
        self.edges = edges
        self.words = [t for t in terms if t.is_word]
        self.others = [t for t in terms if not t.is_word]

    @property
    def tokens(self) -> set[str]:
        """The tokens that tell whether a whole word or phrase can be in a text."""
        firsts = {self.edges.first_token(t) for t in self.others} - {None}
        return firsts | {t.text for t in self.words}

    def weighted_hits(self) -> Column:
        """Sum of the weights of the terms found; BIGINT."""
        by_weight = _grouped({t.text: t.weight for t in self.words})
        parts = [f"size({self._among(words)}) * {weight}" for weight, words in by_weight.items()]
        return self._total(parts, lambda t: str(t.weight), "0").cast("bigint")

    def count_hits(self) -> Column:
        """Number of listed terms found; a term listed twice counts twice. BIGINT."""
        parts = [f"size({self._among(words)}) * {n}" for n, words in self._words_by_times().items()]
        return self._total(parts, lambda t: "1", "0").cast("bigint")

    def boosted_hits(self, boost: Callable[[str], str]) -> Column:
        """Sum of `boost(first word)`, itself SQL, over the terms found; DOUBLE."""
        parts = [
            f"aggregate({self._among(words)}, 0D, (total, t) -> total + {boost('t')}) * {n}D"
            for n, words in self._words_by_times().items()
        ]
        return self._total(parts, lambda t: boost(text(t.first_word)), "0D")

    def _total(self, words: list[str], value: Callable[[Term], str], zero: str) -> Column:
        """Sum over words, phrases and prefixes; what needs a token of this group runs only where the text has one."""
        phrases, prefixes = self._others(value, zero)
        tokens = texts(sorted(self.tokens))
        looked_up = " + ".join([*words, *phrases]) or zero
        guarded = f"if(exists({self.hits}, t -> t IN ({tokens})), {looked_up}, {zero})" if self.tokens else zero
        return F.expr(" + ".join([guarded, *prefixes]))

    def _others(self, value: Callable[[Term], str], zero: str) -> tuple[list[str], list[str]]:
        """Values of the phrases found, one sum per first token, and of the prefixes that begin within a token."""
        by_token: dict = {}
        for term in self.others:
            if term.weight:
                by_token.setdefault(self.edges.first_token(term), []).append(term)
        phrases, prefixes = [], []
        for token, terms in by_token.items():
            found = " + ".join(f"if({self._matches(t)}, {value(t)}, {zero})" for t in terms)
            if token is None:
                prefixes.append(found)
            else:
                phrases.append(f"if(array_contains({self.hits}, {text(token)}), {found}, {zero})")
        return phrases, prefixes

    def _among(self, words: list[str]) -> str:
        return f"filter({self.hits}, t -> t IN ({texts(words)}))"

    def _matches(self, term: Term) -> str:
        return f"contains(_text, {text(term.text)}) AND rlike(_text, {text(self.edges.pattern(term))})"

    def _words_by_times(self) -> dict[int, list[str]]:
        return _grouped(Counter(t.text for t in self.words))


def keyword_hits(words: str, groups: list[KeywordGroup]) -> Column:
    """The distinct tokens in the column `words` that are, or begin, a term of any group."""
    vocabulary = sorted(set().union(*[group.tokens for group in groups]))
    return F.expr(f"array_distinct(filter({words}, t -> t IN ({texts(vocabulary)})))")


def first_best(scores: dict[str, Column], best: Column) -> Column:
    """The first label whose score is the best one."""
    return F.coalesce(*[F.when(score == best, F.lit(label)) for label, score in scores.items()])


def _grouped(numbers: dict[str, int]) -> dict[int, list[str]]:
    grouped: dict[int, list[str]] = {}
    for word, number in numbers.items():
        grouped.setdefault(number, []).append(word)
    return grouped
