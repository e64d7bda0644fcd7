"""Secrets in whole texts: regular expressions behind a trigram index."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.arrow import text_batches, type_of

try:
    from re import _constants as _op
    from re import _parser as _reader
except ImportError:  # before Python 3.11
    import sre_constants as _op
    import sre_parse as _reader


@dataclass(frozen=True)
class Rule:
    """A kind of secret; a match counts when `group` of it has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The base kinds, in their order.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further shapes that issuers publish.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + MORE_RULES

# A query is True (no mandatory trigram), a trigram, or ("and" / "or", queries).


def _all(queries):
    queries = [q for q in dict.fromkeys(queries) if q is not True]
    return True if not queries else queries[0] if len(queries) == 1 else ("and", tuple(queries))


def _any(queries):
    queries = list(dict.fromkeys(queries))
    return True if True in queries else queries[0] if len(queries) == 1 else ("or", tuple(queries))


def _of_strings(strings):
    """What a text holds that holds one of the strings."""
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


#: Sets of possible strings are followed up to this size; beyond it their trigrams so far are kept.
_STRINGS, _LENGTH = 64, 24


def _sequence(items):
    """(strings, query) of a parsed sequence: all strings it can match, or None if there are too many."""
    known, queries, exact = {""}, [], True
    for operator, value in items:
        strings, query = _item(operator, value)
        if strings is not None and len(known) * len(strings) <= _STRINGS and max(map(len, known)) <= _LENGTH:
            known = {a + b for a, b in product(known, strings)}
            continue
        queries.append(_of_strings(sorted(known)))
        queries.append(_of_strings(sorted(strings)) if strings is not None else query)
        known, exact = {""}, False
    if exact:
        return known, None
    return None, _all([*queries, _of_strings(sorted(known))])


def _item(operator, value):
    if operator is _op.LITERAL:
        return {chr(value).lower()}, None
    if operator is _op.IN:
        chars = [chr(v).lower() for kind, v in value if kind is _op.LITERAL]
        return (set(chars), None) if len(chars) == len(value) <= 4 else (None, True)
    if operator is _op.BRANCH:
        found = [_sequence(x) for x in value[1]]
        if all(strings is not None for strings, _ in found):
            return set().union(*(strings for strings, _ in found)), None
        return None, _any([q if s is None else _of_strings(sorted(s)) for s, q in found])
    if operator is _op.SUBPATTERN:
        return _sequence(value[3])
    if operator in (_op.MAX_REPEAT, _op.MIN_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if strings is not None and (least, most) == (0, 1):
            return strings | {""}, None
        if strings is not None and least == most == 1:
            return strings, None
        if least == 0:
            return None, True
        return None, _of_strings(sorted(strings)) if strings is not None else query
    if operator is _op.AT:
        return {""}, None
    return None, True


def trigram_query(pattern: str):
    """A Boolean query over lower-case trigrams that every text with a match of `pattern` satisfies."""
    strings, query = _sequence(_reader.parse(pattern))
    return _of_strings(sorted(strings)) if strings is not None else query


def trigrams_of(query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class TrigramIndex:
    """Postings of the trigrams that the rules ask for, over one run of texts: sorted text numbers by trigram."""

    def __init__(self, texts: list[str], trigrams: set[str]):
        self.size = len(texts)
        encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = _LOWER[np.frombuffer(b"\0".join(encoded) + b"\0\0\0", np.uint8)]
        starts = np.cumsum([0, *(len(x) + 1 for x in encoded[:-1])]) if encoded else np.empty(0, np.int64)
        wanted = {t.encode(): t for t in trigrams if len(t.encode()) == 3}
        heads = np.zeros(1 << 16, bool)
        heads[[(b[0] << 8) | b[1] for b in wanted]] = True
        pairs = (data[:-2].astype(np.uint16) << 8) | data[1:-1]
        places = np.flatnonzero(heads[pairs])
        codes = (pairs[places].astype(np.int64) << 8) | data[places + 2]
        owner = np.searchsorted(starts, places, side="right") - 1
        self.postings = {
            name: np.unique(owner[codes == ((b[0] << 16) | (b[1] << 8) | b[2])]) for b, name in wanted.items()
        }

    def candidates(self, query) -> np.ndarray:
        """Numbers of the texts that satisfy the query."""
        if query is True:
            return np.arange(self.size)
        if isinstance(query, str):
            # A trigram with other than ASCII letters has no postings here and decides nothing.
            return self.postings.get(query, np.arange(self.size))
        combine = np.intersect1d if query[0] == "and" else np.union1d
        return reduce(combine, [self.candidates(q) for q in query[1]])


@lru_cache(8)
def _compiled(rules: tuple[Rule, ...]):
    queries = [trigram_query(r.pattern) for r in rules]
    return [re.compile(r.pattern, re.ASCII) for r in rules], queries, set().union(*map(trigrams_of, queries))


def find_secrets(texts: list[str], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """(start, number of the rule, end) of every match in each text, in order."""
    patterns, queries, trigrams = _compiled(rules)
    index = TrigramIndex(texts, trigrams)
    found = [[] for _ in texts]
    for number, (rule, pattern, query) in enumerate(zip(rules, patterns, queries)):
        for i in index.candidates(query).tolist():
            for match in pattern.finditer(texts[i]):
                if len(match[rule.group]) >= rule.least:
                    found[i].append((match.start(), number, match.end()))
    for own in found:
        own.sort()
    return found


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, spans array<struct<kind, start, end, value>> by start, then rule.

    Places are code points, the end is exclusive; matches of a rule don't overlap. Null and empty texts have no
    spans; ids may be null or repeat. Each run of about 4 million characters gets an inverted index of the
    trigrams that the rules need, their Boolean queries are intersected over it, and only candidates meet the
    regular expression; rules without a mandatory trigram (hex) meet every text. No shuffle.
    """
    kind = type_of(docs, id_col)
    struct = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def scan(batches):
        for rows, texts in text_batches(batches, "_text"):
            spans = [
                [{"kind": rules[k].kind, "start": a, "end": b, "value": t[a:b]} for a, k, b in own]
                for t, own in zip(texts, find_secrets(texts, rules))
            ]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, pa.list_(struct))], names=[id_col, "spans"])

    chosen = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return chosen.mapInArrow(
        scan, f"{id_col} {kind}, spans array<struct<kind: string, start: bigint, end: bigint, value: string>>")


def secret_summary(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of scan_secrets: counts of the base kinds, digest of the base spans, and all spans as text."""
    base = [r.kind for r in BASE_RULES]

    def named(s):
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    own = of(*base)
    counts = [F.size(of(kind)).cast("bigint").alias(f"n_{kind}") for kind in base]
    return spans.select(
        F.col(id_col), *counts,
        F.sha2(F.concat_ws(",", F.transform(own, named)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("spans", named)).alias("spans"),
    )
