"""A factorization machine over hashed terms that scores toxicity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.arrow import portions
from plaintide.llm.labelled import labelled_sample, remainder
from plaintide.llm.segments import layouts, letter_words

#: Beginnings of words that are terms beside the word itself, as inflected forms share them.
PREFIXES = (4, 5)
#: Bounds of fitting: documents per label, terms kept, passes, texts a step.
PER_CLASS, TERMS, EPOCHS, BATCH = 2000, 1 << 14, 25, 32
#: Standard errors by which a term's shares of the labels must differ, strict and lenient: the strict bound leaves
#: few terms that differ by chance, the lenient one keeps rarer words. Texts put aside in fitting tell which serves.
LEAST_ERRORS, LENIENT_ERRORS = 4.0, 2.5
#: Pairs: the most frequent terms compared, texts that must hold a term, and standard errors by which a pair's
#: covariance must differ between the labels, as there are millions of pairs.
PAIR_TERMS, PAIR_TEXTS, PAIR_ERRORS = 1 << 12, 8, 6.0
#: One text of so many is put aside to choose the screen, which must lower the loss by this share to replace the strict one.
ASIDE, BETTER = 4, 0.02
#: Length of a term's vector, whose products with others weigh pairs of terms.
FACTORS = 8
#: Texts are cut into runs of about so many characters.
RUN = 2 << 20


@dataclass
class Machine:
    """Hashes of the terms in order, their weights and vectors, and the offset."""

    terms: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    offset: float

    def __post_init__(self):
        # A first look at 16 bits settles most terms that aren't known.
        self.near = np.zeros(1 << 16, bool)
        self.near[(self.terms & np.uint64(0xFFFF)).astype(np.int64)] = True


def hashed_terms(texts: list[str]):
    """For each run of texts: the numbers of the texts and the 64-bit hashes of their terms, repeats included.

    Terms are the lower-cased stretches of letters and their first 4 and 5 letters.
    """
    for run in layouts([t.lower() for t in texts]):
        starts, ends = letter_words(run)
        if not len(starts):
            continue
        hashes, owner = run.running(), run.owner_of(starts)
        yield owner, hashes(starts, ends)
        for size in PREFIXES:
            long = ends - starts > size
            yield owner[long], hashes(starts[long], starts[long] + size) ^ np.uint64(size * 0x9E3779B97F4A7C15 % (1 << 64))


def known_terms(machine: Machine, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) for every known term that stands in a text, each once, by text."""
    size = max(len(machine.terms), 1)
    pairs = [np.empty(0, np.int64)]
    for owner, hashes in hashed_terms(texts):
        maybe = machine.near[(hashes & np.uint64(0xFFFF)).astype(np.int64)]
        owner, hashes = owner[maybe], hashes[maybe]
        place = np.searchsorted(machine.terms, hashes)
        place[place == len(machine.terms)] = 0
        same = machine.terms[place] == hashes if len(machine.terms) else np.zeros(len(hashes), bool)
        pairs.append(owner[same] * size + place[same])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // size, pairs % size


def log_odds(machine: Machine, texts_of: np.ndarray, terms_of: np.ndarray, n: int) -> np.ndarray:
    """offset + sum of weights + half of (square of the summed vectors - sum of their squares), by text."""
    vectors = machine.vectors[terms_of]
    sums = np.stack([np.bincount(texts_of, vectors[:, k], n) for k in range(FACTORS)], 1)
    squares = np.bincount(texts_of, (vectors * vectors).sum(1), n)
    return machine.offset + np.bincount(texts_of, machine.weights[terms_of], n) + ((sums * sums).sum(1) - squares) / 2


def single_errors(owners: np.ndarray, term_of: np.ndarray, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """Standard errors by which each term's shares of the two labels differ."""
    good = labels[owners] == 1
    ones = np.bincount(term_of[good], minlength=n_terms)
    zeros = np.bincount(term_of[~good], minlength=n_terms)
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    pooled = (ones + zeros) / (n1 + n0)
    error = np.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n0))
    return np.abs(ones / n1 - zeros / n0) / np.maximum(error, 1e-12)


def paired_terms(owners: np.ndarray, term_of: np.ndarray, labels: np.ndarray, n_terms: int) -> np.ndarray:
    """Which terms stand in a pair whose covariance differs between the labels by PAIR_ERRORS standard errors.

    Terms that only add up have one covariance under both labels, whatever their shares; a pair that decides together
    has two, even if each term is as frequent under either label. (A word that tells alone makes a pair with its own
    beginnings, which go with it everywhere.) Compared are the PAIR_TERMS terms whose share is
    nearest to one half, in at least PAIR_TEXTS texts, in blocks of rows of the pair matrix.
    """
    found = np.zeros(n_terms, bool)
    texts = np.bincount(term_of, minlength=n_terms)
    rarer = np.minimum(texts, len(labels) - texts)
    chosen = np.sort(np.argsort(-rarer, kind="stable")[:PAIR_TERMS])
    chosen = chosen[rarer[chosen] >= PAIR_TEXTS]
    if not len(chosen):
        return found
    index = np.full(n_terms, -1)
    index[chosen] = np.arange(len(chosen))
    own = index[term_of] >= 0
    holds = np.zeros((len(labels), len(chosen)), np.float32)
    holds[owners[own], index[term_of[own]]] = 1
    sides = [holds[labels == k] for k in (1, 0)]
    shares = [side.mean(0, dtype=np.float64).astype(np.float32) for side in sides]
    for a in range(0, len(chosen), 256):
        gap, variance = 0.0, 0.0
        for sign, side, q in zip((1, -1), sides, shares):
            p = q[a : a + 256, None]
            both = side[:, a : a + 256].T @ side / len(side)
            covariance = both - p * q
            fourth = (both * ((1 - p) * (1 - q)) ** 2 + (p - both) * ((1 - p) * q) ** 2
                      + (q - both) * (p * (1 - q)) ** 2 + (1 - p - q + both) * (p * q) ** 2)
            gap = gap + sign * covariance
            # One more text of the rarest kind, so that pairs never seen together under a label have an error too.
            variance = variance + (np.maximum(fourth - covariance**2, 0) + 1 / len(side)) / len(side)
        strong = np.abs(gap) >= PAIR_ERRORS * np.sqrt(variance)
        strong[np.arange(len(strong)), a + np.arange(len(strong))] = False
        found[chosen[a : a + 256][strong.any(1)]] = True
        found[chosen[strong.any(0)]] = True
    return found


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, seed: int = 1) -> Machine:
    """Learns from the hashed terms of each text (distinct) by gradient descent (Adam).

    Which terms are learnt is chosen on one text in ASIDE: those that differ strictly between the labels by
    themselves, these and the terms of telling pairs, or these and the leniently differing ones; at most TERMS.
    Without texts every score is 0.5; with one label only it is near that label.
    """
    empty = Machine(np.empty(0, np.uint64), np.empty(0), np.empty((0, FACTORS)), 0.0)
    if not len(rows):
        return empty
    if len(set(labels.tolist())) < 2:
        empty.offset = 5.0 if labels[0] else -5.0
        return empty
    every = np.concatenate(rows)
    owners = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    terms, term_of = np.unique(every, return_inverse=True)

    aside = np.random.default_rng(seed).permutation(len(rows)) % ASIDE == 0
    choice = 0
    if len(set(labels[aside].tolist())) == 2 and len(set(labels[~aside].tolist())) == 2:
        kept_texts = ~aside[owners]
        numbers = np.cumsum(~aside) - 1
        screens = _screens(numbers[owners[kept_texts]], term_of[kept_texts], labels[~aside], len(terms))
        losses = []
        for i, kept in enumerate(screens):
            if any(np.array_equal(kept, earlier) for earlier in screens[:i]):
                losses.append(np.inf)
                continue
            machine = _descend(terms, kept, owners, term_of, labels, np.flatnonzero(~aside), seed)
            losses.append(_loss(machine, kept, owners, term_of, labels, aside))
        choice = int(np.argmin(losses))
        if losses[choice] > losses[0] * (1 - BETTER):
            choice = 0
    kept = _screens(owners, term_of, labels, len(terms))[choice]
    return _descend(terms, kept, owners, term_of, labels, np.arange(len(rows)), seed)


def _screens(owners: np.ndarray, term_of: np.ndarray, labels: np.ndarray, n_terms: int) -> list[np.ndarray]:
    """The choices of terms (places in order): strict, strict or paired, lenient or paired."""
    single = single_errors(owners, term_of, labels, n_terms)
    paired = paired_terms(owners, term_of, labels, n_terms)
    rank = np.where(paired, np.inf, single)
    strongest = np.argsort(-rank, kind="stable")
    strict = np.argsort(-single, kind="stable")
    return [np.sort(order[fit[order]][:TERMS]) for order, fit in (
        (strict, single >= LEAST_ERRORS),
        (strongest, paired | (single >= LEAST_ERRORS)),
        (strongest, paired | (single >= LENIENT_ERRORS)),
    )]


def _loss(machine: Machine, kept: np.ndarray, owners: np.ndarray, term_of: np.ndarray, labels: np.ndarray,
          aside: np.ndarray) -> float:
    """Logistic loss of the texts put aside, both labels weighing the same."""
    place = np.searchsorted(kept, term_of)
    place[place == len(kept)] = 0
    known = kept[place] == term_of if len(kept) else np.zeros(len(term_of), bool)
    odds = log_odds(machine, owners[known], place[known], len(labels))
    loss = np.logaddexp(0, np.where(labels == 1, -odds, odds))
    return float(loss[aside & (labels == 1)].mean() + loss[aside & (labels == 0)].mean())


def _descend(terms: np.ndarray, kept: np.ndarray, owners: np.ndarray, term_of: np.ndarray, labels: np.ndarray,
             texts: np.ndarray, seed: int) -> Machine:
    """The machine over the terms at `kept`, fitted on the given texts."""
    index = np.full(len(terms), -1)
    index[kept] = np.arange(len(kept))
    columns = index[term_of]
    owners, columns = owners[columns >= 0], columns[columns >= 0]
    starts = np.searchsorted(owners, np.arange(len(labels) + 1))

    draw = np.random.default_rng(seed)
    w = {"w": np.zeros(len(kept)), "v": draw.standard_normal((len(kept), FACTORS)) * 0.01, "b": np.zeros(1)}
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    share = (labels[texts] == 1).mean()
    balance = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    turn = 0
    for _ in range(EPOCHS):
        order = draw.permutation(texts)
        for a in range(0, len(order), BATCH):
            chosen = order[a : a + BATCH]
            own = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in chosen])
            text = np.repeat(np.arange(len(chosen)), starts[chosen + 1] - starts[chosen])
            term = columns[own]
            machine = Machine.__new__(Machine)
            machine.weights, machine.vectors, machine.offset = w["w"], w["v"], w["b"][0]
            error = 1 / (1 + np.exp(-np.clip(log_odds(machine, text, term, len(chosen)), -30, 30))) - labels[chosen]
            error *= balance[chosen] / len(chosen)
            sums = np.stack([np.bincount(text, w["v"][term][:, k], len(chosen)) for k in range(FACTORS)], 1)
            gradient = {
                "w": np.bincount(term, error[text], len(kept)) + 1e-4 * w["w"],
                "v": np.stack([
                    np.bincount(term, error[text] * (sums[text, k] - w["v"][term, k]), len(kept)) for k in range(FACTORS)
                ], 1) + 1e-3 * w["v"],
                "b": np.array([error.sum()]),
            }
            turn += 1
            for k, g in gradient.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                w[k] -= 0.02 * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-6)
    return Machine(terms[kept], w["w"], w["v"], float(w["b"][0]))


def score_texts(machine: Machine, texts: list[str]) -> np.ndarray:
    """Probability of label 1 for whole texts."""
    out = np.empty(len(texts))
    for a, b in portions([len(t) for t in texts], RUN):
        texts_of, terms_of = known_terms(machine, texts[a:b])
        out[a:b] = 1 / (1 + np.exp(-np.clip(log_odds(machine, texts_of, terms_of, b - a), -500, 500)))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id",
                 text_col: str = "text", per_class: int = PER_CLASS) -> Machine:
    """Fits the machine on at most `per_class` texts of either label, whose distinct terms reach the driver hashed."""

    def hashes(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [[] for _ in texts]
            for i, text in enumerate(texts):
                found[i] = [h for _, h in hashed_terms([text])]
            rows = [np.unique(np.concatenate(f)).astype("<u8").tobytes() if f else b"" for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["_label", "_terms"])

    sample = labelled_sample(docs, labels, label_col, per_class, id_col, text_col)
    rows = sorted((r._label, bytes(r._terms)) for r in sample.mapInArrow(hashes, "_label int, _terms binary").toLocalIterator())
    return fit_machine([np.frombuffer(t, "<u8") for _, t in rows], np.array([k for k, _ in rows], int))


def toxicity_score(machine: Machine):
    """A column function: score of a text column (null counts as empty), computed in Arrow batches."""
    parts = machine.terms, machine.weights, machine.vectors, machine.offset

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(Machine(*parts), [x or "" for x in texts]))

    return score


def classify_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out (crc32 of the id modulo 5 is 0), score, predicted (score >= 0.5).

    Learns from labels of ids that aren't held out. Null and empty texts get the score of a text without known
    terms. Scoring is a map over `docs` without a shuffle; the machine (about 1 MB) goes with the tasks.
    """
    apart = remainder(F.col(id_col), 5) == 0
    machine = fit_toxicity(docs.filter(~apart), labels.filter(~apart), id_col=id_col, text_col=text_col)
    scored = docs.select(
        F.col(id_col), F.coalesce(apart, F.lit(False)).alias("held_out"), toxicity_score(machine)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
