"""A byte-level convolutional network that scores text quality."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.arrow import portions
from plaintide.llm.labelled import labelled_sample, remainder

#: Bytes of a chunk, and from one chunk's start to the next one's.
CHUNK, HOP = 512, 384
#: Numbers per byte, bytes a filter moves at a time (it sees two such steps), filters, hidden units.
WIDTH, STEP, FILTERS, HIDDEN = 8, 4, 48, 16
#: Code of the places behind a text's end.
PAD = 256
#: Bounds of fitting: documents per label, chunks of one document (spread evenly over it), passes, chunks a step.
PER_CLASS, CHUNKS_PER_TEXT, EPOCHS, BATCH = 1500, 24, 6, 64
#: Chunks scored at once.
AT_ONCE = 256


@dataclass
class Network:
    """Byte vectors, filters over eight bytes in two halves, and two dense layers; `constant` if nothing was learnt."""

    weights: dict[str, np.ndarray]
    constant: float | None = None


def chunk_starts(size: int) -> np.ndarray:
    """Starts of the overlapping chunks that cover a text of `size` bytes; an empty one has one chunk."""
    return np.arange(0, max(size - (CHUNK - HOP), 1), HOP)


def chunks_of(texts: list[bytes], most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte codes of all chunks, padded, their sizes, and the number of the text of each."""
    starts, owners, sizes, at = [], [], [], 0
    for i, text in enumerate(texts):
        own = chunk_starts(len(text))
        if most and len(own) > most:
            own = own[np.linspace(0, len(own) - 1, most).astype(int)]
        starts.append(own + at)
        owners.append(np.full(len(own), i))
        sizes.append(np.minimum(CHUNK, len(text) - own))
        at += len(text)
    data = np.concatenate([np.frombuffer(b"".join(texts), np.uint8).astype(np.int16), np.full(CHUNK, PAD, np.int16)])
    starts, owners, sizes = (np.concatenate(x) for x in (starts, owners, sizes))
    codes = data[starts[:, None] + np.arange(CHUNK)]
    codes[np.arange(CHUNK) >= sizes[:, None]] = PAD
    return codes, np.maximum(sizes, 1), owners


def _pooled(w: dict, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest answer of every filter in each chunk, and where."""
    n = len(codes)
    steps = w["bytes"][codes].reshape(n * CHUNK // STEP, STEP * WIDTH)
    both = (steps @ w["filters"]).reshape(n, CHUNK // STEP, 2 * FILTERS)
    answers = both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]
    outside = np.arange(CHUNK // STEP - 1) * STEP >= sizes[:, None]
    answers[outside] = -np.inf
    where = answers.argmax(axis=1)
    return np.take_along_axis(answers, where[:, None, :], 1)[:, 0], where


def _features(pooled: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([pooled, np.log2(sizes / CHUNK).astype(np.float32)[:, None]], axis=1)


def _dense(w: dict, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.maximum(features @ w["hidden"] + w["hidden_bias"], 0)
    return hidden, hidden @ w["out"] + w["out_bias"]


def logits(w: dict, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return _dense(w, _features(_pooled(w, codes, sizes)[0], sizes))[1][:, 0]


def fit_network(texts: list[bytes], labels: np.ndarray, seed: int = 1) -> Network:
    """Learns all layers by gradient descent (Adam) on chunks that carry their text's label."""
    if len(set(labels.tolist())) < 2:
        return Network({}, float(labels[0]) if len(labels) else 0.5)
    codes, sizes, owners = chunks_of(texts, CHUNKS_PER_TEXT)
    target = labels[owners].astype(np.float32)
    # Every text counts the same, and so does either label.
    weight = 1 / np.bincount(owners)[owners]
    for k in (0, 1):
        weight[target == k] /= weight[target == k].sum()
    weight = (weight * len(weight) / 2).astype(np.float32)
    draw = np.random.default_rng(seed)

    def start(*shape, scale):
        return (draw.standard_normal(shape) * scale).astype(np.float32)

    w = {
        "bytes": start(PAD + 1, WIDTH, scale=0.5), "filters": start(STEP * WIDTH, 2 * FILTERS, scale=0.2),
        "hidden": start(FILTERS + 1, HIDDEN, scale=0.15), "hidden_bias": np.zeros(HIDDEN, np.float32),
        "out": start(HIDDEN, 1, scale=0.2), "out_bias": np.zeros(1, np.float32),
    }
    w["bytes"][PAD] = 0
    first = {k: np.zeros_like(v) for k, v in w.items()}
    second = {k: np.zeros_like(v) for k, v in w.items()}
    turn = 0
    for _ in range(EPOCHS):
        order = draw.permutation(len(codes))
        for a in range(0, len(order), BATCH):
            rows = order[a : a + BATCH]
            grad = _gradients(w, codes[rows], sizes[rows], target[rows], weight[rows])
            turn += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.01 * (g * g - second[k])
                w[k] -= 0.004 * (first[k] / (1 - 0.9**turn)) / (np.sqrt(second[k] / (1 - 0.99**turn)) + 1e-6)
            w["bytes"][PAD] = 0
    return Network(w)


def _gradients(w, codes, sizes, target, weight) -> dict[str, np.ndarray]:
    n = len(codes)
    pooled, where = _pooled(w, codes, sizes)
    features = _features(pooled, sizes)
    hidden, out = _dense(w, features)
    d_out = ((1 / (1 + np.exp(-out[:, 0])) - target) * weight / n)[:, None].astype(np.float32)
    d_hidden = (d_out @ w["out"].T) * (hidden > 0)
    d_pooled = (d_hidden @ w["hidden"].T)[:, :FILTERS]
    # Only the eight bytes at the largest answer of a filter have a part in it.
    seen = codes[np.arange(n)[:, None, None], where[:, :, None] * STEP + np.arange(2 * STEP)]
    vectors = w["bytes"][seen].reshape(n, FILTERS, 2 * STEP * WIDTH)
    by_filter = np.einsum("nfe,nf->ef", vectors, d_pooled)
    half = STEP * WIDTH
    joined = np.concatenate([w["filters"][:, :FILTERS], w["filters"][:, FILTERS:]], axis=0)
    d_vectors = (d_pooled[:, :, None] * joined.T[None]).reshape(-1, WIDTH)
    d_bytes = np.stack([np.bincount(seen.ravel(), d_vectors[:, e], PAD + 1) for e in range(WIDTH)], 1)
    return {
        "bytes": d_bytes.astype(np.float32),
        "filters": np.concatenate([by_filter[:half], by_filter[half:]], axis=1),
        "hidden": features.T @ d_hidden, "hidden_bias": d_hidden.sum(0),
        "out": hidden.T @ d_out, "out_bias": d_out.sum(0),
    }


def score_texts(network: Network, texts: list[str]) -> np.ndarray:
    """Probability of label 1 for whole texts: chunks' log-odds weighted by their bytes, then the logistic function."""
    scores = np.full(len(texts), network.constant if network.constant is not None else 0.5)
    if network.constant is not None:
        return scores
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    for a, b in portions([len(t) + CHUNK for t in encoded], CHUNK * AT_ONCE * 8):
        sums, total = np.zeros(b - a), np.zeros(b - a)
        codes, sizes, owners = chunks_of(encoded[a:b])
        for i in range(0, len(codes), AT_ONCE):
            rows = slice(i, i + AT_ONCE)
            np.add.at(sums, owners[rows], logits(network.weights, codes[rows], sizes[rows]) * sizes[rows])
            np.add.at(total, owners[rows], sizes[rows])
        scores[a:b] = 1 / (1 + np.exp(-np.clip(sums / total, -500, 500)))
    return scores


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
                text_col: str = "text", per_class: int = PER_CLASS) -> Network:
    """Fits the network on at most `per_class` texts of either label.

    Tasks cut long texts to CHUNKS_PER_TEXT evenly spread chunks, so at most 2 * per_class * CHUNKS_PER_TEXT *
    CHUNK bytes (36 MB) reach the driver. Without labels every score is 0.5; with one label it is that label.
    """
    def cut(batches):
        for batch in batches:
            texts = [x.encode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            short = []
            for text in texts:
                own = chunk_starts(len(text))
                if len(own) > CHUNKS_PER_TEXT:
                    own = own[np.linspace(0, len(own) - 1, CHUNKS_PER_TEXT).astype(int)]
                    text = b"".join(text[s : s + HOP] for s in own)
                short.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(short, pa.binary())], names=["_label", "_bytes"])

    sample = labelled_sample(docs, labels, label_col, per_class, id_col, text_col)
    rows = sorted((r._label, bytes(r._bytes)) for r in sample.mapInArrow(cut, "_label int, _bytes binary").collect())
    return fit_network([t for _, t in rows], np.array([k for k, _ in rows], int))


def quality_score(network: Network):
    """A column function: score of a text column (null counts as empty), computed in Arrow batches."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(network, [x or "" for x in texts]))

    return score


def classify_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out (crc32 of the id modulo 3 is 1), score, predicted (score >= 0.5).

    Learns from labels of ids that aren't held out. Null texts count as empty; every byte of a text is in a
    chunk. Scoring is a map over `docs` without a shuffle; the network (some 50 kB) goes with the tasks.
    """
    apart = remainder(F.col(id_col), 3) == 1
    network = fit_quality(docs.filter(~apart), labels.filter(~apart), id_col=id_col, text_col=text_col)
    scored = docs.select(
        F.col(id_col), F.coalesce(apart, F.lit(False)).alias("held_out"), quality_score(network)(F.col(text_col)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with a score of at least 0.5, with all their columns."""
    apart = remainder(F.col(id_col), 3) == 1
    network = fit_quality(docs.filter(~apart), labels.filter(~apart), id_col=id_col, text_col=text_col)
    return docs.filter(quality_score(network)(F.col(text_col)) >= 0.5)
