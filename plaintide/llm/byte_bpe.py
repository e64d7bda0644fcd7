"""Byte-level byte-pair encoding of whole texts and back."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.arrow import text_batches, type_of
from plaintide.llm.merging import byte_merges
from plaintide.llm.segments import WordTable, byte_level_words, layouts


def encode_plain(texts: list[str], table: WordTable) -> list[np.ndarray]:
    """Ids of each text, none of which holds a special string; `table` solves the words."""
    flat, counts = [], np.zeros(len(texts), np.int64)
    for run in layouts(texts):
        starts, ends = byte_level_words(run)
        ids, sizes = table.rows(table.find(run, starts, ends))
        flat.append(ids)
        np.add.at(counts, run.owner_of(starts), sizes)
    every = np.concatenate(flat) if flat else np.empty(0, np.int32)
    return np.split(every, np.cumsum(counts)[:-1]) if len(texts) else []


def encode_texts(texts: list[str], table: WordTable, special: dict[str, int]) -> list[np.ndarray]:
    """Ids of each text; a special string in a text becomes its own id, as the library does by default."""
    if not special:
        return encode_plain(texts, table)
    mark = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")
    parts = [mark.split(t) if mark.search(t) else [t] for t in texts]
    found = iter(encode_plain([p for own in parts for p in own[::2]], table))
    out = []
    for own in parts:
        rows = [next(found)]
        for token in own[1::2]:
            rows += [np.array([special[token]], np.int32), next(found)]
        out.append(rows[0] if len(rows) == 1 else np.concatenate(rows))
    return out


@lru_cache(2)
def _table(path: str) -> WordTable:
    merges = byte_merges(path)
    return WordTable(lambda words: [merges.encode_word(w) for w in words])


@lru_cache(2)
def _digits(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Decimal text of every id with a comma behind it, in rows of equal width, and which bytes count."""
    names = [f"{i}," for i in range(len(byte_merges(path).strings))]
    width = max(map(len, names))
    table = np.frombuffer("".join(n.ljust(width) for n in names).encode(), np.uint8).reshape(-1, width)
    return table, table != 32


def encode(texts: list[str], path: str) -> list[np.ndarray]:
    return encode_texts(texts, _table(path), byte_merges(path).special)


def decode(ids, path: str) -> str:
    """The vocabulary strings one after the other, as UTF-8; broken sequences become U+FFFD."""
    return byte_merges(path).decode(ids.tolist() if isinstance(ids, np.ndarray) else ids)


def comma_joined(ids: np.ndarray, path: str) -> bytes:
    """Decimal ids joined by commas."""
    table, counts = _digits(path)
    return table[ids][counts[ids]].tobytes()[:-1]


def _selected(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.col(text_col).alias("_text"))


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, ids array<int> (empty for null or empty texts). No shuffle."""

    def run(batches):
        for rows, texts in text_batches(batches, "_text"):
            found = encode(texts, path)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(found, pa.list_(pa.int32()))], names=[id_col, "ids"])

    return _selected(docs, id_col, text_col).mapInArrow(run, f"{id_col} {type_of(docs, id_col)}, ids array<int>")


def bpe_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of `encoded`: id, text. Null ids give an empty text."""

    def run(batches):
        for batch in batches:
            texts = [decode(x or [], path) for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    chosen = encoded.select(F.col(id_col), F.col(ids_col).alias("_ids"))
    return chosen.mapInArrow(run, f"{id_col} {type_of(encoded, id_col)}, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256, exact.

    `exact` says that decoding gave the text back. Null counts as empty: 0 tokens, both digests of nothing.
    Ids may be null or repeat; other columns are not read. Each row is encoded and decoded in one task, so ids
    never leave it.
    """
    schema = (f"{id_col} {type_of(docs, id_col)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, "
              "exact boolean")

    def run(batches):
        for rows, texts in text_batches(batches, "_text"):
            found = encode(texts, path)
            decoded = [decode(x, path) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column(0),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(comma_joined(x, path)).hexdigest() for x in found]),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                    pa.array([a == b for a, b in zip(texts, decoded)]),
                ],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", "exact"],
            )

    return _selected(docs, id_col, text_col).mapInArrow(run, schema)
