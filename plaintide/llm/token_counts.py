"""Token counts of whole texts under a byte-pair model with pieces, by heap merging, without ids."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.arrow import text_batches, type_of
from plaintide.llm.merging import merge
from plaintide.llm.segments import WordTable, layouts, piece_segments

_SPACE = "▁"


class PieceModel:
    """Ranks of the pieces of a sentencepiece byte-pair model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        SentencePieceProcessor(model_file=path)  # fails on a file that isn't a model
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        trainer, normal = model.trainer_spec, model.normalizer_spec
        plain = trainer.model_type == trainer.BPE and trainer.byte_fallback and normal.escape_whitespaces
        if not plain or normal.precompiled_charsmap or normal.remove_extra_whitespaces or trainer.treat_whitespace_as_suffix:
            raise ValueError("only byte-pair models with byte fallback and identity normalisation are counted")
        ordinary = [p for p in model.pieces if p.type == p.NORMAL]
        if any(_SPACE in p.piece.lstrip(_SPACE) for p in ordinary) or any(p.type in (p.USER_DEFINED, p.UNUSED) for p in model.pieces):
            raise ValueError("a piece spans two words, or is defined by a user")
        self.head = " " if normal.add_dummy_prefix else ""
        self.rank = {p.piece: -p.score for p in ordinary}

    def count(self, segment: str) -> int:
        """Initial symbols minus merges; a symbol outside the vocabulary that stays alone counts its UTF-8 bytes."""
        symbols = list(segment.replace(" ", _SPACE))
        initial = len(symbols)
        rank = self.rank
        left = merge(symbols, lambda a, b: rank.get(a + b), lambda a, b: a + b)
        merges = initial - len(left)
        fallback = sum(len(x.encode("utf-8", "surrogatepass")) - 1 for x in left if x not in rank)
        return initial - merges + fallback


@lru_cache(2)
def _counter(path: str) -> tuple[str, WordTable]:
    model = PieceModel(path)
    return model.head, WordTable(lambda segments: [(model.count(s),) for s in segments])


def count_texts(texts: list[str], path: str) -> np.ndarray:
    """Number of tokens of each text."""
    head, table = _counter(path)
    totals = np.zeros(len(texts), np.int64)
    for run in layouts(texts, head):
        starts, ends = piece_segments(run)
        codes = np.where(run.codes == 0x2581, np.uint32(32), run.codes)
        slots = table.find(run, starts, ends, codes)
        np.add.at(totals, run.owner_of(starts), table.flat[table.start[slots]])
    return totals


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096) -> DataFrame:
    """One row per row of `docs`: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have 0 bytes and 0 tokens. Ids may be null or repeat; every row is counted by itself
    and other columns are not read. No begin or end tokens; special strings in a text are ordinary characters.
    The map has no shuffle; a worker holds about 4 million characters and a bounded table of word counts.
    """
    schema = f"{id_col} {type_of(docs, id_col)}, n_bytes bigint, n_tokens bigint"

    def count(batches):
        for rows, texts in text_batches(batches, "_text"):
            n_bytes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(n_bytes, pa.int64()), pa.array(count_texts(texts, model_path))],
                names=[id_col, "n_bytes", "n_tokens"],
            )

    counted = docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(count, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
