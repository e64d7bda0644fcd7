"""A file of token ids in document order: blocks of Simple-8b words with offsets, and a table of shards."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.llm.arrow import text_batches, type_of
from plaintide.llm.byte_bpe import encode_texts
from plaintide.llm.segments import WordTable
from plaintide.llm.simple8b import pack, unpack

#: Ids after which a block is closed; a document is never split, so one block may hold more.
BLOCK_IDS = 1 << 17
#: Characters of a text by which rows of one id, or without one, are dealt to several shards.
RANGE_TEXT = 64


@lru_cache(2)
def _library(path: str) -> tuple[WordTable, dict[str, int]]:
    """Words are encoded by the tokenizers library, each distinct one once per worker while the table has room."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = {x.content: i for i, x in tokenizer.get_added_tokens_decoder().items()}

    def solve(words):
        return [x.ids for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    return WordTable(solve), special


def write_token_file(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                     end_id: int = 0) -> None:
    """Writes `path`/blocks and `path`/shards.

    Documents are range-partitioned by id and the text's beginning and sorted by id (equal ids by text; a null id comes
    first), so a shard is a stretch of the order, shards follow each other, and rows that share an id fill several. A row of blocks holds: shard, block, start (ids before it
    in its shard), doc_ids, counts (ids of each document, end id included), words (little-endian 64-bit),
    escapes (places of escape words). shards holds for each shard its first and last document, documents and ids.
    Null texts count as empty: the end id alone. Files are committed by Spark's writer; a lost task is run again.
    """
    kind = type_of(docs, id_col)
    schema = (f"shard int, block int, start bigint, n_ids bigint, doc_ids array<{kind}>, counts array<bigint>, "
              "words binary, escapes binary")

    def blocks(batches):
        table, special = _library(tokenizer_path)
        shard, block, start = TaskContext.get().partitionId(), 0, 0
        held, names, size = [], [], 0

        def close():
            numbers = np.concatenate(held)
            words, escapes = pack(numbers)
            return pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()),
                "start": pa.array([start], pa.int64()), "n_ids": pa.array([len(numbers)], pa.int64()),
                "doc_ids": pa.array([names], pa.list_(id_type)),
                "counts": pa.array([[len(x) for x in held]], pa.list_(pa.int64())),
                "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
                "escapes": pa.array([escapes.astype("<i4").tobytes()], pa.binary()),
            })

        for rows, texts in text_batches(batches, "_text"):
            id_type = rows.schema.field(0).type
            for name, ids in zip(rows.column(0).to_pylist(), encode_texts(texts, table, special)):
                held.append(np.append(ids, np.int32(end_id)))
                names.append(name)
                size += len(ids) + 1
                if size >= BLOCK_IDS:
                    yield close()
                    block, start = block + 1, start + size
                    held, names, size = [], [], 0
        if held:
            yield close()

    ordered = (
        docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
        .repartitionByRange(F.col(id_col).asc_nulls_first(), F.substring("_text", 1, RANGE_TEXT))
        .sortWithinPartitions(F.col(id_col).asc_nulls_first(), "_text")
    )
    ordered.mapInArrow(blocks, schema).write.option("compression", "zstd").parquet(f"{path}/blocks")
    written = docs.sparkSession.read.parquet(f"{path}/blocks")
    ends = written.select("shard", "block", "n_ids", F.col("doc_ids")[0].alias("first"),
                          F.element_at("doc_ids", -1).alias("last"), F.size("doc_ids").alias("n"))
    (
        ends.groupBy("shard")
        .agg(F.min_by("first", "block").alias("first_doc"), F.max_by("last", "block").alias("last_doc"),
             F.sum("n").alias("n_docs"), F.sum("n_ids").alias("n_ids"))
        .write.parquet(f"{path}/shards")
    )


def _shard_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each shard. One row per written partition, so the driver adds them up."""
    shards = spark.read.parquet(f"{path}/shards")
    rows = shards.orderBy(F.col("first_doc").asc_nulls_first(), F.col("last_doc").asc_nulls_first(), "shard").collect()
    before, at = [], 0
    for row in rows:
        before.append((row.shard, at))
        at += row.n_ids
    return spark.createDataFrame(before, "shard int, _before bigint")


def _documents(spark: SparkSession, path: str, value, column: str, kind: str) -> DataFrame:
    blocks = spark.read.parquet(f"{path}/blocks")
    id_kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    value_type = {"array<bigint>": pa.list_(pa.int64()), "bigint": pa.int64()}[kind]

    def read(batches):
        for batch in batches:
            for shard, start, names, counts, words, escapes in zip(*(c.to_pylist() for c in batch.columns)):
                ids = unpack(np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<i4"), sum(counts))
                ends = np.cumsum(counts)
                parts = np.split(ids, ends[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(counts), pa.int32()),
                     pa.array(names, batch.schema.field("doc_ids").type.value_type),
                     pa.array(start + ends - counts, pa.int64()), pa.array(counts, pa.int64()),
                     pa.array([value(x) for x in parts], value_type)],
                    names=["shard", "doc_id", "start", "n_tokens", column],
                )

    chosen = blocks.select("shard", "start", "doc_ids", "counts", "words", "escapes")
    found = chosen.mapInArrow(read, f"shard int, doc_id {id_kind}, start bigint, n_tokens bigint, {column} {kind}")
    return (
        found.join(F.broadcast(_shard_starts(spark, path)), "shard")
        .select("doc_id", (F.col("start") + F.col("_before")).alias("start"), "n_tokens", column)
    )


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids of every document of the file."""
    return _documents(spark, path, lambda x: x.astype(np.int64), "ids", "array<bigint>")


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_token_file, with ids_crc32 (of the ids as little-endian unsigned 32-bit integers) for the ids."""
    return _documents(spark, path, lambda x: zlib.crc32(x.astype("<u4").tobytes()), "ids_crc32", "bigint")
