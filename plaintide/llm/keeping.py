"""Rows of a table chosen by id and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def text_hash(text):
    """64 bits of the text, which tell rows apart that share an id; null counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_documents(docs: DataFrame, kept: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with an id and text of `kept` (columns id and _text_hash), repeated ones once.

    Both sides are shuffled by id, and repeated rows are dropped in the same partitions. All columns stay.
    """
    marked = docs.withColumn("_keep_hash", text_hash(F.col(text_col)))
    wanted = kept.select(F.col(id_col).alias("_keep_id"), F.col("_text_hash").alias("_keep_text"))
    found = marked.join(
        wanted, F.col(id_col).eqNullSafe(F.col("_keep_id")) & (F.col("_keep_hash") == F.col("_keep_text")), "left_semi")
    same = Window.partitionBy(id_col, "_keep_hash").orderBy("_keep_hash")
    return found.withColumn("_keep_nth", F.row_number().over(same)).filter("_keep_nth = 1").select(*docs.columns)
