"""A bounded, balanced sample of labelled texts for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_column, modulus: int):
    """crc32 of the id as text, modulo `modulus`."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """_label (0 or 1) and _text of at most `per_class` documents of either label, chosen by a hash of the id.

    Labels other than 0 and 1 and rows without an id are passed over; an id with several label rows counts by
    its smallest label. The chosen ids, at most 2 * per_class, are broadcast, so texts are not shuffled. Of the
    rows that share an id the first text counts.
    """
    usable = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(F.col(id_col).alias("_sample_id")).agg(F.min(label_col).cast("int").alias("_label"))
    )
    order = F.xxhash64("_sample_id")
    chosen = [usable.filter(F.col("_label") == k).orderBy(order, "_sample_id").limit(per_class) for k in (0, 1)]
    texts = docs.select(F.col(id_col).alias("_sample_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    found = texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "_sample_id")
    return found.groupBy("_sample_id", "_label").agg(F.min("_text").alias("_text")).select("_label", "_text")
