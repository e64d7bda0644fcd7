"""Exact de-duplication of texts up to white space, with frequent texts settled on the map side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.heavy import heavy_hitters
from plaintide.llm.keeping import keep_documents, text_hash
from plaintide.llm.scratch import written

#: Characters that don't count: space, tab, line feed, vertical tab, form feed, carriage return.
BLANK = " \t\n\x0b\x0c\r"


def text_digest(text):
    """SHA-256 (binary) of the text without white space; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANK, ""), 256))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     most_heavy: int = 1000) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are without white space; null and blank texts are equal to the empty one. In a
    group the row with the most code points stays, then the smallest id (null before all). A repeated row (same
    id, same length, same group) counts in group_size and gets the same answer as its twin.

    Digests are written once, so texts are read and hashed once. A Misra-Gries summary names the digests that
    1/most_heavy of all rows share; at most 2*most_heavy can. Their groups are counted exactly (verified) by
    partial aggregation and their winners broadcast, so a text that fills a third of the table is never
    shuffled. The other digests are grouped and joined by an ordinary shuffle of some 50 bytes a row; no group
    there has more than 1/most_heavy of the rows.
    """
    return _decisions(docs, id_col, text_col, most_heavy).drop("_text_hash")


def _decisions(docs: DataFrame, id_col: str, text_col: str, most_heavy: int) -> DataFrame:
    digests = written(
        docs.select(
            F.col(id_col).alias("_id"),
            text_hash(F.col(text_col)).alias("_text_hash"),
            F.char_length(F.coalesce(F.col(text_col), F.lit(""))).alias("_length"),
            text_digest(F.col(text_col)).alias("_digest"),
        ),
        "digests",
    )
    best = [F.min(F.struct((-F.col("_length")).alias("l"), F.col("_id").alias("i"))).alias("_best"),
            F.count("*").alias("_size")]
    heavy = written(heavy_hitters(digests, "_digest", most_heavy), "heavy-digests")
    winners = digests.join(F.broadcast(heavy), "_digest").groupBy("_digest").agg(*best)
    often = digests.join(F.broadcast(winners), "_digest")
    others = digests.join(F.broadcast(heavy), "_digest", "left_anti")
    seldom = others.join(others.groupBy("_digest").agg(*best), "_digest")
    return often.unionByName(seldom).select(
        F.col("_id").alias(id_col),
        F.col("_best.i").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_id").eqNullSafe(F.col("_best.i")) & (F.col("_length") == -F.col("_best.l"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
        "_text_hash",
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts: the one that exact_duplicates keeps."""
    return keep_documents(docs, _decisions(docs, id_col, text_col, 1000).filter("kept"), id_col, text_col)
