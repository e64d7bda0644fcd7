"""Misra-Gries summaries of a column: the values that many rows share."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.arrow import type_of


def heavy_hitters(df: DataFrame, key: str, most: int = 1000) -> DataFrame:
    """Column `key`: every value that makes up 1/most of the rows, and at most 2*most values in all.

    Each task keeps 4*most counters. When there are more, the (4*most+1)-th largest count is taken from all and
    those that reach 0 go (the mergeable form of Misra and Gries' summary), so a count falls short by at most
    rows/(4*most); counters within that bound are not sent on. The summed counts of a value with N/most rows
    are then at least N/(2*most), and no more than 2*most values can have that many. Nulls are no value.
    """
    counters = 4 * most
    kind = type_of(df, key)

    def summary(batches):
        held, rows, arrow_kind = pd.Series(dtype="int64"), 0, None
        for batch in batches:
            column = batch.column(0)
            arrow_kind = column.type
            rows += len(column) - column.null_count
            held = held.add(column.to_pandas().value_counts(), fill_value=0)
            if len(held) > counters:
                held = held - held.nlargest(counters + 1).iloc[-1]
                held = held[held > 0]
        if arrow_kind is not None:
            held = held[held > rows / counters]
            yield pa.RecordBatch.from_arrays(
                [pa.array([*held.index, None], arrow_kind), pa.array([*held.astype("int64"), rows], pa.int64())],
                names=[key, "n"],
            )

    counted = df.select(key).mapInArrow(summary, f"{key} {kind}, n bigint").groupBy(key).agg(F.sum("n").alias("n"))
    # The row without a value has the number of all rows.
    total = counted.filter(F.col(key).isNull()).select(F.col("n").alias("_rows"))
    return (
        counted.filter(F.col(key).isNotNull())
        .join(F.broadcast(total), F.col("n") >= F.col("_rows") / (2 * most))
        .select(key)
    )
