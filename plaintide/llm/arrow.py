"""Small helpers around Arrow batches in Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import DataType


def type_of(df: DataFrame, column: str) -> str:
    kind: DataType = df.schema[column].dataType
    return kind.simpleString()


def texts_of(column: pa.Array) -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of neighbours whose sizes add up to about `most`; one larger item is a range of its own."""
    a = total = 0
    for i, size in enumerate(sizes):
        if i > a and total + size > most:
            yield a, i
            a, total = i, 0
        total += size
    if len(sizes) > a:
        yield a, len(sizes)


def text_batches(batches, column: str = "text", most: int = 1 << 20):
    """(slice of the batch, its texts) with about `most` bytes of text each; only a slice becomes Python strings."""
    for batch in batches:
        for a, b in portions([n or 0 for n in pc.binary_length(batch.column(column)).to_pylist()], most):
            rows = batch.slice(a, b - a)
            yield rows, texts_of(rows.column(column))
