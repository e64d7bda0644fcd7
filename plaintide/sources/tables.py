"""Tables in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_feedback_table(spark: SparkSession, source: str) -> DataFrame:
    """A Parquet path or the name of a catalog table."""
    if "/" in source or source.endswith(".parquet"):
        return spark.read.parquet(source)
    return spark.table(source)
