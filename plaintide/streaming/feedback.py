"""Feedback streams: new texts are profiled as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plaintide.functions.text import clean_text
from plaintide.operators.single import text_only_profile
from plaintide.operators.text_sentiment import TextSentiment


def read_feedback_stream(
    spark: SparkSession, path: str, schema, format: str = "parquet", **options
) -> DataFrame:
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def profile_stream(
    feed: DataFrame,
    text: str = "feedback",
    keep: list[str] = (),
    text_sentiment: TextSentiment | None = None,
) -> DataFrame:
    """Cleaned texts with their profile. Row by row, so it needs no state and no watermark."""
    cleaned = feed.filter(feed[text].isNotNull()).withColumn(text, clean_text(feed[text]))
    return text_only_profile(cleaned.filter(cleaned[text] != ""), text, keep, text_sentiment)


def write_profiles(
    profiles: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Appends to Parquet; the checkpoint makes a restart go on where the last run ended."""
    writer = profiles.writeStream.format("parquet").outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint).option("path", path)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
