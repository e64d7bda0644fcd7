"""Cleaning: missing and empty text, duplicate records, short text, ids, quality counters."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaintide.functions.text import clean_text, word_count
from plaintide.operators.frames import computed_once
from plaintide.roles import ColumnRoles
from plaintide.runtime import cut_lineage

MIN_WORDS = 2

# Names of row numbers, and of ids that tell customers apart instead.
ROW_ID_NAME = r"(^id$|_id$|^index$|^unnamed)"
CUSTOMER_ID_NAME = r"(customer|user|client|account)"


def normalized_headers(names: list[str]) -> list[str]:
    """Trimmed names; the second and later copy of a name gets _1, _2, ..."""
    copies: dict[str, int] = {}
    result = []
    for name in (n.strip() for n in names):
        copy = copies.get(name, 0)
        copies[name] = copy + 1
        result.append(f"{name}_{copy}" if copy else name)
    return result


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*normalized_headers(df.columns))


def drop_missing(df: DataFrame, feedback: str) -> DataFrame:
    return df.filter(F.col(feedback).isNotNull())


def clean_feedback(df: DataFrame, feedback: str) -> DataFrame:
    cleaned = computed_once(
        df, [{"_clean": clean_text(F.col(feedback).cast("string"))}], ["_clean"]
    )
    return cleaned.select(*[F.col("_clean").alias(c) if c == feedback else c for c in df.columns])


def drop_empty(df: DataFrame, feedback: str) -> DataFrame:
    return df.filter(F.col(feedback) != "")


def dedupe_columns(columns: list[str], feedback: str) -> list[str]:
    """Columns that make two records the same: all but row numbers."""
    return [
        c
        for c in columns
        if c == feedback
        or not re.search(ROW_ID_NAME, c, re.IGNORECASE)
        or re.search(CUSTOMER_ID_NAME, c, re.IGNORECASE)
    ]


def dedupe_records(df: DataFrame, feedback: str, key: str = "feedback_id") -> DataFrame:
    """One record per set of equal ones, with the smallest row key; nulls are equal.

    A grouped minimum instead of a window: copies collapse before the shuffle, so a record that
    makes up a third of the table still reaches its reducer as one row per map task.
    """
    same = dedupe_columns(df.columns, feedback)
    rest = sorted((c for c in df.columns if c not in same), key=lambda c: c != key)
    if not rest:
        return df.dropDuplicates()
    if len(rest) == 1:
        return df.groupBy(*same).agg(F.min(rest[0]).alias(rest[0])).select(*df.columns)
    first = df.groupBy(*same).agg(F.min(F.struct(*rest)).alias("_first"))
    return first.select(
        *[F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns]
    )


def min_words(df: DataFrame, feedback: str, words: int = MIN_WORDS) -> DataFrame:
    return df.filter(word_count(F.col(feedback)) >= words)


def has_unique(df: DataFrame, column: str) -> bool:
    return df.groupBy(column).count().filter("count > 1").isEmpty()


def dense_ids(df: DataFrame, order_by: list[str], name: str = "feedback_id") -> DataFrame:
    """Numbers the rows 1..n by `order_by` without putting them into one task.

    Rows are range-partitioned and sorted, then written once, as the count per partition and the
    position in it have to come from the same layout. A hash of the row splits long ties.
    """
    ties = [c for c in df.columns if c not in order_by]
    tie_hash = F.xxhash64(*[F.col(c).cast("string") for c in ties]) if ties else F.lit(0)
    keyed = df.withColumn("_tie", tie_hash)
    order = [*order_by, "_tie", *ties]
    position = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = cut_lineage(
        keyed.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_pos", position)
    )
    # One row per partition.
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = placed.join(F.broadcast(starts), "_part").withColumn(
        name, F.col("_start") + F.col("_pos") + 1
    )
    return numbered.drop("_tie", "_part", "_pos", "_start")


def assign_feedback_id(
    df: DataFrame, order_by: list[str] | None = None, name: str = "feedback_id"
) -> DataFrame:
    """Keeps a supplied unique id, else numbers the rows; `order_by` defaults to all columns."""
    if name in df.columns and has_unique(df, name):
        return df
    rest = [c for c in df.columns if c != name]
    by = order_by or ([name] if name in df.columns else rest)
    if name in df.columns:
        by = ["_given" if c == name else c for c in by]
        numbered = dense_ids(df.withColumnRenamed(name, "_given"), by, name)
        return numbered.drop("_given").select(*df.columns)
    return dense_ids(df, by, name)


def clean_records(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """All cleaning steps in order, without the id check."""
    f = roles.feedback
    cleaned = drop_empty(clean_feedback(drop_missing(df, f), f), f)
    return min_words(dedupe_records(cleaned, f, roles.key), f)


#: Columns that distinct_records adds.
COPIES, WORDS = "_copies", "_word_count"


def distinct_records(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """The cleaned records, equal ones once, with `_copies` (rows of the source) and `_word_count`.

    One pass and one shuffle for everything that cleaning decides: `valid_records` filters this table and
    `quality_counters` adds it up. Of equal records the one with the smallest row key is kept. All rows without a
    text, which need no comparison, are one record with an empty text.
    """
    f = roles.feedback
    cleaned = clean_feedback(df, f)
    missing = F.col(f) == ""
    bare = cleaned.select(*[F.col(c) if c == f else F.when(~missing, F.col(c)).alias(c) for c in df.columns])
    same = dedupe_columns(df.columns, f)
    rest = sorted((c for c in df.columns if c not in same), key=lambda c: c != roles.key)
    kept = [F.min(F.struct(*rest)).alias("_first")] if rest else []
    grouped = bare.groupBy(*same).agg(F.count("*").alias(COPIES), *kept)
    columns = [F.col(f"_first.{c}").alias(c) if c in rest else F.col(c) for c in df.columns]
    return grouped.select(*columns, COPIES, word_count(F.col(f)).alias(WORDS))


def valid_records(records: DataFrame, feedback: str) -> DataFrame:
    """The rows of `distinct_records` that clean_records keeps, without the added columns."""
    return records.filter((F.col(feedback) != "") & (F.col(WORDS) >= MIN_WORDS)).drop(COPIES, WORDS)


def quality_counters(records: DataFrame, feedback: str) -> DataFrame:
    """Row counters of the cleaning steps from `distinct_records`, one row."""
    n, missing, short = F.col(COPIES), F.col(feedback) == "", F.col(WORDS) < MIN_WORDS

    def total(value):
        return F.coalesce(F.sum(value), F.lit(0)).cast("bigint")

    valid = total(F.when(~missing & ~short, 1))
    return records.agg(
        total(n).alias("records_received"),
        valid.alias("records_processed"),
        total(F.when(~missing, n - 1)).alias("duplicates_removed"),
        total(F.when(missing, n)).alias("missing_handled"),
        total(F.when(~missing & short, 1)).alias("short_removed"),
        valid.alias("valid_records"),
    )


def quality_report(df: DataFrame, roles: ColumnRoles) -> DataFrame:
    """Row counters of the cleaning steps, one row, from one shuffle of the distinct records."""
    f = roles.feedback
    if f not in df.columns:
        counters = ["records_processed", "duplicates_removed", "missing_handled", "short_removed", "valid_records"]
        zeros = [F.lit(0).cast("bigint").alias(c) for c in counters]
        return df.agg(F.count("*").alias("records_received")).select("records_received", *zeros)
    return quality_counters(distinct_records(df.select(*dedupe_columns(df.columns, f)), roles), f)
