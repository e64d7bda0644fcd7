"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Row weight of pre-counted frames: operators on labels accept the enriched rows as well as the
# label profile, in which one row stands for many.
WEIGHT = "_rows"


def computed_once(
    df: DataFrame, layers: list[dict[str, Column]], outputs: dict[str, Column] | list[str]
) -> DataFrame:
    """Adds the `outputs` from the columns that `layers` compute, one projection per layer.

    `outputs` are names of such columns, or plain column references by their final names; they
    replace columns of `df` with the same name, which the layers can still read.

    A layer reads the columns of the layers before it, so each value is computed once however many
    expressions use it. Spark pushes a filter on a computed column below it by repeating the
    expression, which for a scorer means to score every row again, at a plan size that multiplies
    with every layer. The output of a generator is not pushed through, so the finished columns pass a
    one-row generator.
    """
    scored = df
    for layer in layers:
        scored = scored.select("*", *[column.alias(name) for name, column in layer.items()])
    kept = [c for c in df.columns if c not in outputs]
    named = outputs if isinstance(outputs, dict) else {n: F.col(n) for n in outputs}
    row = F.struct(*[column.alias(name) for name, column in named.items()])
    return scored.select(*kept, F.inline_outer(F.array(row)))


def merged(*chains: list[dict[str, Column]]) -> list[dict[str, Column]]:
    """Layer lists side by side: the first layers of all of them, then the second ones, ..."""
    return [
        {name: column for layer in level if layer for name, column in layer.items()}
        for level in zip_longest(*chains)
    ]


def row_weight(df: DataFrame) -> Column:
    return F.col(WEIGHT) if WEIGHT in df.columns else F.lit(1)


def row_count(df: DataFrame) -> Column:
    """Aggregate: the number of rows, BIGINT and 0 on empty input."""
    return F.coalesce(F.sum(row_weight(df)), F.lit(0)).cast("bigint")


def count_where(df: DataFrame, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, row_weight(df))), F.lit(0)).cast("bigint")


def counts_by(df: DataFrame, *columns, name: str = "count") -> DataFrame:
    return df.groupBy(*columns).agg(row_count(df).alias(name))


def mode_by(df: DataFrame, group: str, column: str, name: str, count: str | None = None) -> DataFrame:
    """Most frequent non-null value of `column` per group; ties go to the smaller value.

    Counts first, so a group of any size reaches the second step as one row per value and task.
    """
    counts = counts_by(df.filter(F.col(column).isNotNull()), group, column, name="_n")
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v")))
    picked = counts.groupBy(group).agg(best.alias("_best"))
    columns = [F.col(group), F.col("_best.v").alias(name)]
    if count:
        columns.append((-F.col("_best.n")).alias(count))
    return picked.select(*columns)


def with_total(grouped: DataFrame, count: str, name: str = "_total") -> DataFrame:
    """Adds the sum of `count`. For frames with one row per label: one window over few rows."""
    return grouped.withColumn(name, F.sum(count).over(Window.partitionBy()))


def top_row(df: DataFrame, count: str, label: str) -> DataFrame:
    """The row with the highest count, the smaller label on ties."""
    return df.orderBy(F.desc(count), F.asc(label)).limit(1)


#: The label columns that reports and insights count by.
PROFILE = ["sentiment", "emotion", "topic", "topic_source", "topic_detected", "detected_issue", "issue_confidence",
           "is_complaint", "priority"]


def label_profile(df: DataFrame, period: str | None = None) -> DataFrame:
    """Row counts per combination of labels: the one aggregate that reports and insights need.

    Its size depends on the number of labels and months, not on the number of rows.
    """
    names = [n for n in PROFILE if n in df.columns] + ([period] if period else [])
    return df.groupBy(*names).agg(row_count(df).alias(WEIGHT))
