"""Column-role inference from names first and one aggregate over the values second."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaintide.rules.report import DATE_NAMES, FEEDBACK_NAMES, RATING_NAMES
from plaintide.rules.topic import CATEGORY_NAMES


def _named(df: DataFrame, names: list[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def _unpivot(stats: DataFrame, columns: list[str], measures: list[str]) -> DataFrame:
    """Turns the one-row aggregate with `measure_i` columns into one row per column."""
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("position"), F.lit(c).alias("column"),
            *[F.col(f"{m}_{i}").alias(m) for m in measures],
        )
        for i, c in enumerate(columns)
    ]
    return stats.select(F.inline(F.array(*rows)))


def text_lengths(df: DataFrame) -> DataFrame:
    """Mean text length of every non-numeric column: position, column, avg_length."""
    columns = [c for c in df.columns if c not in _numeric(df)]
    stats = df.agg(
        *[F.avg(F.length(F.col(c).cast("string"))).alias(f"avg_length_{i}")
          for i, c in enumerate(columns)]
    )
    return _unpivot(stats, columns, ["avg_length"])


def detect_feedback_column(df: DataFrame) -> str | None:
    """A known name, else the non-numeric column with the longest text, else the first column."""
    named = _named(df, FEEDBACK_NAMES)
    if named:
        return named
    if len(_numeric(df)) == len(df.columns):
        return df.columns[0] if df.columns else None
    order = [F.desc_nulls_last("avg_length"), F.asc("position")]
    return text_lengths(df).orderBy(*order).first()["column"]


def detect_date_column(df: DataFrame) -> str | None:
    named = _named(df, DATE_NAMES)
    if named:
        return named
    return next((c for c in df.columns if "date" in c.lower() or "time" in c.lower()), None)


def numeric_ranges(df: DataFrame) -> DataFrame:
    """Range of every BIGINT and DOUBLE column: position, column, low, high, values."""
    wide = (T.LongType, T.DoubleType, T.IntegerType)
    columns = [f.name for f in df.schema if isinstance(f.dataType, wide)]
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "position bigint, column string, low double, high double, values bigint"
        )
    measures = []
    for i, c in enumerate(columns):
        value = F.nanvl(F.col(c).cast("double"), F.lit(None))
        measures += [F.min(value).alias(f"low_{i}"), F.max(value).alias(f"high_{i}"),
                     F.count(value).alias(f"values_{i}")]
    return _unpivot(df.agg(*measures), columns, ["low", "high", "values"])


def detect_rating_column(df: DataFrame) -> str | None:
    """A known name, else the first numeric column with all its values in [1, 5]."""
    named = _named(df, RATING_NAMES)
    if named:
        return named
    fits = numeric_ranges(df).filter("values > 0 AND low >= 1 AND high <= 5")
    row = fits.orderBy("position").first()
    return row["column"] if row else None


def category_candidates(df: DataFrame, feedback: str | None = None) -> DataFrame:
    """Columns with a category-like name: position, column, labels (distinct), avg_length."""
    by_lower = {c.lower(): c for c in df.columns}
    columns = [by_lower[n] for n in CATEGORY_NAMES if n in by_lower and by_lower[n] != feedback]
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "position bigint, column string, labels bigint, avg_length double"
        )
    if len(columns) == 1:
        # One candidate: count per value first, which collapses repeats before the shuffle.
        value = F.col(columns[0]).cast("string")
        counted = df.groupBy(value.alias("v")).agg(F.count("*").alias("n"))
        stats = counted.filter("v IS NOT NULL").agg(
            F.count("*").alias("labels_0"),
            (F.sum(F.length("v") * F.col("n")) / F.sum("n")).alias("avg_length_0"),
        )
        return _unpivot(stats, columns, ["labels", "avg_length"])
    measures = []
    for i, c in enumerate(columns):
        value = F.col(c).cast("string")
        measures += [F.count_distinct(value).alias(f"labels_{i}"),
                     F.avg(F.length(value)).alias(f"avg_length_{i}")]
    return _unpivot(df.agg(*measures), columns, ["labels", "avg_length"])


def detect_category_column(df: DataFrame, feedback: str | None = None) -> str | None:
    """The best-named column with 2 to 30 distinct short values."""
    fits = category_candidates(df, feedback).filter("labels BETWEEN 2 AND 30 AND avg_length < 40")
    row = fits.orderBy("position").first()
    return row["column"] if row else None
