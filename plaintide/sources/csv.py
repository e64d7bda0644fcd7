"""Delimited text in and out."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaintide.operators.cleaning import normalized_headers
from plaintide.sources.records import quoted_records

# Separators tried, and texts read as missing.
SEPARATORS = [",", ";", "\t", "|"]
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
           "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

OVERFLOW = "_overflow"

#: What counts as a number: casts also accept Java's suffixes (12d, 7f) and hexadecimal forms, which are codes here.
WHOLE = r"^\s*[+-]?[0-9]+\s*$"
DECIMAL = r"(?i)^\s*[+-]?([0-9]+(\.[0-9]*)?(e[+-]?[0-9]+)?|\.[0-9]+(e[+-]?[0-9]+)?|inf|infinity)\s*$"


def detect_separator(lines: list[str]) -> str:
    """The separator that splits the header into most columns, a comma if none does."""
    header = next((line for line in lines if line.strip()), "")
    widths = {s: len(next(csv.reader([header], delimiter=s), [])) for s in SEPARATORS}
    return max(SEPARATORS, key=lambda s: widths[s])


def detect_layout(spark: SparkSession, path: str) -> tuple[str, bool]:
    """Encoding and whether quoted values span lines, from one pass over all lines.

    Text that is not UTF-8 is read as ISO-8859-1, which has a character for every byte. A value spans lines if
    it begins with a quote that its line does not close; a quote inside a value (5" screen) opens nothing. Files with
    such values are read by `quoted_records`, others by Spark's reader; both in splits.
    """
    line = F.col("value")
    starts = f"(^|[{''.join(SEPARATORS)}])"
    closed = F.regexp_replace(line, starts + r'\s*"([^"]|"")*"(?=$|[' + "".join(SEPARATORS) + r"\r])", "$1")
    found = spark.read.text(path).agg(
        F.max(~F.is_valid_utf8(line)).alias("broken"), F.max(closed.rlike(starts + r'\s*"')).alias("open_quote")
    ).first()
    return ("ISO-8859-1" if found["broken"] else "UTF-8"), bool(found["open_quote"])


def read_feedback_csv(
    spark: SparkSession,
    path: str,
    separator: str | None = None,
    encoding: str | None = None,
    multiline: bool | None = None,
) -> DataFrame:
    """A CSV file or folder with a header line; what is not given is found out from the data.

    Lines with more fields than the header are skipped, missing fields at the end are null, rows of
    missing values only stay (blank lines don't), columns that hold only numbers become BIGINT or DOUBLE.
    """
    if encoding is None or multiline is None:
        found_encoding, found_multiline = detect_layout(spark, path)
        encoding = encoding or found_encoding
        multiline = found_multiline if multiline is None else multiline
    reader = spark.read.option("encoding", encoding)
    lines = reader.csv(path, sep="\0", quote="")
    if not lines.columns:
        raise ValueError(f"{path} holds no header line")
    first = lines.filter(F.trim(F.col(lines.columns[0])) != "").head(1)
    if not first:
        raise ValueError(f"{path} holds no header line")
    head = [first[0][0].lstrip("\ufeff")]
    separator = separator or detect_separator(head)
    names = normalized_headers(next(csv.reader(head[:1], delimiter=separator)))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, OVERFLOW]])
    if multiline:
        raw = _parsed_records(quoted_records(spark, path, separator, encoding), schema, separator)
    else:
        raw = spark.read.csv(path, schema=schema, header=True, sep=separator, encoding=encoding, quote='"', escape='"',
                             mode="PERMISSIVE")
    kept = raw.filter(F.col(OVERFLOW).isNull()).drop(OVERFLOW)
    blank = kept.select(*[F.when(~F.col(n).isin(MISSING), F.col(n)).alias(n) for n in names])
    return _with_number_types(blank)


def _parsed_records(records: DataFrame, schema: T.StructType, separator: str) -> DataFrame:
    """The values of records, one each; the first record of a file is its header."""
    plain = ", ".join(f"c{i} string" for i in range(len(schema)))
    options = {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    parsed = records.filter("NOT first").select(F.from_csv("record", plain, options).alias("_r"))
    return parsed.select(*[F.col(f"_r.c{i}").alias(f.name) for i, f in enumerate(schema)])


def _number(value, kind: str, grammar: str):
    return F.when(value.rlike(grammar), value.try_cast(kind))


def _with_number_types(df: DataFrame) -> DataFrame:
    """Casts the text columns whose values are all numbers by a strict grammar; one aggregate over the data."""
    checks = []
    for i, name in enumerate(df.columns):
        value = F.col(name)
        checks += [
            F.count(value).alias(f"n_{i}"),
            F.count(_number(value, "bigint", WHOLE)).alias(f"i_{i}"),
            F.count(_number(value, "double", DECIMAL)).alias(f"d_{i}"),
        ]
    found = df.agg(F.count("*").alias("rows"), *checks).first()
    columns = []
    for i, name in enumerate(df.columns):
        values = found[f"n_{i}"]
        if values and found[f"i_{i}"] == values == found["rows"]:
            columns.append(F.col(name).try_cast("bigint").alias(name))
        elif values and found[f"d_{i}"] == values:
            columns.append(F.col(name).try_cast("double").alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def analyzed_columns(df: DataFrame) -> DataFrame:
    """Everything but the reasons, which are an array."""
    return df.drop("priority_reasons")


def write_analyzed_csv(df: DataFrame, path: str) -> None:
    analyzed_columns(df).write.csv(
        path, header=True, quote='"', escape='"', mode="errorifexists",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
