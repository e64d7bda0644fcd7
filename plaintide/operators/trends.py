"""Monthly trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaintide.operators.frames import counts_by
from plaintide.rules.issue import NO_ISSUE

# Shapes of dates in text, beside the ISO forms that a cast understands. Names of months and days.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november",
          "december"]
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
#: Two digits from here on are a year of the 1900s, others one of the 2000s.
FIRST_YEAR_OF_1900S = 69

_TIME = r"(?:,?[ t]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)? ?(?:am|pm)?(?: ?(?:z|utc|gmt|[+-]\d{2}:?\d{2}))?)?"
_DAY = r"(?:(?:" + "|".join(f"{d[:3]}(?:{d[3:]})?" for d in DAYS) + r")\.?,? )?"
_MONTH = r"([a-z]{3,9})\.?"
#: Shape of a text in lower case, and which group holds the year, the month and the day (0: the first of the month).
SHAPES = [
    (rf"^(\d{{4}})([/.])(\d{{1,2}})\2(\d{{1,2}}){_TIME}$", 1, 3, 4),
    (rf"^{_DAY}(\d{{1,2}})(?:st|nd|rd|th)?[ -](?:of )?{_MONTH},?[ -](\d{{4}}|\d{{2}}){_TIME}$", 3, 2, 1),
    (rf"^{_DAY}{_MONTH}[ -](\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}}){_TIME}$", 3, 1, 2),
    (rf"^{_MONTH},?[ -](\d{{4}})$", 2, 1, 0),
    (r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3),
]
#: Day and month in an order that the column decides: number, separator, number, year.
EITHER = rf"^{_DAY}(\d{{1,2}})([/.-])(\d{{1,2}})\2(\d{{4}}|\d{{2}}){_TIME}$"


def _tidy(value):
    return F.lower(F.regexp_replace(F.trim(value), r"\s+", " "))


def _year(text):
    """Four digits as they are, two by the rule of the century."""
    century = F.when(text >= f"{FIRST_YEAR_OF_1900S:02d}", "19").otherwise("20")
    return F.when(F.length(text) == 2, F.concat(century, text)).otherwise(text)


def _month(text):
    """The number of a month from digits or its name, "sept" or its first letters; null for other words.

    Names are looked up, as a test for each month would repeat the text's expression in the generated code.
    """
    names = {m[:n]: i + 1 for i, m in enumerate(MONTHS) for n in range(3, len(m) + 1)}
    named = F.create_map(*[F.lit(str(x)) for pair in names.items() for x in pair])
    return F.when(text.rlike(r"^\d"), text).otherwise(F.try_element_at(named, text))


def _class_of(text):
    """Separator and number of year digits of a text of the shape EITHER, empty for others."""
    separator, year = F.regexp_extract(text, EITHER, 2), F.regexp_extract(text, EITHER, 4)
    return F.concat(separator, F.when(year != "", F.length(year).cast("string")).otherwise(""))


def _read_dates(value, day_first: list[str]):
    """A text as a timestamp: its shape gives year, month and day, which are parsed once."""
    text = _tidy(value)
    first, second = (F.regexp_extract(text, EITHER, i) for i in (1, 3))
    numbers = [F.try_to_number(x, F.lit("99")) for x in (first, second)]
    # A month beyond 12 can only be the day, whatever the column says.
    day_leads = (_class_of(text).isin(day_first) & (numbers[1] <= 12)) | (numbers[0] > 12)
    month, day = F.when(day_leads, second).otherwise(first), F.when(day_leads, first).otherwise(second)
    parts = F.when(text.rlike(EITHER), F.concat_ws("-", _year(F.regexp_extract(text, EITHER, 4)), month, day))
    for shape, y, m, d in SHAPES:
        group = {i: F.regexp_extract(text, shape, i) for i in (y, m, d) if i}
        # Null without a month, unlike concat_ws.
        found = F.concat(_year(group[y]), F.lit("-"), _month(group[m]), F.lit("-"), group[d] if d else F.lit("1"))
        parts = parts.when(text.rlike(shape), found)
    digits = text.rlike(r"^\d+$")
    return F.when(parts.isNotNull(), F.try_to_timestamp(parts, F.lit("yyyy-M-d"))).when(
        ~digits | (F.length(text) == 4), F.trim(value).try_cast("timestamp"))


def date_layouts(df: DataFrame, date: str) -> list[str]:
    """The classes of dates (separator and year digits, as "/4") whose day stands before the month.

    One aggregate over all rows decides for the whole column, so 1/5 and 25/12 are read alike: the values that
    allow one order only vote for it. Without a majority the month goes first, but behind full stops the day.
    """
    text = _tidy(F.col(date))
    numbers = [F.try_to_number(F.regexp_extract(text, EITHER, i), F.lit("99")) for i in (1, 3)]
    votes = [F.count(F.when((numbers[i] > 12) & (numbers[1 - i] <= 12), 1)).alias(n) for i, n in enumerate(("day", "month"))]
    found = df.groupBy(_class_of(text).alias("class")).agg(*votes).filter(F.col("class") != "").collect()
    return sorted(r["class"] for r in found if r.day > r.month or (r.day == r.month and r["class"].startswith(".")))


def add_period(df: DataFrame, date: str, layouts: list[str] | None = None) -> DataFrame:
    """Adds `period` as yyyy-MM, null where the date is not readable.

    Texts are read by ISO and the usual shapes; `layouts` (from date_layouts) settles the order of day and month,
    which is found out from the column otherwise. Of two-digit years 69 to 99 are in the 1900s. Numbers are nanoseconds since 1970.
    """
    value, kind = F.col(date), df.schema[date].dataType
    if isinstance(kind, T.StringType):
        value = _read_dates(value, date_layouts(df, date) if layouts is None else layouts)
    elif isinstance(kind, T.NumericType):
        finite = F.nanvl(value.cast("double"), F.lit(None)) if isinstance(kind, (T.DoubleType, T.FloatType)) else value
        value = F.timestamp_micros((finite / 1000).try_cast("bigint"))
    elif isinstance(kind, T.BooleanType):
        value = F.lit(None).cast("timestamp")
    return df.withColumn("period", F.date_format(value, "yyyy-MM"))


def with_period(df: DataFrame, date: str, layouts: list[str] | None = None) -> DataFrame:
    """Adds `period` and drops the rows without a readable date."""
    return add_period(df, date, layouts).filter("period IS NOT NULL")


def volume_trend(dated: DataFrame) -> DataFrame:
    return counts_by(dated, "period").orderBy("period")


def sentiment_trend(dated: DataFrame) -> DataFrame:
    return counts_by(dated, "period", "sentiment").orderBy("period", "sentiment")


def topic_trend(dated: DataFrame) -> DataFrame:
    return counts_by(dated, "period", "topic").orderBy("period", "topic")


def issue_trend(dated: DataFrame) -> DataFrame:
    reported = dated.filter(F.col("detected_issue") != NO_ISSUE)
    return counts_by(reported, "period", name="complaints").orderBy("period")


def rising_negatives(trend: DataFrame, factor: float = 1.2) -> DataFrame:
    """One row if the later half of the months with negatives is that much worse on average.

    `trend` is a sentiment trend: one row per month and label, so the window sees a few months.
    """
    months = trend.filter("sentiment = 'Negative'")
    numbered = months.select(
        "count",
        F.row_number().over(Window.orderBy("period")).alias("i"),
        F.count("*").over(Window.partitionBy()).alias("n"),
    )
    later = F.col("i") > F.floor(F.col("n") / 2)
    halves = numbered.agg(
        F.max("n").alias("months"),
        F.avg(F.when(~later, F.col("count"))).alias("first_half"),
        F.avg(F.when(later, F.col("count"))).alias("second_half"),
    )
    tests = [F.col("months") >= 2, F.col("second_half") > F.col("first_half") * factor]
    return halves.filter(reduce(lambda a, b: a & b, tests))
