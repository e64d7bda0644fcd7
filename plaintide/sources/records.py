"""Records of delimited text whose quoted values span lines, read line by line from file splits.

Whether a line begins inside a quoted value depends on all lines before it. Each line is a function from the state
before it (outside or inside a quoted value) to the state behind it: it keeps the state, turns it, or sets it. Such
functions compose, so the state before any line follows from the last line that sets it and the number of turns
since: a running sum inside each split, then over the splits of a file, one row each.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plaintide.runtime import cut_lineage


def leaves_open(line: Column, separator: str) -> Column:
    """Whether a line that begins outside quotes ends inside a quoted value.

    A value is quoted if it begins with a quote; a quote inside another value (5" screen) opens nothing.
    """
    mark = re.escape(separator)
    starts = rf"(^|{mark})\s*\""
    closed = F.regexp_replace(line, rf'(^|{mark})\s*"([^"]|"")*+"(?=$|{mark}|\r)', "$1")
    return closed.rlike(starts)


def _states(lines: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Adds what the rows before each one, among those with equal `by`, do to the state.

    `lines` has out and inn: the state behind a row that is met outside, or inside. Adds <name>_set (the state behind
    the last setting row before, turned by the rows since; null without one) and <name>_turned (whether the rows
    before turn the state, where none sets it).
    """
    sets, turns = F.col("out") == F.col("inn"), (F.col("out") & ~F.col("inn")).cast("long")
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    turned = F.coalesce(F.sum(turns).over(before), F.lit(0))
    counted = lines.withColumn("_turns", turned)
    last = F.last(F.when(sets, F.struct("out", F.col("_turns").alias("at"))), ignorenulls=True).over(before)
    found = counted.withColumn("_last", last)
    since = (F.col("_turns") - F.coalesce(F.col("_last.at"), F.lit(0))) % 2 == 1
    return found.withColumns({
        f"{name}_set": F.when(F.col("_last").isNotNull(), F.col("_last.out") != since),
        f"{name}_turned": since,
    }).drop("_turns", "_last")


def quoted_records(spark: SparkSession, path: str, separator: str, encoding: str = "UTF-8") -> DataFrame:
    """file, first (whether it is the file's first record) and record (text without the last line end).

    Lines are read from file splits, so a large file takes many tasks. They are written once with what lies before
    them in their split; only the lines of records that span several are grouped. Records are range-partitioned in
    the order of the files. Blank lines outside of quotes are no records.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    raw = F.decode(F.col("value").cast("binary"), encoding) if encoding != "UTF-8" else F.col("value")
    lines = text.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), raw.alias("value"))
    plain = ~F.col("value").contains('"')
    judged = lines.withColumns({
        "out": ~plain & leaves_open(F.col("value"), separator),
        "inn": plain | leaves_open(F.concat(F.lit('"'), F.col("value")), separator),
    })
    held = cut_lineage(_states(judged, ["file", "block"], ["line"], "line"))
    # One row per split: what all of its lines do.
    ends = held.groupBy("file", "block").agg(F.max_by(F.struct("line_set", "line_turned", "out", "inn"), "line").alias("e"))

    def behind(state: Column) -> Column:
        """The state behind the last line of a split that begins in `state`."""
        before = F.coalesce(F.col("e.line_set"), state != F.col("e.line_turned"))
        return F.when(before, F.col("e.inn")).otherwise(F.col("e.out"))

    splits = ends.select("file", "block", behind(F.lit(False)).alias("out"), behind(F.lit(True)).alias("inn"))
    begun = _states(splits, ["file"], ["block"], "split").select(
        "file", "block", F.coalesce("split_set", "split_turned").alias("_begins"))
    state = held.join(begun, ["file", "block"])
    inside = F.coalesce("line_set", F.col("_begins") != F.col("line_turned"))
    placed = state.select("file", "block", "line", "value", inside.alias("inside"),
                          F.when(inside, F.col("inn")).otherwise(F.col("out")).alias("open"))
    placed = cut_lineage(placed)
    single = placed.filter("NOT inside AND NOT open").select("file", "block", "line", "value")
    several = placed.filter("inside OR open")
    starts = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.last(F.when(~F.col("inside"), F.col("line")), ignorenulls=True).over(starts)
    own = several.withColumn("_start", start)
    # Lines before the first start of their split go with the last start of an earlier split.
    opened = own.groupBy("file", "block").agg(F.max("_start").alias("_last")).withColumn(
        "_from", F.last(F.when(F.col("_last").isNotNull(), F.struct(F.col("block").alias("b"), F.col("_last").alias("l"))),
                        ignorenulls=True)
        .over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    keyed = own.join(opened.select("file", "block", "_from"), ["file", "block"]).select(
        "file", F.when(F.col("_start").isNotNull(), F.struct(F.col("block").alias("b"), F.col("_start").alias("l")))
        .otherwise(F.col("_from")).alias("at"), F.struct("block", "line", "value").alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["value"]), "\n")
    long = keyed.groupBy("file", "at").agg(joined.alias("value")).select(
        "file", F.col("at.b").alias("block"), F.col("at.l").alias("line"), "value")
    # A record that ends in CR LF belongs to a file of such lines, whose line breaks are read as LF.
    unix = F.replace(F.regexp_replace("value", r"\r\z", ""), F.lit("\r\n"), F.lit("\n"))
    records = single.unionByName(long).withColumn("record", F.when(F.col("value").endswith("\r"), unix).otherwise(F.col("value")))
    records = records.filter(F.trim("record") != "")
    # One row per file.
    firsts = records.groupBy("file").agg(F.min(F.struct("block", "line")).alias("_first"))
    ordered = records.join(firsts, "file").orderBy("file", "block", "line")
    return ordered.select("file", (F.struct("block", "line") == F.col("_first")).alias("first"), "record")
