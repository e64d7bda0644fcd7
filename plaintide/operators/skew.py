"""Lookups that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1e-4
HOT_ROWS = 10_000


def lookup(
    big: DataFrame, table: DataFrame, keys: list[str], rows: int, counted: DataFrame | None = None,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Inner join of `big` (`rows` rows or less) with a `table` that is unique on `keys`.

    Keys with more than max(HOT_ROWS, rows * HOT_SHARE) rows are hot. There can be at most
    1 / HOT_SHARE of them whatever the data, so the list of them is broadcast, and nothing else: rows of
    a hot key are dealt to as many parts as it needs by a hash of the row, and the key's one row of the
    table is copied to each part. All rows then go through one shuffle join.

    `counted` has the same keys as `big`, where that is cheaper to read for counting them; `sizes` has the keys once
    and their rows in `big` as `_n`, where these are known.
    """
    limit = max(HOT_ROWS, int(rows * HOT_SHARE))
    if rows <= limit:
        return big.join(table, keys)
    if sizes is None:
        sizes = (big if counted is None else counted).groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = (
        sizes.filter(F.col("_n") > limit)
        .select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts"))
    )
    parts = F.coalesce("_parts", F.lit(1))
    hashable = [F.col(c) for c, kind in big.dtypes if not kind.startswith("map")]
    spread = big.join(F.broadcast(hot), keys, "left").withColumn("_part", F.pmod(F.xxhash64(*hashable), parts).cast("int"))
    copies = table.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return spread.drop("_parts").join(copies.drop("_parts"), [*keys, "_part"]).drop("_part")
