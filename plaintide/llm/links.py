"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plaintide.llm.scratch import written


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node of it) of every node in the link table (columns a and b).

    In each round every node moves to the neighbour, or itself, that a hash drawn for the round makes smallest;
    links are renamed and equal ones merged. The nodes left shrink by a constant factor, whatever the shape, as
    the order is new each time. A node's neighbours are only ever reduced to a minimum (combined on the map
    side), and each round's tables are written, so hubs make no hot task that Spark cannot split and lineage
    stays short. The moves are then followed back from the last round to the first.
    """
    rest = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    moves, turn = [], 0
    while not rest.isEmpty():
        turn += 1
        near = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))

        def drawn(name, turn=turn):
            return F.struct(F.xxhash64(F.col(name), F.lit(turn)).alias("h"), F.col(name).alias("v"))

        best = near.groupBy("a").agg(F.min(drawn("b")).alias("_best"))
        move = written(best.select(F.col("a").alias("node"), F.least(drawn("a"), "_best")["v"].alias("to")), "moves")
        moves.append(move)
        left = move.select(F.col("node").alias("a"), F.col("to").alias("_a"))
        right = move.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        renamed = rest.join(left, "a").join(right, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
        rest = written(
            renamed.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
            "links",
        )
    if not moves:
        return rest.select(F.col("a").alias("node"), F.col("b").alias("component"))
    final = moves.pop()
    while moves:
        later = final.select(F.col("node").alias("to"), F.col("to").alias("_end"))
        final = written(
            moves.pop().join(later, "to", "left").select("node", F.coalesce("_end", "to").alias("to")), "moves")
    smallest = written(final.groupBy("to").agg(F.min("node").alias("component")), "roots")
    return written(final.join(smallest, "to").select("node", "component"), "components")


def extended(grouped: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, component) that further links make of those in `grouped`.

    Links are renamed to the components they join, so only what is new is contracted.
    """
    def named(side):
        return grouped.select(F.col("node").alias(side), F.col("component").alias(f"_{side}"))

    ends = written(
        links.join(named("a"), "a", "left").join(named("b"), "b", "left")
        .select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b")),
        "renamed-links",
    )
    moved = components(ends).select(F.col("node").alias("component"), F.col("component").alias("_to"))
    nodes = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct()
    new = nodes.join(grouped, "node", "left_anti").withColumn("component", F.col("node"))
    every = grouped.unionByName(new).join(moved, "component", "left")
    return written(every.select("node", F.coalesce("_to", "component").alias("component")), "components")
