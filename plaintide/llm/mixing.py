"""Temperature mixing of sources under a token budget."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaintide.llm.scratch import written

#: The exponent is one of 0/GRID ... GRID/GRID.
GRID = 1024
#: Hexadecimal digits of the order key by which sums are taken at a time.
DIGITS = 3


#: Up to so many sources a table with one row per source (some 100 bytes each) is broadcast; beyond, the rows of
#: every source are dealt to SALTS parts and the source's row is copied to each.
BROADCAST_SOURCES, SALTS = 50_000, 64


def _with_row_of_source(rows: DataFrame, table: DataFrame, sources: int) -> DataFrame:
    """Inner join with a table that has at most one row per source and `sources` rows or less."""
    if sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(table), "_mix_source")
    part = F.pmod(F.xxhash64(*[c for c, kind in rows.dtypes if not kind.startswith("map")]), F.lit(SALTS))
    copies = table.withColumn("_mix_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_mix_part", part.cast("int"))
    return salted.join(copies, ["_mix_source", "_mix_part"]).drop("_mix_part")


def word_count(text):
    """Words between ASCII white space; null counts as empty."""
    words = F.split(F.coalesce(text, F.lit("")), "[ \\t\\n\\x0B\\f\\r]+")
    return F.size(words) - F.when(words[0] == "", 1).otherwise(0) - F.when(
        (F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)


def _with_source(docs: DataFrame, source_col: str, text_col: str, token_col: str | None) -> DataFrame:
    tokens = F.coalesce(F.col(token_col), F.lit(0)) if token_col else word_count(F.col(text_col))
    kept = [c for c in docs.columns if not c.lower().startswith("_mix_")]
    return docs.select(*kept, F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_mix_source"),
                       tokens.cast("bigint").alias("_mix_tokens"))


def _order_key(seed: int, id_col: str):
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col("_mix_passes").cast("string"), F.lit("|"),
                          F.coalesce(F.col(id_col).cast("string"), F.lit(""))))


def _measures(sources: DataFrame, step: int) -> tuple[float, float]:
    """Entropy of the weights (nats) and most passes over a source when the least is one, at exponent step/GRID.

    One aggregate: with s the share of a source and p = s**a, the entropy is ln(sum p) - a * sum(p ln s)/sum p,
    and passes go with p/s.
    """
    share = F.col("tokens") / F.col("_total")
    exponent = step / GRID
    power = F.pow(share, F.lit(exponent))
    row = sources.agg(
        F.sum(power).alias("z"), F.sum(power * F.log(share)).alias("e"),
        F.max(power / share).alias("most"), F.min(power / share).alias("least"),
    ).first()
    if not row.z:
        return 0.0, 1.0
    return math.log(row.z) - exponent * row.e / row.z, row.most / row.least


def choose_exponent(sources: DataFrame, target_entropy: float | None, max_passes: float | None) -> int:
    """Bisects the step: the largest exponent that reaches the entropy, or the smallest within the passes.

    Both measures are monotone in the exponent: entropy and passes fall as it grows to 1 (natural shares).
    If both are given, the limit on passes goes first.
    """

    def smallest(holds) -> int:
        low, high = 0, GRID
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if holds(middle) else (middle + 1, high)
        return low

    allowed = 0 if max_passes is None else smallest(lambda k: _measures(sources, k)[1] <= max_passes)
    if target_entropy is None:
        return allowed
    if _measures(sources, GRID)[0] >= target_entropy:
        return GRID
    return max(allowed, smallest(lambda k: _measures(sources, k)[0] < target_entropy) - 1, 0)


def mixing_plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                token_col: str | None = None, target_entropy: float | None = None, max_passes: float | None = 2.0,
                budget: int | None = None, seed: int = 1) -> DataFrame:
    """One row per source: source, docs, tokens, exponent, weight, quota (tokens), passes, cutoff.

    Tokens are those of `token_col`; without it, words between ASCII white space. A text without such spaces
    (Chinese, Japanese, Thai, or with no-break spaces only) then counts 1, however long: give `token_col` for those.

    Shares of tokens are raised to an exponent, which is bisected to reach `target_entropy` (nats) or to keep
    within `max_passes` passes over any source, and normalised. Of `budget` tokens each source gets its weight's
    part; without a budget it is the least one that takes every source through once, so that nothing is left out.
    A quota is `passes` whole permutations of the source (blocks) and a prefix of one more: its documents in the
    order of their keys, as long as the sum of tokens stays within the rest; `cutoff` is the last key that does
    (null: none). Equal keys (repeated rows) go together. A null source is the source ''; a source without
    tokens has weight 0 and one pass. An empty table gives an empty plan.

    Sums are taken over at most 16**DIGITS parts of the key space per source, then over those of the part where
    the quota ends, then over its few rows: no task sees a whole source.
    """
    rows = written(
        _with_source(docs, source_col, text_col, token_col).select(F.col(id_col).alias("_mix_id"), "_mix_source", "_mix_tokens"),
        "mixing-rows",
    )
    sources = rows.groupBy("_mix_source").agg(F.count("*").alias("docs"), F.sum("_mix_tokens").alias("tokens"))
    sources = written(sources, "sources")
    total, n = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    counted = sources.withColumn("_total", F.lit(float(total)))
    some = counted.filter("tokens > 0")
    step = choose_exponent(some, target_entropy, max_passes)
    weights = some.withColumn("_power", F.pow(F.col("tokens") / F.col("_total"), F.lit(step / GRID)))
    sums = weights.agg(
        F.sum("_power").alias("z"), F.min(F.col("_power") / F.col("tokens")).alias("least")
    ).first()
    if budget is None:
        budget = sums.z / sums.least if sums.z else 0
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("_total"), F.lit(step / GRID)) / F.lit(sums.z))
    quota = F.round(F.col("weight") * F.lit(float(budget))).cast("bigint")
    plan = written(
        counted.withColumn("exponent", F.lit(step / GRID))
        .withColumn("weight", F.coalesce(weight, F.lit(0.0)))
        .withColumn("quota", F.when(F.col("tokens") > 0, quota).otherwise(F.lit(0).cast("bigint")))
        .withColumn("_mix_passes", F.when(F.col("tokens") > 0, F.expr("quota div tokens")).otherwise(F.lit(1).cast("bigint")))
        .withColumn("_rest", F.when(F.col("tokens") > 0, F.col("quota") % F.col("tokens")).otherwise(F.lit(0).cast("bigint")))
        .drop("_total"),
        "mixing-plan",
    )
    keyed = written(
        _with_row_of_source(rows, plan.select("_mix_source", "_mix_passes", "_rest"), n).filter("_rest > 0")
        .select("_mix_source", _order_key(seed, "_mix_id").alias("_key"), "_mix_tokens"),
        "mixing-keys",
    )
    open_parts = plan.filter("_rest > 0").select("_mix_source", F.lit("").alias("_part"), F.col("_rest"))
    for level in (1, 2):
        # `open_parts` has one part of the key space per source: where the prefix ends.
        size = DIGITS * level
        within = _with_row_of_source(keyed, open_parts, n).filter(F.substring("_key", 1, size - DIGITS) == F.col("_part"))
        parts = within.groupBy("_mix_source", "_rest", F.substring("_key", 1, size).alias("_next")).agg(
            F.sum("_mix_tokens").alias("_mix_tokens"))
        running = F.sum("_mix_tokens").over(Window.partitionBy("_mix_source").orderBy("_next"))
        ends = parts.withColumn("_sum", running).filter("_sum > _rest")
        open_parts = written(
            ends.groupBy("_mix_source").agg(
                F.min(F.struct("_next", (F.col("_rest") - F.col("_sum") + F.col("_mix_tokens")).alias("r"))).alias("_end")
            ).select("_mix_source", F.col("_end._next").alias("_part"), F.col("_end.r").alias("_rest")),
            "mixing-parts",
        )
    last = _with_row_of_source(keyed, open_parts, n).filter(F.substring("_key", 1, 2 * DIGITS) == F.col("_part"))
    # Rows with one id share a key and go together, so any number of them is one row below.
    last = last.groupBy("_mix_source", "_rest", "_key").agg(F.sum("_mix_tokens").alias("_mix_tokens"))
    running = F.sum("_mix_tokens").over(Window.partitionBy("_mix_source").orderBy("_key"))
    inside = last.withColumn("_sum", running).filter("_sum <= _rest").groupBy("_mix_source").agg(F.max("_key").alias("_in"))
    cutoffs = open_parts.join(inside, "_mix_source", "left").select(
        "_mix_source", F.coalesce("_in", "_part").alias("cutoff"))
    return written(
        plan.join(cutoffs, "_mix_source", "left").select(
            F.col("_mix_source").alias("source"), "docs", "tokens", "exponent", "weight", "quota",
            F.col("_mix_passes").alias("passes"), "cutoff"),
        "mixing-plan",
    )


def planned_copies(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                   text_col: str = "text", token_col: str | None = None, seed: int = 1) -> DataFrame:
    """`docs` with _mix_source, _mix_tokens, _mix_passes and _mix_copies: how often each row is taken under `plan`.

    The plan has one row per source. Up to BROADCAST_SOURCES of them it is broadcast and no text is shuffled;
    beyond, rows are joined in SALTS parts per source. A row with a source that the plan lacks is left out. Columns
    of `docs` whose names begin with _mix_ are replaced.
    """
    plan = plan.select(F.col("source").alias("_mix_source"), F.col("passes").alias("_mix_passes"), F.col("cutoff").alias("_mix_cutoff"))
    extra = F.coalesce((_order_key(seed, id_col) <= F.col("_mix_cutoff")).cast("bigint"), F.lit(0))
    rows = _with_source(docs, source_col, text_col, token_col)
    placed = _with_row_of_source(rows, plan, plan.count())
    return placed.withColumn("_mix_copies", F.col("_mix_passes") + extra).drop("_mix_cutoff")


def block_permutations(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                       text_col: str = "text", token_col: str | None = None, seed: int = 1) -> DataFrame:
    """Every copy that the plan takes: doc (the row as a struct), source, pass (from 0), place, tokens.

    The copies of one source and pass are a block, and `place` puts them in the order of that pass: read by source,
    pass and place, each whole pass is a permutation of the source, another one each time, and the last block the
    first documents of one more. Rows that share an id share their places.
    """
    packed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"),
                         F.col(text_col).alias("_text"), *([F.col(token_col).alias("_tokens")] if token_col else []))
    copies = planned_copies(packed, plan, "_id", "_source", "_text", "_tokens" if token_col else None, seed)
    many = copies.filter("_mix_copies > 0").withColumn(
        "_mix_passes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_mix_copies") - 1)))
    return many.select("doc", F.col("_mix_source").alias("source"), F.col("_mix_passes").alias("pass"),
                       _order_key(seed, "_id").alias("place"), F.col("_mix_tokens").alias("tokens"))


def reading_order(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The copies of `block_permutations` laid out as they are read: id, source, tokens, pass, place.

    Written in the order of source, pass and place, in ranges of these, so a block of any size spreads over several
    tasks and files. Texts are not moved: the ids say which one to read next.
    """
    order = ["source", "pass", "place"]
    copies = blocks.select(F.col(f"doc.{id_col}").alias(id_col), "source", "tokens", "pass", "place")
    return written(copies.repartitionByRange(*order).sortWithinPartitions(*order), "mixing-order")


def copies_in(order: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """How often each row stands in a `reading_order` whose sources have a whole pass: id, source, n_tokens, copies.

    Rows with the same id and source share a key, so all of them are taken equally often; the first pass tells how
    many of them there are, and each has a row here.
    """
    taken = order.groupBy(id_col, "source", "tokens").agg(
        F.count("*").alias("_mix_n"), F.count_if(F.col("pass") == 0).alias("_mix_rows"))
    copies = F.expr("_mix_n div _mix_rows").cast("bigint")
    return taken.select(id_col, "source", F.col("tokens").alias("n_tokens"),
                        F.explode(F.array_repeat(copies, F.col("_mix_rows").cast("int"))).alias("copies"))


def mixed_documents(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", source_col: str = "source",
                    text_col: str = "text", token_col: str | None = None, seed: int = 1) -> DataFrame:
    """`docs` as the plan mixes them: every row as often as it is taken, with the columns of `docs`."""
    return block_permutations(docs, plan, id_col, source_col, text_col, token_col, seed).select("doc.*")
