"""TF-IDF over groups of texts: characteristic terms and unit vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plaintide.functions.terms import term_words, with_pairs
from plaintide.operators.skew import lookup
from plaintide.rules.stopwords import ENGLISH
from plaintide.runtime import cut_lineage

GROUP = "issue_label"
VOCABULARY = 300


def smooth_idf(documents, holding):
    """ln((1 + n) / (1 + df)) + 1."""
    return F.log((1 + documents) / (1 + holding)) + 1


def term_counts(texts: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """One row per text and term: issue_label, text_id, copies, term, tf.

    The texts are spread by (issue_label, text_id) once; counts and norms per text then need no
    further shuffle.
    """
    stop = ENGLISH if stop_words is None else stop_words
    words = texts.select(GROUP, "text_id", "copies", term_words(F.col("text"), stop).alias("_words"))
    spread = words.repartition(GROUP, "text_id")
    terms = spread.select(GROUP, "text_id", "copies", F.explode(with_pairs(F.col("_words"))).alias("term"))
    return terms.groupBy(GROUP, "text_id", "copies", "term").agg(F.count("*").alias("tf"))


def ranked_terms(
    texts: DataFrame, stop_words: list[str] | None = None, vocabulary: int = VOCABULARY
) -> DataFrame:
    """TF-IDF mass of the `vocabulary` most frequent terms per issue, each copy of a text counted.

    issue_label, term, mass (6 decimals). The kept vocabulary is at most `vocabulary` rows per
    issue label, which is what bounds the broadcast.
    """
    counts = term_counts(texts, stop_words)
    documents = texts.groupBy(GROUP).agg(F.sum("copies").alias("documents"))
    corpus = counts.groupBy(GROUP, "term").agg(
        F.sum(F.col("tf") * F.col("copies")).alias("frequency"), F.sum("copies").alias("holding")
    )
    order = Window.partitionBy(GROUP).orderBy(F.desc("frequency"), "term")
    kept = corpus.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= vocabulary)
    kept = kept.join(F.broadcast(documents), GROUP).select(
        GROUP, "term", smooth_idf(F.col("documents"), F.col("holding")).alias("idf")
    )
    weighted = counts.join(F.broadcast(kept), [GROUP, "term"]).withColumn(
        "weight", F.col("tf") * F.col("idf")
    )
    per_text = weighted.groupBy(GROUP, "text_id").agg(
        F.first("copies").alias("copies"),
        F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"),
        F.collect_list(F.struct("term", "weight")).alias("terms"),
    )
    shares = per_text.select(GROUP, "copies", "norm", F.inline("terms"))
    mass = F.sum(F.col("weight") / F.col("norm") * F.col("copies"))
    return shares.groupBy(GROUP, "term").agg(F.bround(mass, 6).alias("mass"))


def top_terms(ranked: DataFrame, n: int = 4) -> DataFrame:
    """The heaviest `n` terms per issue, skipping one that holds or is held by a term taken."""
    listed = ranked.groupBy(GROUP).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("mass")).alias("m"), "term"))).alias("_terms")
    )

    def take(taken, entry):
        term = entry["term"]
        near = F.exists(taken, lambda t: t.contains(term) | term.contains(t))
        return F.when((F.size(taken) < n) & ~near, F.concat(taken, F.array(term))).otherwise(taken)

    empty = F.array().cast("array<string>")
    return listed.select(GROUP, F.aggregate("_terms", empty, take).alias("keywords"))


def text_weights(texts: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Unit TF-IDF vectors of the distinct texts of each issue, every text counted once.

    One row per text and term that another text of the issue holds too: issue_label, text_id, term, weight, holding
    (texts with the term), place (a number of the term that rises with holding, then term). Terms of one text only
    count in its length, but have no row: they add to no product, and in the order of `place` they would come first.
    """
    distinct = texts.withColumn("copies", F.lit(1).cast("bigint"))
    counts = cut_lineage(term_counts(distinct, stop_words).select(GROUP, "text_id", "term", "tf"))
    documents = texts.groupBy(GROUP).agg(F.count("*").alias("documents"))
    holding = counts.groupBy(GROUP, "term").agg(F.count("*").alias("holding")).filter("holding > 1")
    order = ["holding", "term", GROUP]
    # Written, as the numbers come from the layout. One row per issue label is broadcast.
    idf = cut_lineage(
        holding.join(F.broadcast(documents), GROUP)
        .withColumn("idf", smooth_idf(F.col("documents"), F.col("holding"))).drop("documents")
        .repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    )
    sizes = idf.select(GROUP, "term", F.col("holding").alias("_n"))
    square = F.col("tf") * F.col("tf")
    # A text's counts without its shared ones are those of its own terms, which all have the idf of one text.
    every = counts.groupBy(GROUP, "text_id").agg(F.sum(square).alias("_every"))
    own_idf = smooth_idf(F.col("documents"), F.lit(1))
    every = every.join(F.broadcast(documents), GROUP).select(GROUP, "text_id", "_every", own_idf.alias("_own_idf"))
    raw = lookup(counts, idf, [GROUP, "term"], counts.count(), sizes=sizes).withColumn("_raw", F.col("tf") * F.col("idf"))
    one_text = Window.partitionBy(GROUP, "text_id")
    shared = raw.withColumn("_shared", F.sum(square).over(one_text)).withColumn(
        "_squares", F.sum(F.col("_raw") * F.col("_raw")).over(one_text))
    own = F.col("_own_idf") * F.col("_own_idf") * (F.col("_every") - F.col("_shared"))
    norm = F.sqrt(F.col("_squares") + own)
    return shared.join(every, [GROUP, "text_id"]).select(
        GROUP, "text_id", "term", (F.col("_raw") / norm).alias("weight"), "holding", "place")
