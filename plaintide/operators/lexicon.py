"""Text sentiment from a valence lexicon.

The lexicon stays outside the plan but for a few words: each worker looks the words of an Arrow batch up in a
broadcast table, or, if the table is too large for that, the distinct words of the texts are joined with it.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plaintide.functions import lexicon as lex
from plaintide.functions.sentiment import compound_to_probabilities
from plaintide.operators.frames import computed_once
from plaintide.operators.skew import lookup
from plaintide.runtime import cut_lineage

#: Words up to which a dictionary is part of the expression, and bytes of a table up to which it is broadcast.
INLINE_WORDS, BROADCAST_BYTES = 256, 64 << 20

def lexicon_table(lexicon: DataFrame) -> DataFrame:
    """word and valence, one row per word: rows with nulls don't count, of several valences the smallest does."""
    rows = lexicon.select(F.col("word").cast("string").alias("word"), F.col("valence").cast("double").alias("valence"))
    return rows.dropna().groupBy("word").agg(F.min("valence").alias("valence"))


def _broadcast_lookup(spark: SparkSession, words: list[str], valences: list[float]):
    """A function from an array of words to the array of their valences (null if unknown), a batch at a time."""
    shared = spark.sparkContext.broadcast((words, valences))
    held: list[pa.Array] = []

    @F.arrow_udf("array<double>")
    def valences_of(batch: pa.Array) -> pa.Array:
        if not held:
            held.extend((pa.array(shared.value[0], pa.string()), pa.array(shared.value[1], pa.float64())))
        flat = batch.flatten()
        found = held[1].take(pc.index_in(flat, value_set=held[0].cast(flat.type)))
        sizes = pc.fill_null(pc.list_value_length(batch), 0)
        offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(sizes.cast(pa.int64()))])
        return pa.ListArray.from_arrays(offsets.cast(pa.int32()), found)

    return valences_of


def with_valences(df: DataFrame, words: str, lexicon: dict[str, float] | DataFrame, name: str) -> DataFrame:
    """Adds the valence of each word of the array `words`, null where the lexicon has none.

    A dictionary of up to INLINE_WORDS words is an expression. Larger ones, and tables of up to BROADCAST_BYTES,
    are looked up in a broadcast copy: a projection, whose plan doesn't depend on the size. A larger table is joined
    with the distinct words of the texts, whose positions bring the valences back; that needs a batch table.
    """
    if isinstance(lexicon, DataFrame):
        table = lexicon_table(lexicon)
        size = table.agg(F.coalesce(F.sum(F.octet_length("word") + 8), F.lit(0))).first()[0]
        if size > BROADCAST_BYTES:
            return _joined_valences(df, words, cut_lineage(table), name)
        rows = table.collect()
        lexicon = {r.word: r.valence for r in rows}
    if len(lexicon) <= INLINE_WORDS:
        return df.withColumn(name, lex.inline_valences(F.col(words), lexicon))
    found = _broadcast_lookup(df.sparkSession, list(lexicon), [float(v) for v in lexicon.values()])
    lower = F.transform(words, lambda w: F.lower(w))
    return df.withColumn(name, F.when(F.col(words).isNotNull(), found(lower)))


def _joined_valences(df: DataFrame, words: str, table: DataFrame, name: str) -> DataFrame:
    held = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    places = cut_lineage(held.select("_row", F.posexplode(F.transform(words, lambda w: F.lower(w))).alias("_at", "word")))
    facts = places.select("word").distinct().join(table, "word", "left")
    found = lookup(places, facts, ["word"], places.count())
    # One array per text, in the order of its words.
    arrays = found.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "valence"))).alias("_found"))
    values = F.transform("_found", lambda x: x["valence"])
    joined = held.join(arrays, "_row", "left")
    none = F.array().cast("array<double>")
    return joined.withColumn(name, F.when(F.col(words).isNotNull(), F.coalesce(values, none))).drop("_row", "_found")


def with_compound(
    df: DataFrame,
    feedback: str,
    lexicon: dict[str, float] | DataFrame | None = None,
    name: str = "compound",
) -> DataFrame:
    """Adds the compound score in [-1, 1]; a projection unless the lexicon is too large to broadcast."""
    words, facts = F.col("_valence_words"), F.col("_facts")
    upper = F.size(F.filter(words, lex.is_upper))
    split = df.withColumn("_valence_words", lex.words_of(F.col(feedback)))
    valued = with_valences(split, "_valence_words", lex.seed_lexicon() if lexicon is None else lexicon, "_valences")
    layers = [
        {
            "_facts": lex.word_facts(words, F.col("_valences")),
            "_mixed": (upper > 0) & (upper < F.size(words)),
        },
        {"_sum": lex.valence_sum(facts, F.col("_mixed"))},
        {name: lex.compound(F.col("_sum"), lex.punctuation_emphasis(F.col(feedback)))},
    ]
    return computed_once(valued, layers, [name]).drop("_valence_words", "_valences")


def with_lexicon_probabilities(
    df: DataFrame,
    feedback: str,
    name: str = "_probs",
    lexicon: dict[str, float] | DataFrame | None = None,
) -> DataFrame:
    """Adds the class probabilities by the lexicon (the seed one by default) as a struct, for `score_sentiment`."""
    scored = with_compound(df, feedback, lexicon, "_compound")
    return scored.withColumn(name, compound_to_probabilities(F.col("_compound"))).drop("_compound")
