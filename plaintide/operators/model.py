"""A trained text classifier: TF-IDF of words and word pairs with multinomial logistic regression."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plaintide.functions.sentiment import probabilities
from plaintide.functions.terms import term_words, with_pairs
from plaintide.operators.cleaning import dense_ids
from plaintide.operators.vectors import smooth_idf
from plaintide.rules.sentiment import LABELS
from plaintide.runtime import cut_lineage

MIN_ROWS = 60
#: A model is fitted on every labelled text and every term. Who wants a smaller one sets MAX_TERMS: the terms that most
#: texts hold, none longer than MAX_TERM_LENGTH characters.
MAX_TERMS, MAX_TERM_LENGTH = None, 200
C = 5.0
FOLDS = 5


def training_rows(df: DataFrame, text: str, label: str, key: str) -> DataFrame:
    """Distinct texts with their first label, if it is one of the three: text, label."""
    known = df.filter(F.col(text).isNotNull() & F.col(label).isNotNull())
    first = F.min(F.struct(F.col(key).alias("k"), F.col(label).alias("label")))["label"]
    rows = known.groupBy(F.col(text).alias("text")).agg(first.alias("label"))
    return rows.filter(F.col("label").isin(LABELS))


def require_enough(rows: DataFrame, least: int = MIN_ROWS) -> DataFrame:
    if rows.limit(least).count() < least:
        raise ValueError(f"a text model needs at least {least} distinct labelled texts")
    return rows


def bounded(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The rows, or `most` of them by a hash of the text if that is given, written and numbered: id, text, label."""
    chosen = rows.select("text", "label")
    if most is not None:
        chosen = chosen.orderBy(F.xxhash64("text"), "text").limit(most)
    return cut_lineage(chosen.withColumn("id", F.monotonically_increasing_id()))


@dataclass
class TextModel:
    """Terms in order with their idf, one weight per term and class, and one intercept per class."""

    terms: list[str]
    idf: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray

    @cached_property
    def known_terms(self) -> pa.Array:
        return pa.array(self.terms, pa.string())

    def scores(self, terms: pa.ListArray) -> np.ndarray:
        """Class probabilities (a row each) of lists of terms; terms unknown to the model don't count.

        The batch is one sparse matrix: places and counts of the known terms by row, scaled to unit rows and
        multiplied with the weights.
        """
        rows = len(terms)
        sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
        flat = terms.flatten()
        found = pc.index_in(flat, value_set=self.known_terms.cast(flat.type))
        known = found.is_valid().to_numpy(zero_copy_only=False)
        places = found.drop_null().to_numpy().astype(np.int64)
        width = max(len(self.terms), 1)
        cells, counts = np.unique(np.repeat(np.arange(rows), sizes)[known] * width + places, return_counts=True)
        row, place = np.divmod(cells, width)
        values = (1 + np.log(counts)) * self.idf[place]
        norms = np.sqrt(np.bincount(row, values * values, rows))
        values = values / norms[row]
        logits = np.stack([np.bincount(row, values * w[place], rows) for w in self.weights], axis=1) + self.intercepts
        odds = np.exp(logits - logits.max(axis=1, initial=-np.inf, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def with_probabilities(self, df: DataFrame, feedback: str, name: str = "_probs") -> DataFrame:
        """Adds the class probabilities (negative, neutral, positive); absent classes get 0, null texts null.

        A projection: terms are found by Spark expressions, and Arrow batches of them are scored against the
        broadcast model, so it needs no shuffle and works on streams.
        """
        model = df.sparkSession.sparkContext.broadcast((self.terms, self.idf, self.weights, self.intercepts))
        return df.withColumn(
            name, F.when(F.col(feedback).isNotNull(), _scorer(model)(with_pairs(term_words(F.col(feedback)))))
        ).withColumn(name, F.when(F.col(name).isNotNull(), probabilities(*[F.col(name)[c] for c in SHARES])))

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the model as a Parquet table: a row per term, and the intercepts in the row without a term."""
        rows = [(None, None, *map(float, self.intercepts))]
        rows += [(t, float(i), *map(float, w)) for t, i, w in zip(self.terms, self.idf, self.weights.T)]
        spark.createDataFrame(rows, MODEL_SCHEMA).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        rows = spark.read.schema(MODEL_SCHEMA).parquet(path).toPandas()
        head, body = rows[rows["term"].isna()], rows[rows["term"].notna()].sort_values("term")
        return cls(body["term"].tolist(), body["idf"].to_numpy(), body[SHARES].to_numpy().T, head[SHARES].to_numpy()[0])


SHARES = ["negative", "neutral", "positive"]
MODEL_SCHEMA = "term string, idf double, negative double, neutral double, positive double"
_loaded: dict[int, TextModel] = {}


def _scorer(model):
    """The scoring function for a broadcast model, which each Python worker builds once."""
    number = model._jbroadcast.id() if hasattr(model, "_jbroadcast") else id(model)

    @F.arrow_udf("negative double, neutral double, positive double")
    def score(terms: pa.Array) -> pa.Array:
        if number not in _loaded:
            _loaded.clear()
            _loaded[number] = TextModel(*model.value)
        columns = _loaded[number].scores(terms).T
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=SHARES)

    return score


def term_counts(rows: DataFrame) -> DataFrame:
    """id, term, tf; a text without terms keeps one row with a null term."""
    terms = with_pairs(term_words(F.col("text")))
    return rows.select("id", F.explode_outer(terms).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))


def build_vocabulary(counts: DataFrame, documents: int) -> DataFrame:
    """Every term of the training texts, in order, with index and idf.

    With MAX_TERMS the ones that most texts hold (ties: the smaller one).
    """
    usable = counts.filter(F.col("term").isNotNull())
    if MAX_TERMS is not None:
        usable = usable.filter(F.length("term") <= MAX_TERM_LENGTH)
    kept = usable.groupBy("term").agg(F.count("*").alias("holding"))
    if MAX_TERMS is not None:
        kept = kept.orderBy(F.desc("holding"), "term").limit(MAX_TERMS)
    numbered = dense_ids(cut_lineage(kept), ["term"], "index")
    indexed = numbered.withColumn("index", (F.col("index") - 1).cast("int"))
    return cut_lineage(indexed.select("term", "index", smooth_idf(F.lit(documents), F.col("holding")).alias("idf")))


def features(counts: DataFrame, vocabulary: DataFrame, terms: int) -> DataFrame:
    """id and the unit TF-IDF vector of each text, with logarithmic term counts."""
    weighted = counts.join(vocabulary, "term", "left").withColumn("weight", (1 + F.log("tf")) * F.col("idf"))
    entry = F.when(F.col("index").isNotNull(), F.struct("index", "weight"))
    gathered = weighted.groupBy("id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    norm = F.sqrt(F.aggregate("entries", F.lit(0.0), lambda s, e: s + e["weight"] * e["weight"]))
    unit = gathered.withColumn("_norm", norm)
    # Spark has no SQL constructor for sparse vectors; reading one from JSON stays in the JVM.
    sparse = F.struct(
        F.struct(
            F.lit(0).alias("type"),
            F.lit(terms).alias("size"),
            F.transform("entries", lambda e: e["index"]).alias("indices"),
            F.transform("entries", lambda e: e["weight"] / F.col("_norm")).alias("values"),
        ).alias("v")
    )
    schema = T.StructType([T.StructField("v", VectorUDT())])
    return unit.select("id", F.from_json(F.to_json(sparse), schema)["v"].alias("features"))


def train_text_model(rows: DataFrame, most: int | None = None) -> TextModel:
    """Fits the classifier on the `training_rows`; classes weigh the same whatever their size.

    On all of them, unless `most` asks for fewer.
    """
    return _fitted(bounded(require_enough(rows), most))


def _fitted(rows: DataFrame) -> TextModel:
    counts = cut_lineage(term_counts(rows))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    vocabulary = build_vocabulary(counts, total)
    known = vocabulary.orderBy("index").toPandas()
    index = F.coalesce(*[F.when(F.col("label") == n, F.lit(float(i))) for i, n in enumerate(LABELS)])
    weight = F.coalesce(
        *[F.when(F.col("label") == n, F.lit(total / (len(sizes) * size))) for n, size in sizes.items()]
    )
    examples = features(counts, vocabulary, max(len(known), 1)).join(rows, "id").select(
        "features", index.alias("label"), weight.alias("weight")
    )
    classifier = LogisticRegression(
        family="multinomial", regParam=1.0 / (C * total), elasticNetParam=0.0, maxIter=2000, tol=1e-4,
        standardization=False, weightCol="weight",
    ).fit(cut_lineage(examples))
    weights, intercepts = np.zeros((len(LABELS), len(known))), np.full(len(LABELS), -np.inf)
    fitted = classifier.coefficientMatrix.toArray()
    for i in range(classifier.numClasses):
        if LABELS[i] in sizes:
            weights[i] = fitted[i][: len(known)]
            intercepts[i] = classifier.interceptVector[i]
    return TextModel(known["term"].tolist(), known["idf"].to_numpy(), weights, intercepts)


def predicted_label(probs: Column) -> Column:
    scores = [probs["negative"], probs["neutral"], probs["positive"]]
    best = F.greatest(*scores)
    return F.coalesce(*[F.when(s == best, F.lit(n)) for n, s in zip(LABELS, scores)])


def training_folds(rows: DataFrame, folds: int = FOLDS) -> DataFrame:
    """id, text, label, fold of all rows: every label is dealt out evenly, in the order of a hash of the text."""
    kept = cut_lineage(rows.select("text", "label"))
    numbered = dense_ids(kept.withColumn("_hash", F.xxhash64("text")), ["label", "_hash"], "id").drop("_hash")
    # One row per label.
    first = numbered.groupBy("label").agg(F.min("id").alias("_first"))
    fold = ((F.col("id") - F.col("_first")) % folds).cast("int")
    return cut_lineage(numbered.join(F.broadcast(first), "label").select("id", "text", "label", fold.alias("fold")))


def cross_validated_predictions(rows: DataFrame, folds: int = FOLDS, most: int | None = None) -> DataFrame:
    """Held-out prediction of every training text: text, label, predicted.

    Each fold's model is fitted on the texts outside it (on `most` of them, if given); all texts are predicted.
    """
    folded = training_folds(require_enough(rows), folds)
    predictions = None
    for fold in range(folds):
        trained = _fitted(bounded(folded.filter(F.col("fold") != fold), most))
        held_out = folded.filter(F.col("fold") == fold).select("text", "label")
        scored = trained.with_probabilities(held_out, "text", "probs")
        scored = scored.select("text", "label", predicted_label(F.col("probs")).alias("predicted"))
        predictions = scored if predictions is None else predictions.unionByName(scored)
    return predictions


def cross_validated_accuracy(rows: DataFrame, folds: int = FOLDS, most: int | None = None) -> DataFrame:
    """Held-out accuracy in percent, one row."""
    hits = (F.col("label") == F.col("predicted")).cast("int")
    return cross_validated_predictions(rows, folds, most).agg(
        F.count("*").alias("texts"), F.bround(F.avg(hits) * 100, 1).alias("accuracy")
    )
