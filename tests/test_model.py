import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plaintide.operators import model

POSITIVE = ["lovely", "great", "superb", "splendid"]
NEGATIVE = ["awful", "nasty", "broken", "dreadful"]
NEUTRAL = ["plain", "usual", "ordinary", "common"]
THINGS = ["box", "lid", "cup", "pen", "bag", "hat"]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = []
    for label, words in (("Positive", POSITIVE), ("Negative", NEGATIVE), ("Neutral", NEUTRAL)):
        rows += [(f"a {w} {t}", label) for w in words for t in THINGS]
    rows = [(i, *r) for i, r in enumerate(rows)]
    rows += [(900, "a lovely box", "Negative"), (901, None, "Positive"), (902, "strange one", "Odd")]
    return spark.createDataFrame(rows, "feedback_id int, feedback string, sentiment string")


def test_training_rows(labelled):
    rows = model.training_rows(labelled, "feedback", "sentiment", "feedback_id")
    assert rows.count() == 72
    assert rows.filter("text = 'a lovely box'").first().label == "Positive"


def test_model_learns_and_covers_every_row(spark, labelled):
    rows = model.training_rows(labelled, "feedback", "sentiment", "feedback_id").persist()
    trained = model.train_text_model(rows)
    asked = spark.createDataFrame([("a dreadful hat",), ("unseen",), (None,), ("a dreadful hat",)], "t string")
    scored = trained.with_probabilities(asked, "t", "p")
    found = scored.select("t", model.predicted_label(F.col("p")).alias("label")).collect()
    assert len(found) == 4
    assert [r.label for r in found if r.t == "a dreadful hat"] == ["Negative"] * 2
    total = scored.filter("t = 'unseen'").select(F.expr("p.negative + p.neutral + p.positive")).first()[0]
    assert total == pytest.approx(1.0)
    assert "Exchange" not in scored._jdf.queryExecution().executedPlan().toString()


def test_saved_model_scores_alike(spark, labelled, tmp_path):
    rows = model.training_rows(labelled, "feedback", "sentiment", "feedback_id")
    trained = model.train_text_model(rows)
    trained.save(spark, str(tmp_path / "model"))
    again = model.TextModel.load(spark, str(tmp_path / "model"))
    terms = pa.array([["lovely", "box"], ["dreadful"], [], ["unknown"], None])
    assert again.scores(terms) == pytest.approx(trained.scores(terms))


def by_hand(trained, text):
    """Class probabilities of one text, term by term."""
    words = [w for w in "".join(c if c.isalnum() or c == "_" else " " for c in text.lower()).split() if len(w) > 1]
    counts = Counter(t for t in [*words, *map(" ".join, zip(words, words[1:]))] if t in trained.terms)
    values = {t: (1 + math.log(n)) * trained.idf[trained.terms.index(t)] for t, n in counts.items()}
    norm = math.sqrt(sum(v * v for v in values.values()))
    logits = [b + sum(v / norm * w[trained.terms.index(t)] for t, v in values.items())
              for w, b in zip(trained.weights, trained.intercepts)]
    odds = [math.exp(x - max(logits)) for x in logits]
    return [x / sum(odds) for x in odds]


def test_predictions_by_hand(spark, labelled):
    trained = model.train_text_model(model.training_rows(labelled, "feedback", "sentiment", "feedback_id"))
    texts = ["a lovely LOVELY box", "dreadful, dreadful hat and cup", "", "x", "unseen words", "a plain pen a plain pen", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for batch in (1, 10_000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        found = trained.with_probabilities(df.coalesce(1), "t", "p").orderBy("i").collect()
        assert found[-1].p is None
        for row in found[:-1]:
            assert list(row.p) == pytest.approx(by_hand(trained, row.t))
    absent = model.TextModel(trained.terms, trained.idf, trained.weights, np.array([0.5, -np.inf, 0.1]))
    for text, row in zip(texts[:-1], absent.with_probabilities(df, "t", "p").orderBy("i").collect()):
        assert list(row.p) == pytest.approx(by_hand(absent, text)) and row.p[1] == 0


def test_fitted_weights_are_a_minimum(labelled):
    """The gradient of the regularised loss vanishes, computed text by text."""
    rows = model.training_rows(labelled, "feedback", "sentiment", "feedback_id")
    trained, texts = model.train_text_model(rows), rows.collect()
    sizes = Counter(r.label for r in texts)
    slope = trained.weights / (model.C * len(texts))
    for r in texts:
        probs = np.array(by_hand(trained, r.text))
        probs[model.LABELS.index(r.label)] -= 1
        words = r.text.split()[1:]
        own = Counter([*words, *map(" ".join, zip(words, words[1:]))])
        x = np.zeros(len(trained.terms))
        for t, n in own.items():
            x[trained.terms.index(t)] = (1 + math.log(n)) * trained.idf[trained.terms.index(t)]
        slope += np.outer(probs, x / np.sqrt((x * x).sum())) / (len(sizes) * sizes[r.label])
    assert np.abs(slope).max() < 2e-3


def test_vocabulary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(model, "MAX_TERMS", 3)
    rows = [(1, "aa"), (2, "aa"), (1, "bb"), (2, "bb"), (1, "cc"), (2, "dd"), (3, "x" * 300), (4, "x" * 300), (5, None)]
    counts = spark.createDataFrame(rows, "id int, term string")
    found = model.build_vocabulary(counts, 5).orderBy("index").collect()
    assert [r.term for r in found] == ["aa", "bb", "cc"] and [r["index"] for r in found] == [0, 1, 2]


def test_bound_on_labelled_rows(labelled):
    rows = model.training_rows(labelled, "feedback", "sentiment", "feedback_id")
    assert model.bounded(rows, 30).count() == 30
    assert len(model.train_text_model(rows, 40).terms) < len(model.train_text_model(rows).terms)


def test_every_text_and_term_is_learnt(spark, labelled, monkeypatch):
    """No text is left out of a large table, and no term for its length."""
    many = spark.range(100_001).select(F.concat_ws(" ", F.lit("text"), "id").alias("text"), F.lit("Neutral").alias("label"))
    monkeypatch.setattr(model, "_fitted", lambda rows: rows.count())
    assert model.train_text_model(many) == 100_001
    monkeypatch.undo()
    long = spark.createDataFrame([("x" * 300, "Neutral")], "text string, label string")
    rows = model.training_rows(labelled, "feedback", "sentiment", "feedback_id").unionByName(long)
    trained = model.train_text_model(rows)
    assert "x" * 300 in trained.terms and trained.terms == sorted(trained.terms)
    assert len(trained.terms) == 12 + 6 + 12 * 6 + 1


def test_folds_hold_every_label_alike(labelled):
    rows = model.training_rows(labelled, "feedback", "sentiment", "feedback_id")
    sizes = model.training_folds(rows).groupBy("label", "fold").count().collect()
    assert len(sizes) == 15 and {r["count"] for r in sizes} <= {4, 5}


def test_few_texts_are_enough_for_folds(labelled):
    rows = model.training_rows(labelled, "feedback", "sentiment", "feedback_id").limit(66)
    assert model.cross_validated_accuracy(rows).first().texts == 66


def test_bound_on_fitting_leaves_no_text_out(labelled, monkeypatch):
    rows = model.training_rows(labelled, "feedback", "sentiment", "feedback_id")
    bounded = model.bounded
    monkeypatch.setattr(model, "bounded", lambda rows, most=0: bounded(rows, 40))
    assert model.training_folds(rows).count() == 72
    assert model.cross_validated_accuracy(rows).first().texts == 72


def test_model_on_a_stream(spark, labelled, tmp_path):
    from plaintide import TextSentiment
    from plaintide.streaming.feedback import profile_stream, read_feedback_stream, write_profiles

    trained = model.train_text_model(model.training_rows(labelled, "feedback", "sentiment", "feedback_id"))
    labelled.select("feedback").write.parquet(str(tmp_path / "in"))
    feed = read_feedback_stream(spark, str(tmp_path / "in"), "feedback string")
    profiles = profile_stream(feed, text_sentiment=TextSentiment(model=trained, lexicon={"lovely": 2.0}))
    write_profiles(profiles, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).filter("feedback = 'a lovely cup'").first().sentiment == "Positive"


def test_too_few_texts(labelled):
    with pytest.raises(ValueError):
        model.train_text_model(
            model.training_rows(labelled.limit(20), "feedback", "sentiment", "feedback_id")
        )
