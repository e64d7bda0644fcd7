import pytest
from pyspark.sql import functions as F

from plaintide import ColumnRoles
from plaintide.functions.text import clean_text
from plaintide.operators import cleaning, columns


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("  hello world  ", "hello world"),
        ("hello   world", "hello world"),
        (None, ""),
        ("", ""),
        ("The product quality is excellent!", "The product quality is excellent!"),
        ("a\x00b\tc\x7f\n d", "a b c d"),
        (" über gut ₹5 ", "über gut ₹5"),
    ],
)
def test_clean_text(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "t string")
    assert df.select(clean_text(F.col("t"))).first()[0] == expected


@pytest.fixture
def messy(feedback):
    return feedback(
        "Great product, very happy!", "Terrible service, never again.", None, "   ",
        "Great product, very happy!", "ok", "The delivery was very late and I am disappointed.",
        "Product quality is bad.",
    )


def test_quality_report(messy):
    report = cleaning.quality_report(messy, ColumnRoles()).first().asDict()
    assert report == {
        "records_received": 8, "records_processed": 4, "duplicates_removed": 1,
        "missing_handled": 2, "short_removed": 1, "valid_records": 4,
    }
    kept = cleaning.clean_records(messy, ColumnRoles())
    assert sorted(r.feedback_id for r in kept.collect()) == [1, 2, 7, 8]


def test_quality_report_of_nothing(messy):
    report = cleaning.quality_report(messy.filter("false"), ColumnRoles()).first()
    assert set(report) == {0}
    without = cleaning.quality_report(messy.select("feedback_id"), ColumnRoles()).first()
    assert without.records_received == 8 and without.valid_records == 0


def test_dedupe_keeps_customers_apart(spark):
    rows = [(3, 1, "same text"), (1, 1, "same text"), (2, 2, "same text"), (4, None, "same text"),
            (5, None, "same text")]
    df = spark.createDataFrame(rows, "feedback_id int, customer_id int, feedback string")
    kept = cleaning.dedupe_records(df, "feedback")
    assert kept.columns == df.columns
    assert sorted(r.feedback_id for r in kept.collect()) == [1, 2, 4]


def test_dedupe_with_several_row_ids(spark):
    df = spark.createDataFrame([(2, 7, "x"), (1, 9, "x")], "feedback_id int, id int, feedback string")
    assert [tuple(r) for r in cleaning.dedupe_records(df, "feedback").collect()] == [(1, 9, "x")]


def test_dedupe_columns():
    names = ["feedback_id", "id", "index", "Unnamed: 0", "customer_id", "userId_id", "date", "feedback"]
    assert cleaning.dedupe_columns(names, "feedback") == ["customer_id", "userId_id", "date", "feedback"]


def test_headers():
    assert cleaning.normalized_headers([" a ", "a", "b", "a "]) == ["a", "a_1", "b", "a_2"]


def test_ids_are_dense_and_ordered_whatever_the_partitions(spark):
    rows = [(i % 3, i) for i in range(500)]
    df = spark.createDataFrame(rows, "grp int, value int").repartition(7)
    numbered = cleaning.assign_feedback_id(df, ["grp", "value"]).orderBy("feedback_id").collect()
    assert [r.feedback_id for r in numbered] == list(range(1, 501))
    assert [(r.grp, r.value) for r in numbered] == sorted(rows)


def test_ids_of_a_hot_key(spark):
    df = spark.createDataFrame([(1, i) for i in range(200)], "feedback_id int, value int")
    numbered = cleaning.assign_feedback_id(df)
    assert numbered.columns == df.columns
    assert sorted(r.feedback_id for r in numbered.collect()) == list(range(1, 201))
    unique = spark.createDataFrame([(5, 1), (9, 2)], "feedback_id int, value int")
    assert sorted(r.feedback_id for r in cleaning.assign_feedback_id(unique).collect()) == [5, 9]


def test_column_roles(spark):
    schema = "id int, remark string, points double, created_time string, category string"
    rows = [(i, "a fairly long remark", 1.0 + i % 5, "2024-01-01", f"c{i % 3}") for i in range(9)]
    df = spark.createDataFrame(rows, schema)
    assert columns.detect_feedback_column(df) == "remark"
    assert columns.detect_date_column(df) == "created_time"
    assert columns.detect_rating_column(df) == "points"
    assert columns.detect_category_column(df, "remark") == "category"
    assert columns.detect_category_column(df.withColumn("category", F.lit("one")), "remark") is None
    assert columns.detect_rating_column(df.withColumn("points", F.col("points") + 1)) is None
    assert columns.detect_feedback_column(df.withColumn("review", F.lit("x"))) == "review"
