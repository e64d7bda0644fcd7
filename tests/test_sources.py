import random

import pytest
from pyspark.sql import functions as F

from plaintide.functions.text import clean_text
from plaintide.operators.scoring import score_all
from plaintide.operators.single import text_only_profile
from plaintide.sources import csv, tables
from plaintide.streaming import feedback as streaming


def written(tmp_path, content, encoding="utf-8"):
    path = tmp_path / "in.csv"
    path.write_bytes(content.encode(encoding))
    return str(path)


@pytest.mark.parametrize("separator", [",", ";", "\t", "|"])
def test_separators_types_and_bad_lines(spark, tmp_path, separator):
    lines = [["feedback ", "rating", "id"], ["nice box", "4.5", "1"], ["one", "2", "3", "4"], ["short"],
             ["bad", "NA", "7"]]
    path = written(tmp_path, "\n".join(separator.join(line) for line in lines) + "\n")
    df = csv.read_feedback_csv(spark, path)
    assert df.dtypes == [("feedback", "string"), ("rating", "double"), ("id", "double")]
    assert [tuple(r) for r in df.collect()] == [("nice box", 4.5, 1.0), ("short", None, None), ("bad", None, 7.0)]


def test_codes_that_casts_take_for_numbers_stay_text(spark, tmp_path):
    rows = [["order", "part", "hex", "n", "x", "big"], ["12d", "7f", "0x1p3", "+5", "1e3", "99999999999999999999"],
            ["13D", "8F", "0x2", "6 ", ".5", "1"], ["14", "9", "3", "-7", "Infinity", "2"]]
    df = csv.read_feedback_csv(spark, written(tmp_path, "\n".join(map(",".join, rows)) + "\n"))
    assert [k for _, k in df.dtypes] == ["string", "string", "string", "bigint", "double", "double"]
    assert [r.order for r in df.collect()] == ["12d", "13D", "14"]
    assert [r.n for r in df.collect()] == [5, 6, -7] and df.first().x == 1000.0


def test_encodings_quotes_and_line_breaks(spark, tmp_path):
    content = 'text,n\n"too, slow\nand ""late""",1\nschön,2\n'
    for encoding in ("utf-8", "utf-8-sig", "latin-1"):
        df = csv.read_feedback_csv(spark, written(tmp_path, content, encoding))
        assert df.dtypes == [("text", "string"), ("n", "bigint")]
        assert [r.text for r in df.collect()] == ['too, slow\nand "late"', "schön"]


def multi_line_rows(seed, n):
    r = random.Random(seed)
    texts = ["plain", 'a 5" screen', "two\nlines", 'said ""no"" to\n\nall', "comma, here", "", "x\r\ny", '""', "a\n,\n;b", '""\n""']
    rows = []
    for i in range(n):
        text = r.choice(texts)
        quoted = text != 'a 5" screen' and (r.random() < 0.3 or any(c in text for c in ',\n"'))
        rows.append(f'{i},"{text}",{r.choice(["k", ""])}' if quoted else f"{i},{text},k")
    return rows


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_multi_line_files_stay_splittable(spark, tmp_path, line_end):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        rows = multi_line_rows(k, 120)
        (folder / f"{k}.csv").write_bytes(line_end.join(["n,text,k", *rows, ""]).encode())
    (folder / "empty.csv").write_text("n,text,k\n")
    schema = "n string, text string, k string, over string"
    want = spark.read.csv(str(folder), schema=schema, header=True, multiLine=True, quote='"', escape='"').drop("over")
    want = sorted(map(str, want.fillna("").collect()))
    for size in ("64", "1000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", size if size != "128m" else "4m")
        found = csv.read_feedback_csv(spark, str(folder), separator=",")
        assert found.dtypes == [("n", "bigint"), ("text", "string"), ("k", "string")]
        assert sorted(map(str, found.withColumn("n", F.col("n").cast("string")).fillna("").collect())) == want
        lines = spark.read.text(str(folder))
        assert size == "128m" or lines.rdd.getNumPartitions() > 3
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_round_trip(spark, feedback, tmp_path):
    scored = score_all(feedback('late "refund", again', "so happy"), "feedback")
    path = str(tmp_path / "out")
    csv.write_analyzed_csv(scored, path)
    back = csv.read_feedback_csv(spark, path)
    assert back.columns == [c for c in scored.columns if c != "priority_reasons"]
    columns = ["feedback", "sentiment", "topic", "priority_score"]
    assert sorted(map(tuple, back.select(columns).collect())) == sorted(map(tuple, scored.select(columns).collect()))


def test_tables(spark, feedback, tmp_path):
    path = str(tmp_path / "t.parquet")
    feedback("a b").write.parquet(path)
    assert tables.read_feedback_table(spark, path).count() == 1


def test_stream_equals_table(spark, feedback, tmp_path):
    source = str(tmp_path / "source")
    df = feedback("late refund,  urgent", "so happy", None, "  ", "the app crashes")
    df.write.parquet(source)
    feed = streaming.read_feedback_stream(spark, source, df.schema)
    profiles = streaming.profile_stream(feed, "feedback", ["feedback_id"])
    out = str(tmp_path / "out")
    query = streaming.write_profiles(profiles, out, str(tmp_path / "state"))
    query.awaitTermination(120)
    more = feedback("rude agent again").selectExpr("feedback_id + 100 AS feedback_id", "feedback")
    more.write.mode("append").parquet(source)
    streaming.write_profiles(profiles, out, str(tmp_path / "state")).awaitTermination(120)
    streamed = spark.read.parquet(out)
    rows = df.union(more).filter("feedback IS NOT NULL").withColumn("feedback", clean_text(F.col("feedback")))
    batch = text_only_profile(rows.filter("feedback <> ''"), "feedback", ["feedback_id"])
    assert streamed.count() == 4
    assert sorted(map(str, streamed.select(*batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_text_only_profile(feedback):
    row = text_only_profile(feedback("My payment failed but the order was cancelled")).first()
    assert row.detected_issue == "Payment Issue" and row.is_complaint
    assert row.recommended_action == "Audit Payment Gateway & Billing System"
