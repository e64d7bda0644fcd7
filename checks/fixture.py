"""The feedback table of the checks, derived from `orders` and `part`; see FIXTURES.md, section 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FEEDBACK_SQL = """
WITH bank(i, s) AS (VALUES
 (0,'Delivery was delayed by several days and the courier never called.'),
 (1,'I was charged twice for the same order and the payment failed.'),
 (2,'My refund has still not been processed after 15 days.'),
 (3,'Customer service did not respond and the agent was rude.'),
 (4,'It took 6 days to respond to my ticket.'),
 (5,'I got overcharged, there was a hidden fee on the bill.'),
 (6,'I received the wrong item in the box.'),
 (7,'The screen was cracked and the box was crushed.'),
 (8,'It stopped working, totally useless.'),
 (9,'Flimsy build and poor quality material.'),
 (10,'I can''t log in, my account is locked.'),
 (11,'The app keeps crashing and the website is slow.'),
 (12,'The parcel is lost, I never received it.'),
 (13,'My order was cancelled without any explanation.'),
 (14,'Very disappointed, would not recommend.'),
 (15,'I love it, absolutely excellent and worth every rupee.'),
 (16,'Great value for money, highly recommend.'),
 (17,'Decent product, works as expected.'),
 (18,'The colour option is missing a feature I wanted.'),
 (19,'I am confused, the setting is unclear and I’m not sure.'),
 (20,'This is urgent, I demand an answer immediately.'),
 (21,'I will cancel and switch to a competitor.'),
 (22,'So frustrating, still waiting for my order.'),
 (23,'It is a box with a lid.')),
base AS (
 SELECT o.o_orderkey AS k, o.o_custkey AS c, o.o_orderdate AS d, p.p_name AS product,
        b1.s AS s1, b2.s AS s2
 FROM orders o
 JOIN part p ON p.p_partkey = o.o_orderkey % 100
 JOIN bank b1 ON b1.i = o.o_orderkey % 24
 JOIN bank b2 ON b2.i = o.o_custkey % 24),
one AS (
 SELECT k AS feedback_id, c AS customer_id, product,
        CASE WHEN k % 17 = 0 THEN NULL WHEN k % 4 = 0 THEN 'email' WHEN k % 4 = 1 THEN 'chat'
             WHEN k % 4 = 2 THEN 'app' ELSE 'store' END AS channel,
        d AS date,
        CASE WHEN k % 3 = 0 THEN NULL ELSE CAST((k * 7 + c) % 7 AS DOUBLE) END AS rating,
        CASE WHEN k % 5 = 0 THEN NULL WHEN k % 7 = 0 THEN '  ' WHEN k % 2 = 0 THEN 'Delivery'
             WHEN k % 11 = 0 THEN 'Billing' ELSE 'Support' END AS feedback_category,
        CASE WHEN k % 50 = 0 THEN NULL WHEN k % 50 = 1 THEN '   ' WHEN k % 50 = 2 THEN 'ok'
             WHEN k % 50 = 3 THEN concat('  ', s1, chr(9), chr(10), '  ', s2, chr(7))
             WHEN k % 2 = 0 THEN s1 ELSE concat(s1, ' ', s2) END AS feedback
 FROM base)
SELECT * FROM one
UNION ALL
SELECT feedback_id + 1000000000, customer_id, product, channel, date, rating, feedback_category, feedback
FROM one WHERE feedback_id % 10 = 4
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order and a tenth of them twice, with messy texts, ratings and categories."""
    for name in ("orders", "part"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(FEEDBACK_SQL)
