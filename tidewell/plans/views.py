"""Views of the test tables as event, daily, demographic and prediction tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXCLUDED_SOURCES = (38,)
CHANNELS = (3000, 3001, 3002)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    source = F.create_map(*[F.lit(x) for kv in {"click": 3, "view": 6, "purchase": 7, "signup": 9, "error": 38}.items() for x in kv])
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    return e.select(
        "user_id", "event_id", source[F.col("event_type")].cast("long").alias("source"), (F.lit(3000) + F.col("event_id") % 3).cast("long").alias("channel"), start.alias("start_ms"),
        (start + F.regexp_extract("props", "[0-9]+", 0).cast("long") * 60_000).alias("end_ms"),
        F.when(F.col("event_id") % 97 != 0, (F.col("user_id") % 5 - 2) * 60.0).alias("tz_min"), "value",
    )


EPOCHS_SQL = """epochs AS (SELECT user_id, event_id,
  (CASE event_type WHEN 'click' THEN 3 WHEN 'view' THEN 6 WHEN 'purchase' THEN 7 WHEN 'signup' THEN 9 WHEN 'error' THEN 38 END)::BIGINT AS source,
  (3000 + event_id % 3)::BIGINT AS channel, epoch_us(ts) // 1000 AS start_ms, epoch_us(ts) // 1000 + regexp_extract(props, '[0-9]+')::BIGINT * 60000 AS end_ms,
  CASE WHEN event_id % 97 <> 0 THEN (user_id % 5 - 2) * 60.0::DOUBLE END AS tz_min, value FROM events)"""


def daily_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily values before duplicates are collapsed."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").cast("long").alias("user_id"), F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"), F.col("l_quantity").cast("double").alias("value"))


def daily_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_rows(spark, sf_dir).groupBy("user_id", "day").agg(F.avg("value").alias("value"))


DAILY_SQL = """daily_rows AS (SELECT l_suppkey::BIGINT AS user_id, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS day, l_quantity::DOUBLE AS value FROM lineitem),
daily_values AS (SELECT user_id, day, avg(value) AS value FROM daily_rows GROUP BY ALL)"""


def demographics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        k.cast("long").alias("user_id"), F.when(k % 4 == 0, 10).when(k % 4 == 1, 20).when(k % 4 == 2, 30).cast("long").alias("salutation"),
        (F.col("c_nationkey") % 5).cast("long").alias("age_group"), F.col("c_mktsegment").alias("bmi_grp"), (F.lit(1930) + k % 80).cast("long").alias("birth_year"),
        F.when(k % 11 != 0, 50.0 + k % 60).alias("weight"), F.when(k % 13 != 0, 150.0 + k % 50).alias("height"),
    )


DEMOGRAPHICS_SQL = """demographics AS (SELECT c_custkey::BIGINT AS user_id, (CASE c_custkey % 4 WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 30 END)::BIGINT AS salutation,
  (c_nationkey % 5)::BIGINT AS age_group, c_mktsegment AS bmi_grp, (1930 + c_custkey % 80)::BIGINT AS birth_year,
  CASE WHEN c_custkey % 11 <> 0 THEN 50.0::DOUBLE + c_custkey % 60 END AS weight, CASE WHEN c_custkey % 13 <> 0 THEN 150.0::DOUBLE + c_custkey % 50 END AS height FROM customer)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(arm, user_id, grp, y, score): two scores of each labelled document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    base = d.select(F.col("doc_id").alias("user_id"), F.col("source").alias("grp"), F.col("quality").cast("long").alias("y"), (F.least(F.col("n_chars"), F.lit(5000)) / 5000.0).alias("length"), ((F.col("doc_id") * 7919 % 1000) / 1000.0).alias("mixed"))
    return base.select("user_id", "grp", "y", F.expr("stack(2, 'length', length, 'mixed', mixed) as (arm, score)"))


PREDICTIONS_SQL = """predictions AS (SELECT d.doc_id AS user_id, d.source AS grp, l.quality::BIGINT AS y, a.arm, CASE a.arm WHEN 'length' THEN least(d.n_chars, 5000) / 5000.0::DOUBLE ELSE (d.doc_id * 7919 % 1000) / 1000.0::DOUBLE END AS score
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id, (VALUES ('length'), ('mixed')) a(arm))"""
