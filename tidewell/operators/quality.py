"""Data checks as tables: what was expected, what was found, how far apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def anchor_counts(actual: DataFrame, expected: DataFrame, key: str = "name") -> DataFrame:
    """Names whose count differs from the frozen one, or that only one side has."""
    j = actual.select(key, F.col("n").alias("actual")).join(expected.select(key, F.col("n").alias("expected")), key, "full")
    return j.where(~F.col("actual").eqNullSafe(F.col("expected")))


def feature_checks(days: DataFrame) -> DataFrame:
    """Violations of what a day table promises, a row for each check, from one pass."""
    checks = {"hours_in_range": ~F.col("hours").between(1, 24), "mean_between_extremes": ~F.col("mean").between(F.col("vmin") - 1e-9, F.col("vmax") + 1e-9), "sd_not_negative": F.col("sd") < 0, "events_cover_hours": F.col("n") < F.col("hours"), "coverage_not_negative": F.col("cov_s") < 0}
    one = days.agg(*[F.count_if(c).alias(k) for k, c in checks.items()], (F.count("*") - F.count_distinct(F.struct("user_id", "channel", "day"))).alias("keys_unique"))
    names = [*checks, "keys_unique"]
    return one.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{k}', {k}" for k in names) + ") as (item, violations)")).withColumn("passed", F.col("violations") == 0)


def pair_checks(pairs: DataFrame, gap: int = 180) -> DataFrame:
    """Users whose windows overlap, are in the wrong order or lack a mate."""
    own = pairs.groupBy("user_id").agg(F.max(F.when(F.col("window_index") == 1, F.col("start_day"))).alias("a"), F.max(F.when(F.col("window_index") == 2, F.col("start_day"))).alias("b"))
    return own.select("user_id", (F.col("b") - F.col("a") < gap).alias("overlap"), F.col("a").isNull().alias("no_first"), F.col("b").isNull().alias("no_second"))


def reconcile(saved: DataFrame, recomputed: DataFrame, keys, columns) -> DataFrame:
    """Largest difference of each column between saved and recomputed summaries, and keys that only one side has."""
    a = saved.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(1).alias("_in_a"))
    b = recomputed.select(*keys, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(1).alias("_in_b"))
    j = a.join(b, list(keys), "full")
    one = j.agg(F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("unmatched"), *[F.max(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}"))).cast("double").alias(c) for c in columns])
    return one.select("unmatched", F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', {c}" for c in columns) + ") as (item, largest)"))
