"""Results by partition that a broken run leaves in order: dynamic overwrite, and a manifest that is written last."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.ranks import join_nulls


def finished(spark: SparkSession, path: str, keys, like: DataFrame) -> DataFrame:
    """(keys, rows) of the partitions that the manifest of path names; none where there is no manifest yet."""
    schema = like.select(*keys).schema.add("rows", "long")
    try:
        return spark.read.schema(schema).parquet(f"{path}.done")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_partitions(df: DataFrame, path: str, keys, finish: bool = True) -> DataFrame:
    """Writes the partitions of df, a folder for each value of keys, that the manifest doesn't name yet; returns what it then names.

    Partitions are overwritten one by one, so what a broken run left of them is replaced while finished ones
    keep their files. Only when all are written are they, with their row counts as read back, added to the manifest, the folder path.done beside
    path. df's rows of finished partitions are not written again: what makes them may filter by `finished` itself. Without `finish` the
    manifest isn't written, as if the run broke there.
    """
    spark, keys = df.sparkSession, list(keys)
    done = finished(spark, path, keys, df)
    marked = without(df, done, keys)
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*keys).parquet(path)
    if finish:
        wanted = df.select(*keys).distinct()
        counts = spark.read.schema(df.schema).parquet(path).groupBy(*keys).agg(F.count("*").alias("rows"))
        new = without(join_nulls(counts, wanted.withColumn("_w", F.lit(1)), keys).drop("_w"), done, keys)
        new.select(*keys, "rows").write.mode("append").parquet(f"{path}.done")
    return finished(spark, path, keys, df)


def without(df: DataFrame, done: DataFrame, keys) -> DataFrame:
    """df without the rows whose keys done names; null equals null."""
    d = done.select(*[F.col(k).alias(f"_done_{k}") for k in keys]).distinct()
    on = [df[k].eqNullSafe(d[f"_done_{k}"]) for k in keys]
    return df.join(d, reduce(and_, on), "left_anti")
