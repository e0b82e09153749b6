"""Helpers shared by the text operators: Arrow batches, shared scratch tables, bounded samples."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python hold about so many bytes, so that long texts don't pile up in a worker.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds of Arrow batches where they are higher; they hold when a plan runs, so they stay lowered."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def map_rows(df: DataFrame, make: Callable, schema: str) -> DataFrame:
    """Runs a function over Arrow batches of df.

    make() is called once in each task and returns a function from the columns of a batch, as
    Python lists, to the columns of the output, as lists or Arrow arrays.
    """
    spark = df.sparkSession
    bound_batches(spark)
    target = spark.createDataFrame([], schema).schema
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, step = to_arrow_schema(target), make()
        for batch in batches:
            if batch.num_rows:
                cols = step(*(c.to_pylist() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=arrow.field(n).type) for n, c in zip(names, cols, strict=True)], schema=arrow)

    return df.mapInArrow(run, schema)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in spark.checkpoint.dir. Where that is unset a local session gets a temporary one; a cluster raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: later jobs start from files that outlive executors.

    Results are lazy and may be read at any time, so the files stay; the application's folder may go when it has ended.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_sample(df: DataFrame, key: str, bound: int, also: tuple[str, ...] = ()) -> DataFrame:
    """About `bound` rows of df, chosen by a hash of key and the columns `also`; all of them where df is smaller. Rows of a null key don't take part.

    Rows alike in those columns are chosen together: where that leaves none, the share is widened until some are; where it
    gives over four times the bound, each such row counts once, so many copies of few rows stay within the bound.
    """
    df = df.where(F.col(key).isNotNull())
    n = df.count()
    if n <= bound:
        return df
    share, own = bound / n, F.xxhash64(F.lit("sample"), key, *also)
    while True:
        chosen = df.where(F.pmod(own, F.lit(1 << 30)) < int(share * (1 << 30)))
        found = chosen.count()
        if found or share >= 1:
            return chosen if found <= 4 * bound else chosen.dropDuplicates([key, *also])
        share = min(1.0, share * 8)


def crc_mod(col: str, n: int):
    """crc32 of the id as text, modulo n; the fold that decides what is held out. A null id counts as remainder null."""
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(n))
