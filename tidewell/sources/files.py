"""Readers and writers of event files: CSVs of participants, uploads with offsets, inventories, Parquet."""

from __future__ import annotations

import re
from itertools import groupby, islice
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.listing import listing, open_store

EPOCH_SCHEMA = "startTimestamp long, endTimestamp long, type long, longValue double, source long, timezoneOffset double, _broken string"
EVENT_COLUMNS = ("startTimestamp", "endTimestamp", "type", "longValue", "source", "timezoneOffset")
CORE = ("startTimestamp", "type", "longValue")


#: Where a path names its participant: the digits before .csv.
OWNER = r"/([0-9]+)[.]csv"


def user_of_file(owner: str = OWNER) -> Column:
    return F.regexp_extract(F.col("_metadata.file_path"), owner, 1).try_cast("long")


def scan_epochs(spark: SparkSession, path: str, owner: str = OWNER) -> DataFrame:
    """Events of CSV files named <user>.csv with the six native columns in order; rows that don't parse carry their text in _broken."""
    raw = spark.read.schema(EPOCH_SCHEMA).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").option("recursiveFileLookup", True).csv(path)
    return raw.select(
        user_of_file(owner).alias("user_id"), "source", F.col("type").alias("channel"), F.col("startTimestamp").alias("start_ms"), F.col("endTimestamp").alias("end_ms"),
        F.col("timezoneOffset").alias("tz_min"), F.nanvl("longValue", F.lit(None)).alias("value"), "_broken",
    )


def cells_of(line: str, width: int = 32) -> Column:
    """The first `width` cells of a CSV line as an array; quoted cells may hold commas.

    Only lines with a quote go through Spark's CSV parser, which reads such a line once for each cell.
    """
    row = F.from_csv(F.col(line), F.lit(", ".join(f"c{i} string" for i in range(width))))
    return F.when(F.contains(F.col(line), F.lit('"')), F.array(*[row[f"c{i}"] for i in range(width)])).otherwise(F.slice(F.split(F.col(line), ","), 1, width))


def places_of(header: str, columns, width: int = 32) -> Column:
    """Where the columns are among a header line's first `width` cells: places from 1, or 0."""
    return F.transform(F.array(*map(F.lit, columns)), lambda c: F.coalesce(F.array_position(F.col(header), c), F.lit(0)).cast("int"))


def coerced(cells: str, places: str, columns) -> list[Column]:
    """The cells at each column's place as doubles, null where there is none."""
    return [F.when(F.col(places)[i] > 0, F.get(cells, F.col(places)[i] - 1)).try_cast("double").alias(c) for i, c in enumerate(columns)]


def placed(heads: DataFrame, columns, width: int) -> DataFrame:
    """Adds the places of the columns to files' headers in _head, once for each file."""
    return heads.withColumn("_h", cells_of("_head", width)).withColumn("_at", places_of("_h", columns, width)).drop("_h")


def scan_coerced(spark: SparkSession, path: str, columns=EVENT_COLUMNS, width: int = 32) -> DataFrame:
    """Events of CSV files whatever their columns: each file's header says where the named ones are, values are coerced or null.

    A file is a few lines of text to Spark: lines are joined to their file's header, so files may differ in columns. Cells may be
    quoted and then hold commas; of a file's columns the first `width` are looked at.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_s"), user_of_file().alias("user_id"), "value")
    heads = lines.where(F.col("value").rlike("(^|,)\"?(" + "|".join(columns) + ")\"?(,|$)")).groupBy("file").agg(F.min("value").alias("_head"))
    cells = lines.join(placed(heads, columns, width), "file", "left").where("_head IS NULL OR value <> _head").withColumn("_c", cells_of("value", width))
    return cells.select("file", "user_id", *coerced("_c", "_at", columns))


def outcome(core=CORE) -> Column:
    """A file's status by its header (null where it can't be read), its rows (null without) and its valid ones."""
    missing = F.size(F.array_except(F.array(*map(F.lit, core)), cells_of("header"))) > 0
    return F.when(F.col("header").isNull(), "unreadable").when(missing, "missing_required_columns").when(F.col("rows").isNull(), "header_only").when(F.col("valid") == 0, "no_valid_core_event").otherwise("ok")


def rows_of_files(rows: DataFrame, core=CORE) -> DataFrame:
    full = F.lit(True)
    for c in core:
        full = full & F.col(c).isNotNull()
    return rows.groupBy("file").agg(F.count("*").alias("rows"), F.count_if(full).alias("valid"))


def scan_status(inventory: DataFrame, rows: DataFrame, heads: DataFrame, core=CORE) -> DataFrame:
    """Status of each file: unreadable, missing_required_columns, header_only, no_valid_core_event or ok."""
    j = inventory.join(heads, "file", "left").join(rows_of_files(rows, core), "file", "left")
    return j.select("file", outcome(core).alias("status"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("valid", F.lit(0)).alias("valid"))


def headers(spark: SparkSession, path: str) -> DataFrame:
    """First line of each CSV file: the one at the file's start. Only the columns of each file's first block are kept."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_i"), "value")
    return lines.where("_s = 0").groupBy("file").agg(F.min_by("value", "_i").alias("header"))


def file_inventory(spark: SparkSession, path: str, users: DataFrame, owner: str = OWNER) -> DataFrame:
    """Each listed user's file: missing, zero_byte or nonempty, and its bytes. Names and sizes are listed in tasks; contents aren't read."""
    files = listing(spark, path).select(F.regexp_extract(F.concat(F.lit("/"), "name"), owner, 1).try_cast("long").alias("user_id"), "bytes")
    own = files.groupBy("user_id").agg(F.sum("bytes").alias("bytes"))
    state = F.when(F.col("bytes").isNull(), "missing").when(F.col("bytes") == 0, "zero_byte").otherwise("nonempty")
    return users.select("user_id").distinct().join(own, "user_id", "left").select("user_id", state.alias("state"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def name_below(path: str) -> Column:
    """The name of a row's file relative to a root, as `listing` has it, from the path that Spark reports (percent-encoded, with scheme)."""
    root = re.sub("^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "", path).rstrip("/") + "/"
    full = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return F.substring(full, F.locate(root, full) + len(root), 1 << 20)


def coerced_rows(spark: SparkSession, path: str, found: DataFrame, columns=EVENT_COLUMNS, width: int = 32) -> DataFrame:
    """(name, columns...) of the CSV files that a listing found with their headers; a header's own line isn't a row, nor is a blank one."""
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(name_below(path).alias("name"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    heads = placed(found.where("header IS NOT NULL").select("name", F.col("header").alias("_head")), columns, width)
    cells = lines.where(F.trim("value") != "").join(heads, "name").where("value <> _head").withColumn("_c", cells_of("value", width))
    return cells.select("name", *coerced("_c", "_at", columns))


def file_status(spark: SparkSession, path: str, core=CORE, width: int = 32) -> DataFrame:
    """(file, bytes, status, problem, rows, valid) of every file below a folder, those of no bytes and unreadable ones too.

    Headers come from the listing, in tasks; rows are counted by Spark's scan, so a large file is read by many tasks. A file
    is unreadable where the listing names a problem.
    """
    found = listing(spark, path, headers=True)
    rows = coerced_rows(spark, path, found, core, width).withColumnRenamed("name", "file")
    known = found.withColumnRenamed("name", "file").join(rows_of_files(rows, core), "file", "left")
    return known.select("file", "bytes", outcome(core).alias("status"), "problem", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("valid", F.lit(0)).alias("valid"))


def normalize_upload(rows: DataFrame, channel: int = 3000, source: int = 0, years=(2000, 2100)) -> DataFrame:
    """Rows of (user_id, timestamp, hr, end_timestamp or none) as native events, with the reason of those rejected.

    A timestamp needs an explicit offset (Z or +hh:mm): it gives both the instant and the local clock. An end that is
    missing, or not readable, is the start. reason is null for good rows.
    """
    end = F.col("end_timestamp") if "end_timestamp" in rows.columns else F.lit(None).cast("string")
    tail = F.regexp_extract("timestamp", "(Z|[+-][0-9]{2}:?[0-9]{2})$", 1)
    digits = F.regexp_replace(tail, "[^0-9]", "")
    minutes = F.when(tail == "Z", 0.0).when(tail != "", (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")) * F.when(tail.startswith("-"), -1).otherwise(1)).cast("double")
    ms = lambda c: F.floor(F.unix_micros(F.try_to_timestamp(c)) / 1000).cast("long")
    out = rows.select("user_id", F.lit(source).cast("long").alias("source"), F.lit(channel).cast("long").alias("channel"), ms(F.col("timestamp")).alias("start_ms"), F.coalesce(ms(end), ms(F.col("timestamp"))).alias("end_ms"), minutes.alias("tz_min"), F.col("hr").try_cast("double").alias("value"))
    year = F.year(F.timestamp_millis(F.col("start_ms") + (F.col("tz_min") * 60_000).cast("long")))
    why = F.when(F.col("start_ms").isNull(), "timestamp").when(F.col("tz_min").isNull(), "offset").when(~year.between(*years), "year").when(F.col("value").isNull(), "hr")
    return out.withColumn("reason", why)


def scan_code_map(spark: SparkSession, path: str) -> DataFrame:
    """A code list: semicolons, header in any case, with or without a byte order mark."""
    raw = spark.read.option("sep", ";").option("header", True).csv(path)
    return raw.toDF(*[c.replace("\ufeff", "").strip().lower() for c in raw.columns])


def sink_parquet(df: DataFrame, path: str, mode: str = "append", by=()) -> None:
    """Zstandard Parquet, in folders by the given columns."""
    w = df.write.mode(mode).option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(path)


def sink_files(rows: DataFrame, path: str) -> None:
    """Text files below a path from rows (name, head, line): a name's file holds its head, then its lines in any order; nulls are left out, so a file may have no bytes.

    A task writes its names' files one after another, in place: a task that runs again writes the same ones, and the driver neither
    renames nor lists anything. Names are dealt by number, as the work is in opening files, not in bytes.
    """

    def write(batches):
        store, root = open_store(path)
        flat = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in ("name", "head", "line")), strict=True))
        made, count = set(), 0
        for name, own in groupby(flat, itemgetter(0)):
            at = f"{root}/{name}"
            if (folder := at.rpartition("/")[0]) not in made:
                store.create_dir(folder)
                made.add(folder)
            with store.open_output_stream(at) as f:
                head = True
                while some := list(islice(own, 4096)):
                    lines = [some[0][1]] * head + [line for _, _, line in some]
                    f.write("".join(f"{line}\n" for line in lines if line is not None).encode())
                    head = False
            count += 1
        yield pa.RecordBatch.from_pydict({"files": pa.array([count], pa.int64())})

    dealt = rows.select("name", "head", "line").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "name")
    dealt.sortWithinPartitions("name").mapInArrow(write, "files long").agg(F.sum("files")).collect()  # one row


def sink_folds(assigned: DataFrame, path: str, variables=()) -> None:
    """folds (a folder for each fold), assignments (user_id, fold) and balance (variable, level, fold, n, share) below a path; one that exists is refused."""
    sink_parquet(assigned, f"{path}/folds", "errorifexists", ("fold",))
    sink_parquet(assigned.select("user_id", "fold"), f"{path}/assignments", "errorifexists")
    if variables:
        cells = F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.coalesce(F.col(v).cast("string"), F.lit("<MISSING>")).alias("level")) for v in variables]))
        n = assigned.select("fold", cells.alias("x")).groupBy("x.variable", "x.level", "fold").agg(F.count("*").alias("n"))
        total = assigned.groupBy("fold").agg(F.count("*").alias("_t"))
        sink_parquet(n.join(F.broadcast(total), "fold").select("variable", "level", "fold", "n", (F.col("n") / F.col("_t")).alias("share")), f"{path}/balance", "errorifexists")  # one row for each fold


def unfinished(wanted: DataFrame, done: DataFrame, keys) -> DataFrame:
    """Keys not yet in the result: what a rerun has left to do."""
    return wanted.join(done.select(*keys), list(keys), "left_anti")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir). Where that is unset a local session uses its warehouse; a cluster raises."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/tidewell/{name}-{uuid.uuid4().hex}"
