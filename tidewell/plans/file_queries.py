"""Registered queries of readers and writers: files that Spark writes from the test tables and reads back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.operators import splits
from tidewell.plans import views as vw
from tidewell.plans.queries import DM, E, add
from tidewell.sources import files, manifest

NATIVE = {"startTimestamp": "start_ms", "endTimestamp": "end_ms", "type": "channel", "longValue": "value", "source": "source", "timezoneOffset": "tz_min"}


OWNER = files.OWNER
#: Users' files lie in so many folders.
FOLDERS = 1024
name_of = lambda: F.concat((F.col("user_id") % FOLDERS).cast("string"), F.lit("/"), F.col("user_id").cast("string"), F.lit(".csv"))
head_of = lambda *without: F.lit(",".join(c for c in NATIVE if c not in without))


def line_of(*without: str, **other) -> Column:
    """An event as a line of CSV, without some columns, or with other values in some."""
    return F.to_csv(F.struct(*[other.get(k, F.col(v)).alias(k) for k, v in NATIVE.items() if k not in without]))


def event_lines(spark, sf_dir: str):
    """(name, head, line) of the events, a file for each user."""
    return vw.epochs(spark, sf_dir).select(name_of().alias("name"), head_of().alias("head"), line_of().alias("line"))


def empty_files(spark, sf_dir: str):
    """(name, head, line) of files of no bytes, for users whose number ends in 7 and who have no events."""
    none = vw.demographics(spark, sf_dir).where("user_id % 10 = 7").join(vw.epochs(spark, sf_dir), "user_id", "left_anti")
    return none.select(name_of().alias("name"), F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("line"))


def written(spark, rows) -> str:
    path = files.scratch(spark, "csv")
    files.sink_files(rows, path)
    return path


def event_files(spark, sf_dir: str, empty: bool = False) -> str:
    """The events as CSV files, one for each user, written by Spark's tasks; with files of no bytes, if asked."""
    rows = event_lines(spark, sf_dir)
    return written(spark, rows.unionByName(empty_files(spark, sf_dir)) if empty else rows)


def scanned(spark, sf_dir: str):
    return files.scan_epochs(spark, event_files(spark, sf_dir), OWNER).drop("_broken")


add("scan_epochs", scanned, "SELECT user_id, source, channel, start_ms, end_ms, tz_min, value FROM epochs", E)
add("scan_coerced", lambda s, d: files.scan_coerced(s, event_files(s, d)).groupBy(F.col("source").cast("long").alias("source")).agg(F.count("*").alias("n"), F.count("timezoneOffset").alias("offsets"), F.sum("longValue").alias("total")), "SELECT source, count(*) AS n, count(tz_min) AS offsets, sum(value) AS total FROM epochs GROUP BY 1", E, "total")


def statuses(spark, sf_dir: str):
    """Files of users by the rest of their number: whole ones, without a core column, with values that aren't numbers, with a header only; and files of no bytes."""
    kind = F.col("user_id") % 5
    head = F.when(kind == 1, head_of("longValue")).otherwise(head_of())
    line = F.when(kind == 1, line_of("longValue")).when(kind == 2, line_of(longValue=F.lit("broken"))).when(kind != 3, line_of())
    own = vw.epochs(spark, sf_dir).select(name_of().alias("name"), head.alias("head"), line.alias("line"))
    path = written(spark, own.unionByName(empty_files(spark, sf_dir)))
    return files.file_status(spark, path).groupBy("status").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.sum("valid").alias("valid"))


add("scan_status", statuses, f""", {vw.DEMOGRAPHICS_SQL}, t AS (SELECT user_id, user_id % 5 AS k, count(*) AS n, count(value) AS v FROM epochs GROUP BY 1)
SELECT CASE k WHEN 1 THEN 'missing_required_columns' WHEN 2 THEN 'no_valid_core_event' WHEN 3 THEN 'header_only' ELSE 'ok' END AS status, count(*) AS files, sum(CASE WHEN k <> 3 THEN n ELSE 0 END)::BIGINT AS rows, sum(CASE WHEN k IN (0, 4) THEN v ELSE 0 END)::BIGINT AS valid FROM t GROUP BY 1
UNION ALL SELECT 'unreadable', count(*), 0, 0 FROM demographics WHERE user_id % 10 = 7 AND user_id NOT IN (SELECT user_id FROM epochs) HAVING count(*) > 0""", E)
uploads = lambda s, d: vw.epochs(s, d).select("user_id", "event_id", F.concat(F.date_format(F.timestamp_millis(F.col("start_ms") + F.coalesce("tz_min", F.lit(0.0)).cast("long") * 60000), "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.col("tz_min").isNull(), "").otherwise(F.format_string("%s%02d:00", F.when(F.col("tz_min") < 0, "-").otherwise("+"), F.abs(F.col("tz_min") / 60).cast("int")))).alias("timestamp"), F.col("value").cast("string").alias("hr"))
add("normalize_upload", lambda s, d: files.normalize_upload(uploads(s, d)).select("user_id", "start_ms", "end_ms", "tz_min", "value", "reason"), "SELECT user_id, start_ms // 1000 * 1000 AS start_ms, start_ms // 1000 * 1000 AS end_ms, tz_min, value, CASE WHEN tz_min IS NULL THEN 'offset' END AS reason FROM epochs", E)
add("scan_reduced", lambda s, d: vw.table(s, d, "events").select("event_id", "user_id", "value").where("value > 50"), "SELECT event_id, user_id, value FROM events WHERE value > 50")


def chunked(spark, sf_dir: str):
    path = files.scratch(spark, "daily")
    vw.daily_rows(spark, sf_dir).write.option("header", True).csv(path)
    return spark.read.schema("user_id long, day long, value double").option("header", True).csv(path).groupBy("user_id").agg(F.count("*").alias("n"), F.count_distinct("day").alias("days"))


add("scan_chunked", chunked, "SELECT l_suppkey::BIGINT AS user_id, count(*) AS n, count(DISTINCT l_shipdate::DATE) AS days FROM lineitem GROUP BY 1")


def code_map(spark, sf_dir: str):
    path = files.scratch(spark, "codes")
    vw.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("CODE"), F.col("n_name").alias("LABEL")).write.option("sep", ";").option("header", True).csv(path)
    return files.scan_code_map(spark, path).select(F.col("code").cast("long").alias("code"), "label")


add("scan_code_map", code_map, "SELECT n_nationkey::BIGINT AS code, n_name AS label FROM nation")


def round_trip(by=()):
    def run(spark, sf_dir: str):
        path = files.scratch(spark, "sink")
        files.sink_parquet(vw.epochs(spark, sf_dir).withColumn("source_id", F.col("source")), path, by=by)
        return spark.read.parquet(path).groupBy(F.col("source_id").cast("long").alias("source_id")).agg(F.count("*").alias("n"), F.max("start_ms").alias("last"))

    return run


SINK = "SELECT source AS source_id, count(*) AS n, max(start_ms) AS last FROM epochs GROUP BY 1"
add("sink_parquet", round_trip(), SINK, E)
add("sink_partitioned", round_trip(("source_id",)), SINK, E)


add("resume_done", lambda s, d: files.unfinished(vw.demographics(s, d).select("user_id"), vw.epochs(s, d).select("user_id").distinct(), ["user_id"]), f", {vw.DEMOGRAPHICS_SQL} SELECT user_id FROM demographics WHERE user_id NOT IN (SELECT user_id FROM epochs)", E)


def resumed(spark, sf_dir: str):
    """Days of users by team, written in two runs: the first breaks after half of its teams, before the manifest; the second does what is left."""
    path = files.scratch(spark, "teams")
    teams = vw.daily_values(spark, sf_dir).withColumn("team", F.col("user_id") % 8)
    manifest.write_partitions(teams.where("team < 2"), path, ["team"])
    manifest.write_partitions(teams.where("team < 5 AND day < 9500"), path, ["team"], finish=False)
    done = manifest.write_partitions(teams, path, ["team"])
    return spark.read.schema(teams.schema).parquet(path).groupBy("team").agg(F.count("*").alias("n"), F.sum("value").alias("total")).join(done, "team")


add("resume_partitions", resumed, "SELECT team, n, total, n AS rows FROM (SELECT user_id % 8 AS team, count(*) AS n, sum(value) AS total FROM daily_values GROUP BY 1)", f"WITH {vw.DAILY_SQL}\n", "total")
