"""Reduction of events to day, source, hour and participant tables, and checks on events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators.ranks import join_nulls, quantiles

LOW, HIGH = 25.0, 230.0


def valid(channels, excluded, low: float = LOW, high: float = HIGH):
    return F.col("source").isNotNull() & ~F.col("source").isin(*excluded) & F.col("channel").isin(*channels) & F.col("value").between(low, high) & (F.col("start_ms") > 0)


def valid_events(epochs: DataFrame, channels, excluded, low: float = LOW, high: float = HIGH) -> DataFrame:
    return epochs.where(valid(channels, excluded, low, high))


def rejection_counts(epochs: DataFrame, channels, excluded, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row: rows, and rows that fail each test of the strict filter, which also wants an offset."""
    return epochs.agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("tz_min").isNull()).alias("no_offset"), F.count_if(F.col("source").isNull() | F.col("source").isin(*excluded)).alias("bad_source"),
        F.count_if(~F.col("channel").isin(*channels)).alias("bad_channel"), F.count_if(F.coalesce(~F.col("value").between(low, high), F.lit(True))).alias("bad_value"),
        F.count_if(valid(channels, excluded, low, high) & F.col("tz_min").isNotNull()).alias("kept"),
    )


def repair_end(epochs: DataFrame) -> DataFrame:
    """An end that is missing or before the start becomes the start."""
    return epochs.withColumn("end_ms", F.when(F.col("end_ms") >= F.col("start_ms"), F.col("end_ms")).otherwise(F.col("start_ms")))


def local_clock(epochs: DataFrame) -> DataFrame:
    ms = fn.local_ms()
    return epochs.withColumn("local_ms", ms).withColumn("day", fn.day_of(ms)).withColumn("hour", fn.hour_of(ms))


def day_stats(events: DataFrame, keys=("user_id", "channel", "day")) -> DataFrame:
    """Count, mean, median, sample deviation (0 for one event), least, largest and distinct hours of each day."""
    return events.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.min("value").alias("vmin"), F.max("value").alias("vmax"), distinct_hours().alias("hours"),
    )


def distinct_hours(hour: str = "hour") -> Column:
    """Number of distinct hours from 0 to 23, as bits: rows are combined before the shuffle without a distinct aggregate."""
    return F.bit_count(F.expr(f"bit_or(shiftleft(1, cast({hour} as int)))")).cast("long")


def union_coverage(events: DataFrame, keys=("user_id", "channel", "day"), start: str = "start_ms", end: str = "end_ms", unit_ms: int = 1000) -> DataFrame:
    """Length of the union of each group's intervals. An interval that starts at the running end extends it."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = events.select(*keys, start, end, (before.isNull() | (F.col(start) > before)).cast("int").alias("_new"))
    island = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = island.groupBy(*keys, "_island").agg((F.max(end) - F.min(start)).alias("_ms"))
    return spans.groupBy(*keys).agg((F.sum("_ms") / unit_ms).alias("cov_s"))


def day_table(events: DataFrame, keys=("user_id", "channel", "day")) -> DataFrame:
    """day_stats with cov_s, the length of the union of the day's intervals, after one shuffle by keys.

    In order of start each interval adds what lies behind the latest end so far.
    """
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.max("end_ms").over(w), F.col("start_ms"))
    adds = F.greatest(F.col("end_ms") - F.greatest(F.col("start_ms"), before), F.lit(0))
    own = events.withColumn("_adds", adds).groupBy(*keys)
    return own.agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
        F.min("value").alias("vmin"), F.max("value").alias("vmax"), distinct_hours().alias("hours"), (F.sum("_adds") / 1000).alias("cov_s"),
    )


def source_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "channel", "source").agg(F.count("*").alias("events"), F.countDistinct("day").alias("days"))


def hour_stats(events: DataFrame, keys=("user_id", "channel", "hour")) -> DataFrame:
    """Mergeable partials: count, sum, sum of squares."""
    return events.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("value").alias("vsum"), F.sum(F.col("value") * F.col("value")).alias("vsumsq"))


def user_meta(epochs: DataFrame, channels, excluded) -> DataFrame:
    ok = valid(channels, excluded)
    return local_clock(epochs).groupBy("user_id").agg(
        F.min(F.when(ok, F.col("day"))).alias("first_day"), F.max(F.when(ok, F.col("day"))).alias("last_day"), F.count_if(ok).alias("valid_events"),
        F.countDistinct(F.when(ok, F.col("day"))).alias("n_days"), F.count_if(F.col("tz_min").isNull()).alias("tz_missing_events"), F.count("*").alias("raw_events"),
    )


def bin_means(events: DataFrame, minutes: int, min_bins: int, min_days: int) -> DataFrame:
    """Mean of each (user, day, bin) on days of min_bins bins or more, for users of min_days such days or more."""
    bins = events.withColumn("bin", fn.bin_of(F.col("local_ms"), minutes)).groupBy("user_id", "day", "bin").agg(F.avg("value").alias("hr"))
    days = bins.groupBy("user_id", "day").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_bins)
    users = days.groupBy("user_id").agg(F.count("*").alias("_d")).where(F.col("_d") >= min_days)
    return bins.join(days, ["user_id", "day"], "left_semi").join(users, "user_id", "left_semi")


def span_audit(epochs: DataFrame, by: str = "source") -> DataFrame:
    """Quantiles of the spans' lengths of each source, exact by ordered buckets, the longest, and shares over 5 and 10 minutes; a null source is one of its own."""
    ms = F.col("end_ms") - F.col("start_ms")
    own = epochs.groupBy(by).agg(
        F.max(ms).alias("longest"), F.avg((ms > 5 * 60_000).cast("double")).alias("over_5min"), F.avg((ms > 10 * 60_000).cast("double")).alias("over_10min"), F.countDistinct("tz_min").alias("offsets"),
    )
    cuts = quantiles(epochs.select(by, ms.alias("_ms")), [by], "_ms", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return join_nulls(own, F.broadcast(cuts), [by])  # one row for each source


def window_diurnal(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Hour and bucket partials inside each user's [start_day, end_day], in one pass; level says which."""
    inside = events.join(windows, "user_id").where(F.col("day").between(F.col("start_day"), F.col("end_day"))).withColumn("bucket", fn.tod_bucket(F.col("hour")))
    sets = inside.groupingSets([[F.col("user_id"), F.col("channel"), F.col("hour")], [F.col("user_id"), F.col("channel"), F.col("bucket")]], "user_id", "channel", "hour", "bucket")
    return sets.agg(F.count("*").alias("n"), F.sum("value").alias("vsum")).select("user_id", "channel", F.when(F.col("bucket").isNull(), "hour").otherwise("bucket").alias("level"), F.coalesce(F.col("bucket"), F.col("hour").cast("string")).alias("slot"), "n", "vsum")


def perday_hours(events: DataFrame, adequate: DataFrame) -> DataFrame:
    return events.join(adequate, ["user_id", "day"], "left_semi").groupBy("user_id", "day", "hour").agg(F.count("*").alias("n"), F.sum("value").alias("vsum"))


def collapse_duplicates(rows: DataFrame, keys=("user_id", "day"), value: str = "value") -> DataFrame:
    """One row for each key with one distinct value; keys with several are dropped, null values give way to others."""
    return rows.groupBy(*keys).agg(F.countDistinct(value).alias("_n"), F.max(value).alias(value)).where("_n <= 1").drop("_n")


def duplicate_counts(rows: DataFrame, keys=("user_id", "day"), value: str = "value") -> DataFrame:
    own = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(value).alias("values"), F.countDistinct(F.coalesce(F.col(value).cast("string"), F.lit(""))).alias("forms"))
    return own.agg(F.coalesce(F.sum(F.col("n") - F.col("forms")), F.lit(0)).alias("exact_duplicates"), F.count_if(F.col("values") > 1).alias("conflicting_keys"), F.count_if(F.col("values") <= 1).alias("kept_rows"))


def daily_qc(rows: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    finite = F.col("value").isNotNull() & ~F.isnan("value")
    inside = F.col("value").between(low, high)
    return rows.agg(F.count_if(finite & inside).alias("kept"), F.count_if(finite & ~inside).alias("out_of_range"), F.count_if(~finite).alias("not_finite"))


def source_share(events: DataFrame) -> DataFrame:
    return events.groupBy("channel", "source").agg(F.countDistinct("user_id").alias("users"), F.count("*").alias("events"), F.avg((F.col("end_ms") == F.col("start_ms")).cast("double")).alias("zero_share"))


def distinct_cohort(epochs: DataFrame, ids: DataFrame, channels, excluded, low: float = LOW, high: float = HIGH) -> DataFrame:
    """How many listed users have a valid event; the list is a table, not a literal."""
    return epochs.join(ids, "user_id", "left_semi").where(valid(channels, excluded, low, high)).agg(F.countDistinct("user_id").alias("n_users"))


def raw_index(epochs: DataFrame, channel: int) -> DataFrame:
    return epochs.where(F.col("channel") == channel).groupBy("user_id", "source").agg(F.count("*").alias("n"))


def perturb_shift(events: DataFrame, shift_hours: int) -> DataFrame:
    """Turns each event's clock by some hours within its local day; the day stays."""
    turned = F.pmod(F.col("local_ms") + shift_hours * fn.HOUR_MS, F.lit(fn.DAY_MS)) + F.col("day") * fn.DAY_MS
    return events.withColumns({"local_ms": turned.cast("long"), "hour": fn.hour_of(turned)})


def perturb_events(events: DataFrame, mode: str, tag: str, fraction: float = 1.0, shift_hours: int = 6) -> DataFrame:
    """Per user, channel and local day: deals values anew by hash (shuffle), draws them with repeats (resample), keeps a fraction (thin), or turns the clock (shift)."""
    if mode == "shift":
        return perturb_shift(events, shift_hours)
    keys = ["user_id", "channel", "day"]
    digest = fn.hash_rank_key(tag, F.col("user_id"), F.col("event_id"))
    if mode == "thin":
        return events.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") < int(fraction * 16**8))
    w = Window.partitionBy(*keys)
    numbered = events.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy("start_ms", "event_id")))
    if mode == "shuffle":
        want = F.row_number().over(w.orderBy(digest, "event_id"))
    elif mode == "resample":
        want = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.col("_n") + 1).cast("int")
    else:
        raise ValueError(f"unknown mode {mode}")
    values = numbered.select(*keys, F.col("_i").alias("_want"), F.col("value").alias("_v"))
    return numbered.withColumn("_want", want).join(values, [*keys, "_want"]).withColumn("value", F.col("_v")).drop("_want", "_v", "_i", "_n")


def islands(events: DataFrame, keys=("user_id", "channel", "day")) -> DataFrame:
    """Latest end before each interval and the number of its island; touching intervals share one."""
    w = Window.partitionBy(*keys).orderBy("start_ms", "end_ms", "event_id")
    before = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = events.withColumn("running_end", before).withColumn("_new", (F.col("running_end").isNull() | (F.col("start_ms") > F.col("running_end"))).cast("long"))
    return marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
