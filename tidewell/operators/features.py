"""Features of participants: channel, source and clock summaries of day, hour and bin tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators.ranks import quantiles

BUCKETS = ("night", "morning", "afternoon", "evening")


def channel_summary(days: DataFrame, keys=("user_id", "channel")) -> DataFrame:
    """Acquisition over all days and values over adequate days, in one pass; values are null without adequate days."""
    ok, weekend = F.col("adequate"), fn.weekday(F.col("day")) >= 5
    on = lambda c, cond=None: F.when(ok if cond is None else ok & cond, F.col(c))
    out = days.groupBy(*keys).agg(
        F.count("*").alias("observed_days"), F.count_if(ok).alias("adequate_days"), F.sum("n").alias("events"), F.min("day").alias("first_date"), F.max("day").alias("last_date"),
        (F.avg("cov_s") / 3600).alias("mean_cov_h"), F.avg("hours").alias("mean_hours"), F.avg(on("mean")).alias("mean_of_daily_mean"), F.stddev_samp(on("mean")).alias("sd_of_daily_mean"),
        F.avg(on("sd")).alias("mean_of_daily_sd"), F.median(on("median")).alias("median_of_daily_median"), F.percentile(on("median"), F.lit(0.25)).alias("p25_of_daily_median"),
        F.percentile(on("median"), F.lit(0.75)).alias("p75_of_daily_median"), F.min(on("vmin")).alias("min_of_daily_min"), F.max(on("vmax")).alias("max_of_daily_max"),
        F.avg(on("mean", ~weekend)).alias("weekday_mean"), F.avg(on("mean", weekend)).alias("weekend_mean"),
    )
    c = F.col
    return out.withColumns({
        "span_days": c("last_date") - c("first_date") + 1, "events_per_day": c("events") / c("observed_days"), "iqr_of_daily_median": c("p75_of_daily_median") - c("p25_of_daily_median"),
        "range_of_daily_extremes": c("max_of_daily_max") - c("min_of_daily_min"), "weekend_minus_weekday": c("weekend_mean") - c("weekday_mean"),
    })


def overall_summary(days: DataFrame) -> DataFrame:
    out = days.groupBy("user_id").agg(F.sum("n").alias("events"), F.countDistinct("day").alias("days"), F.count_if("adequate").alias("adequate_days"), F.min("day").alias("first_date"), F.max("day").alias("last_date"))
    return out.withColumn("span_days", F.col("last_date") - F.col("first_date") + 1)


def widen_channels(summary: DataFrame, channels, stats) -> DataFrame:
    """(user, channel) rows to ch<c>_<stat> columns. Channels are a fixed list, so the schema doesn't depend on the data."""
    cols = [F.max(F.when(F.col("channel") == c, F.col(s))).alias(f"ch{c}_{s}") for c in channels for s in stats]
    return summary.groupBy("user_id").agg(*cols)


def tod_profile(hours: DataFrame, tz_ok: DataFrame, channels) -> DataFrame:
    """Event-weighted mean of each channel and part of the day; null for users whose local time isn't certain (not in tz_ok)."""
    bucket = fn.tod_bucket(F.col("hour"))
    part = lambda c, b, v: F.sum(F.when((F.col("channel") == c) & (bucket == b), F.col(v)))
    cols = {f"ch{c}_tod_{b}": F.try_divide(part(c, b, "vsum"), part(c, b, "n")) for c in channels for b in BUCKETS}
    wide = hours.groupBy("user_id").agg(*[v.alias(k) for k, v in cols.items()])
    sure = wide.join(tz_ok.select("user_id").distinct().withColumn("_ok", F.lit(True)), "user_id", "left")
    return sure.select("user_id", *[F.when(F.col("_ok"), F.col(k)).alias(k) for k in cols])


def channel_contrasts(wide: DataFrame, stat: str, main: int, others) -> DataFrame:
    return wide.select("user_id", *[(F.col(f"ch{main}_{stat}") - F.col(f"ch{o}_{stat}")).alias(f"ch{main}_minus_ch{o}") for o in others])


def recording_process(days: DataFrame, hours: DataFrame, channels) -> DataFrame:
    """How each channel records, not what: duty of its span, events a day, presence, clock shares, hours with events; duty of any channel."""
    per = days.groupBy("user_id", "channel").agg((F.count("*") / (F.max("day") - F.min("day") + 1)).alias("duty"), (F.sum("n") / F.count("*")).alias("events_day"))
    bucket = fn.tod_bucket(F.col("hour"))
    clock = hours.groupBy("user_id", "channel").agg(F.count_if(F.col("n") > 0).alias("hours_seen"), *[(F.sum(F.when(bucket == b, F.col("n")).otherwise(0)) / F.sum("n")).alias(f"share_{b}") for b in BUCKETS])
    wide = widen_channels(per.join(clock, ["user_id", "channel"]), channels, ["duty", "events_day", "hours_seen", *[f"share_{b}" for b in BUCKETS]])
    any_ = days.groupBy("user_id").agg((F.countDistinct("day") / (F.max("day") - F.min("day") + 1)).alias("any_duty"))
    return wide.join(any_, "user_id").withColumns({f"ch{c}_present": F.col(f"ch{c}_duty").isNotNull().cast("long") for c in channels})


def source_profile(events: DataFrame) -> DataFrame:
    """Values, days and clock shares of each (user, source), over all channels (channel null) and for each channel.

    Two levels: a day's partials first, then sums of those, so that a large user's events combine map-side.
    """
    bucket = fn.tod_bucket(F.col("hour"))
    grouped = lambda df, keys: [[F.col(k) for k in keys if k != "channel"], [F.col(k) for k in keys]]
    day = events.groupBy("user_id", "source", "channel", "day").agg(
        F.count("*").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        *[F.count_if(bucket == b).alias(b) for b in BUCKETS],
    )
    merge = [F.sum(x).alias(x) for x in ("n", "s", "q", *BUCKETS)] + [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    keys = ("user_id", "source", "day", "channel")
    both = day.groupingSets(grouped(day, keys), *keys).agg(F.grouping("channel").cast("long").alias("all_channels"), *merge).withColumn("m", F.col("s") / F.col("n"))
    out = both.groupBy("user_id", "source", "channel", "all_channels").agg(
        F.count("*").alias("days"), (F.max("day") - F.min("day") + 1).alias("span"), F.avg("m").alias("day_mean"), F.stddev_samp("m").alias("day_mean_sd"), F.avg("n").alias("day_count"),
        F.stddev_samp("n").alias("day_count_sd"), *merge,
    )
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)
    return out.select("user_id", "source", "channel", "all_channels", "n", (F.col("s") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("sd"), "lo", "hi", "days", "span", "day_mean", "day_mean_sd", "day_count", "day_count_sd", *[(F.col(b) / F.col("n")).alias(f"share_{b}") for b in BUCKETS])


def day_wide(days: DataFrame, main: int, others, people: DataFrame, epoch_year: int = 1970) -> DataFrame:
    """A row for each adequate day of the main channel: all channels' means beside it, gaps between them, age in that year."""
    chans = (main, *others)
    wide = days.groupBy("user_id", "day").agg(F.max(F.when(F.col("channel") == main, F.col("adequate"))).alias("_ok"), *[F.max(F.when(F.col("channel") == c, F.col(s))).alias(f"ch{c}_{s}") for c in chans for s in ("mean", "n")])
    year = F.year(F.date_add(F.lit(f"{epoch_year}-01-01").cast("date"), F.col("day").cast("int")))
    return wide.where("_ok").drop("_ok").join(people.select("user_id", "birth_year"), "user_id", "left").select("*", *[(F.col(f"ch{main}_mean") - F.col(f"ch{c}_mean")).alias(f"gap_{c}") for c in others], (year - F.col("birth_year")).cast("long").alias("age")).drop("birth_year")


def static_block(days: DataFrame, stats) -> DataFrame:
    """Mean and deviation of day statistics and the weekday less weekend contrast of each."""
    weekend = fn.weekday(F.col("day")) >= 5
    return days.groupBy("user_id").agg(*[x for s in stats for x in (F.avg(s).alias(f"{s}_mean"), F.stddev_samp(s).alias(f"{s}_sd"), (F.avg(F.when(~weekend, F.col(s))) - F.avg(F.when(weekend, F.col(s)))).alias(f"{s}_weekday"))])


def bin_profile(grid: DataFrame, n_bins: int, name: str = "bin") -> DataFrame:
    """Mean and deviation of each bin over a user's days, as columns; unobserved bins are left out."""
    return grid.groupBy("user_id").agg(*[x for b in range(n_bins) for x in (F.avg(F.when(F.col("bin") == b, F.col("hr"))).alias(f"{name}{b}_mean"), F.stddev_samp(F.when(F.col("bin") == b, F.col("hr"))).alias(f"{name}{b}_sd"))])


def recording_descriptors(grid: DataFrame) -> DataFrame:
    """Span, density, longest gap between days, and mean and deviation of the occupied share of a day."""
    day = grid.groupBy("user_id", "day").agg(F.avg(F.col("hr").isNotNull().cast("double")).alias("o"))
    gap = day.withColumn("gap", F.col("day") - F.lag("day").over(Window.partitionBy("user_id").orderBy("day")) - 1)
    out = gap.groupBy("user_id").agg((F.max("day") - F.min("day") + 1).alias("span"), F.count("*").alias("days"), F.coalesce(F.max("gap"), F.lit(0)).alias("longest_gap"), F.avg("o").alias("occupancy"), F.stddev_samp("o").alias("occupancy_sd"))
    return out.withColumn("density", F.col("days") / F.col("span"))


def tercile_groups(rows: DataFrame, train: DataFrame, columns) -> DataFrame:
    """low, middle or high of each column by the training rows' thirds, and the crossed group."""
    cuts = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), [quantiles(train, [], c, {f"_{c}0": 1 / 3, f"_{c}1": 2 / 3}) for c in columns])  # one row each
    level = lambda c: F.when(F.col(c) <= F.col(f"_{c}0"), "low").when(F.col(c) <= F.col(f"_{c}1"), "middle").when(F.col(c).isNotNull(), "high")
    out = rows.crossJoin(F.broadcast(cuts)).select("user_id", *[level(c).alias(f"{c}_group") for c in columns])  # cuts is one row
    return out.withColumn("crossed", F.concat_ws("/", *[F.coalesce(f"{c}_group", F.lit(fn.MISSING)) for c in columns]))


def subgroups(rows: DataFrame, train: DataFrame, columns: dict[str, str], crossed=()) -> DataFrame:
    """(user_id, dimension, level): the groups that each row belongs to, by the training rows' thirds.

    Everyone is in (overall, all) and, for each named column, in its low, middle or high; each pair (a, b) of `crossed` adds
    a_x_b with the level low/high and the like. Four columns and two pairs make 31 groups. A row without a value in a column
    isn't in that column's groups. Cutpoints are one row, so rows are not shuffled.
    """
    level = {name: F.col(f"{c}_group") for name, c in columns.items()}
    pair = lambda dimension, value: F.struct(F.lit(dimension).alias("dimension"), value.alias("level"))
    groups = [pair("overall", F.lit("all")), *[pair(n, g) for n, g in level.items()], *[pair(f"{a}_x_{b}", F.concat(level[a], F.lit("/"), level[b])) for a, b in crossed]]
    cut = tercile_groups(rows, train, list(columns.values()))
    return cut.select("user_id", F.explode(F.array(*groups)).alias("g")).select("user_id", "g.dimension", "g.level").where("level IS NOT NULL")


def clock_fractions(grid: DataFrame, n_bins: int, blocks: int = 4) -> DataFrame:
    """Observed share of each block of the day."""
    size = n_bins // blocks
    on = F.col("hr").isNotNull()
    return grid.groupBy("user_id", "day").agg(*[(F.count_if(on & (F.floor(F.col("bin") / size) == b)) / size).alias(f"block_{b}") for b in range(blocks)])


def physiology(grid: DataFrame, least: int, night=(0, 6), wake=(8, 20), n_bins: int = 24) -> DataFrame:
    """Of each day: night and wake mean, dip, clock hour of the lowest and highest bin, amplitude (days of `least` bins or more), step size, percentiles, deviation (of all bins, population)."""
    part = lambda r: F.avg(F.when((F.col("bin") * 24 / n_bins >= r[0]) & (F.col("bin") * 24 / n_bins < r[1]), F.col("hr")))
    seen = grid.where("hr IS NOT NULL")
    step = F.when(F.col("bin") - F.lag("bin").over(Window.partitionBy("user_id", "day").orderBy("bin")) == 1, F.abs(F.col("hr") - F.lag("hr").over(Window.partitionBy("user_id", "day").orderBy("bin"))))
    out = seen.withColumn("_s", step).groupBy("user_id", "day").agg(
        part(night).alias("night"), part(wake).alias("wake"), F.min_by("bin", F.struct("hr", "bin")).alias("_lo"), F.min_by("bin", F.struct(-F.col("hr"), F.col("bin"))).alias("_hi"),
        F.when(F.count("*") >= least, F.max("hr") - F.min("hr")).alias("amplitude"), F.avg("_s").alias("step"), *[F.percentile("hr", F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.1, 0.5, 0.9)], F.stddev_pop("hr").alias("sd"),
    )
    hour = lambda c: (F.col(c) * 24 / n_bins).cast("double")
    return out.withColumns({"dip": 1 - F.col("night") / F.nullif(F.col("wake"), F.lit(0.0)), "nadir_hour": hour("_lo"), "peak_hour": hour("_hi")}).drop("_lo", "_hi")


def wear_windows(grid: DataFrame, spans: dict[str, tuple[int, int]], worn: float = 0.8, off: float = 0.2) -> DataFrame:
    """Occupancy of named spans of bins over a user's days: mean, deviation, weekend less weekday, shares of days worn, off and between."""
    share = lambda r: F.avg(F.when(F.col("bin").between(*r), F.col("hr").isNotNull().cast("double")))
    day = grid.groupBy("user_id", "day").agg(*[share(r).alias(k) for k, r in spans.items()])
    we = fn.weekday(F.col("day")) >= 5
    cols = []
    for k in spans:
        c = F.col(k)
        cols += [F.avg(c).alias(f"{k}_mean"), F.stddev_samp(c).alias(f"{k}_sd"), (F.avg(F.when(we, c)) - F.avg(F.when(~we, c))).alias(f"{k}_weekend"), F.avg((c >= worn).cast("double")).alias(f"{k}_worn"), F.avg((c <= off).cast("double")).alias(f"{k}_off"), F.avg(((c > off) & (c < worn)).cast("double")).alias(f"{k}_partial")]
    return day.groupBy("user_id").agg(*cols)


def observation_controls(daily: DataFrame, windows: DataFrame, value: str = "value") -> DataFrame:
    """Geometry of each window's dates and its series: moments, slope, residual deviation, coverage, span, longest gap with the window's edges."""
    inside = daily.join(windows.select("user_id", "window_index", "start_day", "end_day"), "user_id").where(F.col("day").between(F.col("start_day"), F.col("end_day")))
    w = Window.partitionBy("user_id", "window_index").orderBy("day")
    gap = inside.withColumn("gap", F.col("day") - F.coalesce(F.lag("day").over(w), F.col("start_day") - 1) - 1)
    t = F.col("day").cast("double")
    out = gap.groupBy("user_id", "window_index", "start_day", "end_day").agg(
        F.count("*").alias("dates"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.regr_slope(value, t).alias("slope"), F.regr_syy(value, t).alias("_syy"), F.regr_sxy(value, t).alias("_sxy"),
        F.min("day").alias("_a"), F.max("day").alias("_b"), F.max("gap").alias("_gap"),
    )
    rest = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    length = F.col("end_day") - F.col("start_day") + 1
    return out.select("user_id", "window_index", "dates", "mean", "sd", "slope", F.when(F.col("dates") > 2, F.sqrt(rest / (F.col("dates") - 2))).alias("residual_sd"), (F.col("dates") / length).alias("coverage"), (F.col("_b") - F.col("_a") + 1).alias("span"), F.greatest("_gap", F.col("end_day") - F.col("_b")).alias("longest_gap"))


def pool_vectors(rows: DataFrame, key: str, vector: str, prefix: int = 0, order: str = "") -> DataFrame:
    """Mean and deviation of each place of a key's vectors; with a prefix, of its first rows in that order. Null vectors are left out."""
    own = rows.where(F.col(vector).isNotNull())
    if prefix:
        own = own.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_r") <= prefix)
    long = own.select(key, F.posexplode(vector).alias("pos", "v"))
    return long.groupBy(key, F.col("pos").cast("long").alias("pos")).agg(F.count("v").alias("n"), F.avg(F.col("v").cast("double")).alias("mean"), F.stddev_samp(F.col("v").cast("double")).alias("sd"))


def feature_formulas(wide: DataFrame, products=(), ratios=(), differences=()) -> DataFrame:
    """New columns a_x_b, a_per_b (null where b <= 0) and a_minus_b."""
    return wide.withColumns(
        {f"{a}_x_{b}": F.col(a) * F.col(b) for a, b in products} | {f"{a}_per_{b}": fn.safe_ratio(F.col(a), F.col(b)) for a, b in ratios} | {f"{a}_minus_{b}": F.col(a) - F.col(b) for a, b in differences}
    )


def baseline_deviation(days: DataFrame, baseline: DataFrame, stat: str = "value") -> DataFrame:
    """Each day's value less the mean of the user's baseline days; null without those."""
    base = days.join(baseline.select("user_id", "day").distinct(), ["user_id", "day"], "left_semi").groupBy("user_id").agg(F.avg(stat).alias("_b"))
    return days.join(base, "user_id", "left").withColumn("deviation", F.col(stat) - F.col("_b")).drop("_b")


def truncate_calendar(days: DataFrame, train_before: int, test_from: int, min_days: int = 2) -> DataFrame:
    """Splits users by their first day, and keeps only that split's part of the calendar; `reason` says why a user is left out."""
    first = F.min("day").over(Window.partitionBy("user_id"))
    split = F.when(F.col("_f") < train_before, "train").when(F.col("_f") >= test_from, "test")
    cut = days.select("user_id", "day", first.alias("_f")).withColumn("split", split)
    kept = F.when(F.col("split") == "train", F.col("day") < train_before).when(F.col("split") == "test", F.col("day") >= test_from).otherwise(False)
    out = cut.groupBy("user_id", "split").agg(F.count_if(kept).alias("days"), F.min(F.when(kept, F.col("day"))).alias("first_day"), F.max(F.when(kept, F.col("day"))).alias("last_day"))
    return out.withColumn("reason", F.when(F.col("split").isNull(), "between").when(F.col("days") < min_days, "few_days").otherwise("kept"))
