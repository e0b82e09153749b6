"""Wide blocks of features of a participant's days: statistics by aggregates, shares of the clock's bins as one vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators import harmonics

#: The statistics of a day, in the block's order.
DAY_STATS = ("mean", "median", "sd", "vmin", "vmax", "n", "cov_h", "hours")
BINS = 288


def bin_shares(events: DataFrame, days: DataFrame, bins: int = BINS) -> DataFrame:
    """(user_id, shares): of each of a user's days (user_id, day), how many have an event in each bin of the clock, as one vector of shares.

    events has user_id, day and local_ms. Bins of a user are counted in a row for each, at most `bins`, and the vector is
    put together from those, so neither plan nor shuffle has an expression or column for each bin.
    """
    seen = events.select("user_id", "day", fn.bin_of(F.col("local_ms"), 1440 // bins).cast("int").alias("bin")).distinct().join(days.select("user_id", "day").distinct(), ["user_id", "day"], "left_semi")
    counts = seen.groupBy("user_id", "bin").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"))
    total = days.groupBy("user_id").agg(F.countDistinct("day").alias("days"))
    share = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.col("by_bin")[b], F.lit(0)) / F.col("days"))
    return total.join(counts, "user_id", "left").select("user_id", F.when(F.col("by_bin").isNull(), F.array_repeat(F.lit(0.0), bins)).otherwise(share).alias("shares"))


def day_block(days: DataFrame, events: DataFrame, bins: int = BINS) -> DataFrame:
    """The static block: mean and deviation of the eight day statistics, the weekend less weekday contrast of the mean, and the observed share of each bin.

    With 288 bins these are 305 columns beside user_id: <stat>_mean and <stat>_sd, weekend_contrast, bin_0 to bin_287. days has a row for each
    day with DAY_STATS but cov_h, which is cov_s in hours. A contrast is null without days of both kinds, a deviation of one day too.
    """
    own = days.withColumn("cov_h", F.col("cov_s") / 3600)
    weekend = fn.weekday(F.col("day")) >= 5
    stats = [F.avg(F.col(s).cast("double")).alias(f"{s}_mean") for s in DAY_STATS] + [F.stddev_samp(F.col(s).cast("double")).alias(f"{s}_sd") for s in DAY_STATS]
    contrast = F.avg(F.when(weekend, F.col("mean"))) - F.avg(F.when(~weekend, F.col("mean")))
    wide = own.groupBy("user_id").agg(*stats, contrast.alias("weekend_contrast")).join(bin_shares(events, days, bins), "user_id")
    return wide.select(*[c for c in wide.columns if c != "shares"], *[F.col("shares")[b].alias(f"bin_{b}") for b in range(bins)])


#: What is fitted to and read off the hourly curve of a day, in the profile's order; the means of its 24 hours follow.
FITTED = ("level", "amplitude_1", "amplitude_2", "amplitude_3", "peak_hour", "residual_sd")
CURVE = ("night_mean", "morning_slope", "day_night", "range", "entropy")
HOURS = tuple(f"hour_{h}" for h in range(24))


def day_curves(hours: DataFrame, fits: bool = True) -> DataFrame:
    """Of each (user_id, day): FITTED, CURVE and the means of the 24 hours, 35 columns; without fits those of CURVE and HOURS, 29.

    hours has n and vsum of each (user_id, day, hour). They are dealt by user once, at most 24 rows of a day, so neither
    the day's aggregates nor a profile over days shuffles again. An hour without events is null.
    """
    own = hours.repartition("user_id")
    keys = ("user_id", "day")
    curves = harmonics.circadian_24h(own, keys) if fits else harmonics.curve_features(own, keys)
    total = lambda h, c: F.sum(F.when(F.col("hour") == h, F.col(c)))
    means = own.groupBy(*keys).agg(*[F.try_divide(total(h, "vsum"), total(h, "n")).alias(HOURS[h]) for h in range(24)])
    return curves.join(means, list(keys)).select(*keys, *(FITTED if fits else ()), *CURVE, *HOURS)


def date_profile(curves: DataFrame) -> DataFrame:
    """Mean and deviation over a user's days of each column of day_curves, and of CURVE the means of weekdays, of weekends and their difference.

    With the fits these are 85 columns beside user_id. Days on which a feature is null don't count for it; a deviation of one
    day is null, as are the contrasts without days of both kinds.
    """
    names = [c for c in curves.columns if c not in ("user_id", "day")]
    weekend = fn.weekday(F.col("day")) >= 5
    kinds = {"wd": ~weekend, "we": weekend}
    parts = [F.avg(F.when(on, F.col(c))).alias(f"{c}_{k}") for k, on in kinds.items() for c in CURVE]
    wide = curves.groupBy("user_id").agg(*[F.avg(c).alias(f"{c}_mean") for c in names], *[F.stddev_samp(c).alias(f"{c}_sd") for c in names], *parts)
    return wide.withColumns({f"{c}_wd_diff": F.col(f"{c}_wd") - F.col(f"{c}_we") for c in CURVE})
