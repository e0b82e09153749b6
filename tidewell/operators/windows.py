"""Calendar windows: rolling means, week gates, 180-day windows, quotas, date draws, prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators.ranks import join_nulls, running_totals


def rolling_calendar(days: DataFrame, width: int, min_count: int, keys=("user_id",), day: str = "day", value: str = "value", adequate: str = "adequate") -> DataFrame:
    """Mean over the last `width` calendar days, today included, on adequate days with min_count values or more among them."""
    held = F.when(F.col(adequate), F.col(value))
    w = Window.partitionBy(*keys).orderBy(day).rangeBetween(-(width - 1), 0)
    out = days.withColumn("rolling", F.avg(held).over(w)).withColumn("support", F.count(held).over(w))
    return out.where(F.col(adequate) & (F.col("support") >= min_count)).select(*keys, day, "rolling", "support")


def endpoint_slope(rolled: DataFrame, keys=("user_id",), day: str = "day", value: str = "rolling") -> DataFrame:
    """Count, mean, deviation and slope on the calendar day; the last two are null for fewer than two endpoints."""
    return rolled.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.when(F.count(value) >= 2, F.regr_slope(value, F.col(day).cast("double"))).alias("slope"))


def strict_weeks_gate(days: DataFrame, days_per_week: int = 5, weeks: int = 13, min_weeks: int = 11, min_days: int = 65, keys=("user_id",)) -> DataFrame:
    """Best run of `weeks` Monday weeks: adequate weeks, strict days, its start, and why it fails.

    Weeks without a strict day count as empty, so frames go by calendar, not by rows.
    """
    week = days.where("strict").groupBy(*keys, fn.week_start(F.col("day")).alias("week")).agg(F.count("*").alias("d"))
    first = week.groupBy(*keys).agg(F.min("week").alias("a"), F.max("week").alias("b"))
    grid = first.select(*keys, F.explode(F.sequence("a", "b", F.lit(7).cast("long"))).alias("week"))
    dense = grid.join(week, [*keys, "week"], "left").withColumn("d", F.coalesce("d", F.lit(0)))
    w = Window.partitionBy(*keys).orderBy("week").rowsBetween(0, weeks - 1)
    runs = dense.withColumn("weeks_ok", F.sum((F.col("d") >= days_per_week).cast("long")).over(w)).withColumn("strict_days", F.sum("d").over(w))
    best = F.max(F.struct("weeks_ok", "strict_days", (-F.col("week")).alias("s"))).alias("b")
    out = runs.groupBy(*keys).agg(best).select(*keys, F.col("b.weeks_ok").alias("weeks_ok"), F.col("b.strict_days").alias("strict_days"), (-F.col("b.s")).alias("start"))
    why = F.when(F.col("weeks_ok") < min_weeks, "weeks").when(F.col("strict_days") < min_days, "days").otherwise("ok")
    return out.withColumn("reason", why)


def longest_inadequate_run(days: DataFrame, first: int, last: int) -> DataFrame:
    """Longest run of calendar days in [first, last] without an adequate day, edges included."""
    w = Window.partitionBy("user_id").orderBy("day")
    own = days.where(F.col("adequate") & F.col("day").between(first, last)).select("user_id", "day").distinct()
    gaps = own.withColumn("gap", F.col("day") - F.coalesce(F.lag("day").over(w), F.lit(first - 1)) - 1)
    return gaps.groupBy("user_id").agg(F.greatest(F.max("gap"), F.lit(last) - F.max("day")).alias("longest_gap"))


def window_180(dates: DataFrame, min_block: int, min_total: int, block_days: int = 30, blocks: int = 6) -> DataFrame:
    """First start whose blocks all hold min_block dates and min_total in all, then the first such start behind that window.

    A block's dates are the difference of two running counts, which a task goes through once for each, whatever a block holds; rows without user or day start no window.
    """
    own = Window.partitionBy("user_id")
    before = lambda b: F.count("*").over(own.orderBy("day").rangeBetween(Window.unboundedPreceding, block_days * b - 1))
    counted = dates.select("user_id", "day").dropna().distinct().select("user_id", F.col("day").alias("start_day"), *[before(b).alias(f"_{b}") for b in range(blocks + 1)])
    least = F.array_min(F.array(*[F.col(f"_{b + 1}") - F.col(f"_{b}") for b in range(blocks)]))
    fits = counted.where(least >= min_block).select("user_id", "start_day", (F.col(f"_{blocks}") - F.col("_0")).alias("num_dates")).where(F.col("num_dates") >= min_total)
    start = F.struct("start_day", "num_dates")
    behind = F.col("start_day") >= F.min("start_day").over(own) + block_days * blocks
    found = fits.withColumn("_behind", behind).groupBy("user_id").agg(F.array(F.min(start), F.min(F.when(F.col("_behind"), start))).alias("_w"))
    both = found.select("user_id", F.posexplode("_w").alias("_i", "x")).where("x IS NOT NULL").select("user_id", (F.col("_i") + 1).cast("long").alias("window_index"), "x.*")
    return both.withColumn("end_day", F.col("start_day") + block_days * blocks - 1)


def block_capacities(dates: DataFrame, windows: DataFrame, block_days: int = 30) -> DataFrame:
    inside = dates.join(windows.where("window_index = 1"), "user_id").where(F.col("day").between(F.col("start_day"), F.col("end_day")))
    return inside.groupBy("user_id", F.floor((F.col("day") - F.col("start_day")) / block_days).cast("long").alias("block")).agg(F.countDistinct("day").alias("capacity"))


def block_quotas(capacities: DataFrame, target: int, base: int) -> DataFrame:
    """base of each block, then one more of the smallest quota, ties to the lower block, until target, within capacity.

    Raising the smallest first takes the units in order of their level, then block: so units are ranked and cut.
    """
    n = F.count("*").over(Window.partitionBy("user_id"))
    units = capacities.withColumn("_n", n).select("user_id", "block", "capacity", "_n", F.explode_outer(F.when(F.col("capacity") > base, F.sequence(F.lit(base + 1).cast("long"), F.col("capacity")))).alias("unit"))
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("unit").asc_nulls_last(), "block"))
    taken = units.withColumn("_r", rank).groupBy("user_id", "block", "capacity").agg(F.count_if(F.col("unit").isNotNull() & (F.col("_r") <= target - base * F.col("_n"))).alias("more"))
    return taken.select("user_id", "block", "capacity", (F.least(F.lit(base), F.col("capacity")) + F.col("more")).alias("quota"))


def sample_dates(dates: DataFrame, windows: DataFrame, quotas: DataFrame, tag: str, block_days: int = 30) -> DataFrame:
    """The quota of each block, drawn by a hash of tag, user and date: fixed, uniform, independent of row order."""
    one = windows.where("window_index = 1")
    inside = dates.join(one, "user_id").where(F.col("day").between(F.col("start_day"), F.col("end_day"))).select("user_id", "day", F.floor((F.col("day") - F.col("start_day")) / block_days).cast("long").alias("block")).distinct()
    rank = F.row_number().over(Window.partitionBy("user_id", "block").orderBy(fn.hash_rank_key(tag, F.col("user_id"), F.col("day"))))
    return inside.withColumn("_r", rank).join(quotas, ["user_id", "block"]).where(F.col("_r") <= F.col("quota")).select("user_id", "block", "day")


def dates_hash(selected: DataFrame) -> DataFrame:
    return selected.groupBy("user_id").agg(F.count("*").alias("n_selected"), F.sha2(F.array_join(F.array_sort(F.collect_list("day")).cast("array<string>"), ","), 256).alias("selected_dates_hash"))


def first_k(days: DataFrame, k: int) -> DataFrame:
    return days.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("day")).cast("long")).where(F.col("rank") <= k)


def random_k(days: DataFrame, k: int, tag: str) -> DataFrame:
    """k days by hash; smaller k are prefixes of the same order."""
    order = fn.hash_rank_key(tag, F.col("user_id"), F.col("day"))
    return days.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(order)).cast("long")).where(F.col("rank") <= k)


def prefix_timeline(days: DataFrame, value: str = "value") -> DataFrame:
    """Count, mean and deviation of all days so far; later rows never change earlier ones."""
    w = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("user_id", "day", F.count(value).over(w).alias("n"), F.avg(value).over(w).alias("mean"), F.stddev_samp(value).over(w).alias("sd"))


def average_rank(rows: DataFrame, by: str, keys=()) -> DataFrame:
    """Mid-ranks: ties share their mean rank. Values are counted first, so that only distinct values are put in order."""
    counts = running_totals(rows.groupBy(*keys, by).agg(F.count("*").alias("_c")), keys, by, ("_c",))
    mid = counts.select(*keys, by, (F.col("_c_before") + (F.col("_c") + 1) / 2).alias("rank"))
    return join_nulls(rows, mid, [*keys, by])


def pair_windows(ends: DataFrame, gap: int = 180) -> DataFrame:
    """Change of each user's second window against the first, for starts `gap` days or more apart, and per year."""
    a = ends.where("window_index = 1").select("user_id", F.col("start_day").alias("start_1"), F.col("mean").alias("mean_1"))
    b = ends.where("window_index = 2").select("user_id", F.col("start_day").alias("start_2"), F.col("mean").alias("mean_2"))
    days = F.col("start_2") - F.col("start_1")
    return a.join(b, "user_id").where(days >= gap).select("user_id", days.alias("gap"), (F.col("mean_2") - F.col("mean_1")).alias("change"), ((F.col("mean_2") - F.col("mean_1")) * 365.25 / days).alias("per_year"))


def head_per_group(rows: DataFrame, group: str, order, n: int) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def best_channel(gates: DataFrame) -> DataFrame:
    """Each user's channel of most strict days, then earliest start, then lowest code."""
    best = F.max(F.struct("strict_days", (-F.col("start")).alias("s"), (-F.col("channel")).alias("c"))).alias("b")
    return gates.groupBy("user_id").agg(best, F.count("*").alias("channels")).select("user_id", (-F.col("b.c")).alias("channel"), F.col("b.strict_days").alias("strict_days"), (-F.col("b.s")).alias("start"), "channels")


def nested_k(days: DataFrame, ks, tag: str = "") -> DataFrame:
    """For each k the first k days, or with a tag k days of one fixed permutation: smaller sets lie within larger ones."""
    order = fn.hash_rank_key(tag, F.col("user_id"), F.col("day")) if tag else F.col("day")
    ranked = days.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(order)).cast("long")).where(F.col("rank") <= max(ks))
    return ranked.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in ks]))).where(F.col("rank") <= F.col("k"))


def first_window(windows: DataFrame) -> DataFrame:
    return windows.groupBy("user_id").agg(F.min_by(F.struct("window_index", "start_day", "end_day"), "window_index").alias("w")).select("user_id", "w.*")


def finite_on_all_dates(selected: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Keeps a user only if both measures have a value on every selected date; `kept` and what is missing of either."""
    a, b = first.select("user_id", "day", F.col("value").alias("_a")), second.select("user_id", "day", F.col("value").alias("_b"))
    j = selected.join(a, ["user_id", "day"], "left").join(b, ["user_id", "day"], "left")
    out = j.groupBy("user_id").agg(F.count("*").alias("dates"), F.count_if(F.col("_a").isNull()).alias("missing_first"), F.count_if(F.col("_b").isNull()).alias("missing_second"))
    return out.withColumn("kept", (F.col("missing_first") == 0) & (F.col("missing_second") == 0))


def common_date_reselect(dates: DataFrame, other: DataFrame, windows: DataFrame, target: int, base: int, tag: str) -> DataFrame:
    """Dates that both measures have, quotas anew from what is left of each block, and a new draw."""
    common = dates.join(other.select("user_id", "day").distinct(), ["user_id", "day"], "left_semi")
    return sample_dates(common, windows, block_quotas(block_capacities(common, windows), target, base), tag)
