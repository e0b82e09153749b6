"""Bins of a day as rows: runs, differences, fills, smoothing, mask statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators.ranks import quantiles

KEYS = ("user_id", "day")


def full_grid(bins: DataFrame, n_bins: int, keys=KEYS) -> DataFrame:
    """All bins of every day that has one; unobserved bins are null, never 0."""
    grid = bins.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))).alias("bin"))
    return grid.join(bins, [*keys, "bin"], "left")


def bin_runs(grid: DataFrame, keys=KEYS) -> DataFrame:
    """Maximal runs of observed or missing bins: start, end, length, and whether both neighbours are inside the day."""
    miss = F.col("hr").isNull()
    by = Window.partitionBy(*keys).orderBy("bin")
    island = F.col("bin") - F.row_number().over(Window.partitionBy(*keys, "missing").orderBy("bin"))
    marked = grid.withColumn("missing", miss).withColumn("_last", F.max("bin").over(Window.partitionBy(*keys))).withColumn("_i", island)
    runs = marked.groupBy(*keys, "missing", "_i").agg(F.min("bin").alias("start"), F.max("bin").alias("end"), F.count("*").alias("length"), F.max("_last").alias("_last"))
    return runs.withColumn("interior", (F.col("start") > 0) & (F.col("end") < F.col("_last"))).drop("_i", "_last")


def clean_diff(grid: DataFrame, keys=KEYS) -> DataFrame:
    """Next bin less this one, 0 unless both are observed."""
    nxt = F.lead("hr").over(Window.partitionBy(*keys).orderBy("bin"))
    return grid.withColumn("diff", F.coalesce(nxt - F.col("hr"), F.lit(0.0)))


def fill_template(train: DataFrame) -> DataFrame:
    return quantiles(train, ["bin"], "hr", {"template": 0.5}, few=True)


def fill_clock(grid: DataFrame, train: DataFrame) -> DataFrame:
    """Missing bins take the training median of their bin, else of all bins; observed bins stay.

    The template has one row for each bin of a day, 1,440 at most, and is broadcast.
    """
    whole = quantiles(train, [], "hr", {"whole": 0.5})
    return grid.join(F.broadcast(fill_template(train)), "bin", "left").crossJoin(F.broadcast(whole)).withColumn("filled", F.coalesce("hr", "template", "whole")).drop("template", "whole")


def fill_linear(filled: DataFrame, k_max: int = 5, keys=KEYS) -> DataFrame:
    """Interior gaps of k_max bins or fewer go straight between their neighbours; other bins keep `filled`."""
    back = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("hr").isNotNull(), F.col("bin"))
    out = filled.withColumn("_b0", F.last(at, True).over(back)).withColumn("_h0", F.last("hr", True).over(back)).withColumn("_b1", F.first(at, True).over(ahead)).withColumn("_h1", F.first("hr", True).over(ahead))
    line = F.col("_h0") + (F.col("_h1") - F.col("_h0")) * (F.col("bin") - F.col("_b0")) / (F.col("_b1") - F.col("_b0"))
    short = F.col("hr").isNull() & (F.col("_b1") - F.col("_b0") - 1 <= k_max)
    return out.withColumn("linear", F.when(short, line).otherwise(F.col("filled"))).drop("_b0", "_b1", "_h0", "_h1")


def circular_smooth(profile: DataFrame, length: int, sigma: float, truncate: float = 4.0, keys=(), pos: str = "bin", value: str = "hr", nulls: str = "normalize") -> DataFrame:
    """Gaussian smoothing that wraps at the end of the day; nulls are left out and weights normalised.

    With nulls="normalize" a bin without a value gets the mean of those in reach (none: no row), with "omit" it stays null. A
    sigma of 0 leaves values as they are. The kernel is exploded beside each bin, so the shuffle is a sum by (keys, bin).
    """
    if nulls not in ("normalize", "omit"):
        raise ValueError(f"nulls is normalize or omit, not {nulls}")
    reach = int(truncate * sigma + 0.5) if sigma > 0 else 0
    kernel = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(math.exp(-0.5 * (k / sigma) ** 2) if k else 1.0).alias("w")) for k in range(-reach, reach + 1)])
    spread = profile.where(F.col(value).isNotNull()).select(*keys, pos, value, F.explode(kernel).alias("x")).select(*keys, F.pmod(F.col(pos) + F.col("x.k"), F.lit(length)).alias(pos), (F.col("x.w") * F.col(value)).alias("v"), F.col("x.w").alias("w"), (F.col("x.k") == 0).alias("own"))
    smooth = F.sum("v") / F.sum("w")
    return spread.groupBy(*keys, pos).agg((smooth if nulls == "normalize" else F.when(F.bool_or("own"), smooth)).alias("smooth"))


def mask_stats(grid: DataFrame) -> DataFrame:
    """Mean and sample deviation of the observed mask of each user's bins; the deviation is 0 for one day."""
    n, p = F.count("*"), F.avg(F.col("hr").isNotNull().cast("double"))
    return grid.groupBy("user_id", "bin").agg(p.alias("share"), n.alias("days")).withColumn("sd", F.when(F.col("days") > 1, F.sqrt(F.col("share") * (1 - F.col("share")) * F.col("days") / (F.col("days") - 1))).otherwise(0.0))


def pool_mask(grid: DataFrame, bins: int = 3, keys=KEYS) -> DataFrame:
    """The grid in coarser bins, observed where one of its bins is: hr is 1 or null."""
    return grid.groupBy(*keys, F.floor(F.col("bin") / bins).cast("long").alias("bin")).agg(F.max(F.when(F.col("hr").isNotNull(), 1.0)).alias("hr"))


def transition_dynamics(grid: DataFrame, windows: dict[str, tuple[int, int]], pool: int = 3, keys=KEYS) -> DataFrame:
    """Counts and shares of observed and missing bins followed by either, within days, hazards of stopping and starting, and stops a day.

    A row for each user and part: `all`, each clock window (bins from, to, of the step's first bin, end exclusive), and `pooled`,
    all steps of the mask in bins of `pool`.
    """
    on = F.col("hr").isNotNull()

    def steps(g, part):
        m = g.withColumn("on", on).withColumn("next", F.lead(on).over(Window.partitionBy(*keys).orderBy("bin"))).where("next IS NOT NULL")
        return m.withColumn("part", part).select(*keys, F.explode("part").alias("part"), "on", "next").where("part IS NOT NULL")

    parts = F.array(F.lit("all"), *[F.when(F.col("bin").between(a, b - 1), F.lit(n)) for n, (a, b) in windows.items()])
    m = steps(grid, parts).unionByName(steps(pool_mask(grid, pool, keys), F.array(F.lit("pooled"))))
    c = lambda a, b: F.count_if((F.col("on") == a) & (F.col("next") == b))
    daily = m.groupBy(*keys, "part").agg(c(True, True).alias("n11"), c(True, False).alias("n10"), c(False, True).alias("n01"), c(False, False).alias("n00"))
    out = daily.groupBy("user_id", "part").agg(*[F.sum(x).alias(x) for x in ("n11", "n10", "n01", "n00")], F.avg("n10").alias("stops_a_day"), F.coalesce(F.stddev_samp("n10"), F.lit(0.0)).alias("stops_sd"))
    total = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    return out.withColumns({f"f{k}": F.col(f"n{k}") / total for k in ("11", "10", "01", "00")} | {"stop": F.try_divide("n10", F.col("n10") + F.col("n11")), "start": F.try_divide("n01", F.col("n01") + F.col("n00"))})


def gap_run_profile(runs: DataFrame, edges=(1, 3, 6)) -> DataFrame:
    """Runs of each user, missing or observed, by length bucket and whether inside the day."""
    bucket = F.lit(len(edges))
    for i in reversed(range(len(edges))):
        bucket = F.when(F.col("length") <= edges[i], i).otherwise(bucket)
    return runs.groupBy("user_id", "missing", bucket.cast("long").alias("bucket"), "interior").agg(F.count("*").alias("n_runs"), F.sum("length").alias("bins"))


def gap_clock_profile(runs: DataFrame, windows: dict[str, tuple[int, int]], charging: tuple[int, int], micro: int) -> DataFrame:
    """Interior gaps a day of each user by the clock window of their midpoint: charging (of such lengths) and micro (of `micro` bins at most)."""
    middle = (F.col("start") + F.col("end")) / 2
    name = F.lit("other")
    for n, (a, b) in windows.items():
        name = F.when((middle >= a) & (middle < b), n).otherwise(name)
    days = runs.groupBy("user_id").agg(F.countDistinct("day").alias("days"))
    inside = runs.where("missing AND interior").groupBy("user_id", name.alias("window")).agg(F.count_if(F.col("length").between(*charging)).alias("charging"), F.count_if(F.col("length") <= micro).alias("micro"))
    return inside.join(days, "user_id").select("user_id", "window", "charging", "micro", (F.col("charging") / F.col("days")).alias("charging_a_day"), (F.col("micro") / F.col("days")).alias("micro_a_day"))


def daily_signals(grid: DataFrame, night=(0, 2), day=(3, 7), least_night: int = 1, least_day: int = 1, compliant: float = 0.5, keys=KEYS) -> DataFrame:
    """Tenth percentile, mean of night and day bins with enough of them, their ratio, the occupied share of each day and of its night, whether that complies, and gap episodes (an observed bin followed by a missing one)."""
    seen = F.col("hr").isNotNull()
    at = lambda r: F.col("bin").between(*r)
    part = lambda r, least: F.when(F.count_if(seen & at(r)) >= least, F.avg(F.when(at(r), F.col("hr"))))
    stop = seen & ~F.lead(seen).over(Window.partitionBy(*keys).orderBy("bin"))
    out = grid.withColumn("_s", stop).groupBy(*keys).agg(F.percentile("hr", F.lit(0.1)).alias("p10"), part(night, least_night).alias("night"), part(day, least_day).alias("day_mean"), F.avg(seen.cast("double")).alias("occupancy"), F.avg(F.when(at(night), seen.cast("double"))).alias("night_occupancy"), F.count_if("_s").alias("gap_episodes"))
    return out.withColumn("dipping", F.try_divide("night", "day_mean")).withColumn("night_compliant", F.col("night_occupancy") >= compliant)


def fill_global(grid: DataFrame, train: DataFrame, constant: float = 0.0) -> DataFrame:
    """Missing bins take the training median of all bins (`level`) or a constant (`fixed`)."""
    whole = quantiles(train, [], "hr", {"whole": 0.5})
    return grid.crossJoin(F.broadcast(whole)).withColumn("level", F.coalesce("hr", "whole")).withColumn("fixed", F.coalesce("hr", F.lit(constant))).drop("whole")  # whole is one row


def fill_pchip(filled: DataFrame, k_max: int = 12, keys=KEYS) -> DataFrame:
    """Interior gaps of k_max bins or fewer by the monotone cubic through two observed neighbours on each side.

    With fewer neighbours the gap is a straight line; other bins keep `filled`. Adds `pchip` and the gap's length.
    """
    seen = F.col("hr").isNotNull()
    own = Window.partitionBy(*keys, "_on").orderBy("bin")
    x, y = F.col("bin").cast("double"), F.col("hr")
    pair = filled.withColumn("_on", seen).withColumn("_p", F.struct(F.lag(x).over(own).alias("x0"), F.lag(y).over(own).alias("y0"), x.alias("x1"), y.alias("y1"))).withColumn("_q", F.struct(x.alias("x2"), y.alias("y2"), F.lead(x).over(own).alias("x3"), F.lead(y).over(own).alias("y3")))
    back = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    near = pair.withColumn("_p", F.last(F.when(F.col("_on"), F.col("_p")), True).over(back)).withColumn("_q", F.first(F.when(F.col("_on"), F.col("_q")), True).over(ahead))
    out = near.withColumns({f"_{c}": F.col(f"_p.{c}") for c in ("x0", "y0", "x1", "y1")} | {f"_{c}": F.col(f"_q.{c}") for c in ("x2", "y2", "x3", "y3")})
    c = lambda n: F.col(f"_{n}")
    h0, h, h2 = c("x1") - c("x0"), F.nullif(c("x2") - c("x1"), F.lit(0.0)), c("x3") - c("x2")  # an observed bin has no gap
    d0, d, d2 = (c("y1") - c("y0")) / h0, (c("y2") - c("y1")) / h, (c("y3") - c("y2")) / h2
    # Weighted harmonic mean of neighbouring slopes, 0 where they differ in sign: keeps the curve monotone.
    slope = lambda a, b, ha, hb: F.when(a * b > 0, 3 * (ha + hb) / ((2 * hb + ha) / a + (hb + 2 * ha) / b)).when(a.isNotNull() & b.isNotNull(), 0.0)
    m1, m2, t = slope(d0, d, h0, h), slope(d, d2, h, h2), (x - c("x1")) / h
    cubic = (2 * t**3 - 3 * t**2 + 1) * c("y1") + (t**3 - 2 * t**2 + t) * h * m1 + (3 * t**2 - 2 * t**3) * c("y2") + (t**3 - t**2) * h * m2
    line = c("y1") + (c("y2") - c("y1")) * t
    gap = F.when(~F.col("_on"), h - 1).cast("long")
    used = [f"_{n}" for n in ("on", "p", "q", "x0", "y0", "x1", "y1", "x2", "y2", "x3", "y3")]
    return out.withColumn("gap", gap).withColumn("_line", line).withColumn("pchip", F.when(F.col("gap") <= k_max, F.coalesce(cubic, line)).otherwise(F.col("filled"))).drop(*used)


def fill_three_tier(filled: DataFrame, k_max: int = 12, keys=KEYS) -> DataFrame:
    """Gaps of one bin on a straight line, up to k_max by the monotone cubic, others and the day's edges by `filled`."""
    return fill_pchip(filled, k_max, keys).withColumn("tiered", F.when(F.col("gap") == 1, F.col("_line")).otherwise(F.col("pchip"))).drop("_line")


def gap_exposure(grid: DataFrame, short: int, keys=KEYS) -> DataFrame:
    """Steps between neighbouring bins by what lies there: both observed, or by the missing run: short, long, edge. Their sum is all steps."""
    on = F.col("hr").isNotNull()
    by = Window.partitionBy(*keys).orderBy("bin")
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    at = F.when(on, F.col("bin"))
    near = grid.withColumn("_on", on).withColumn("_b0", F.last(at, True).over(back)).withColumn("_b1", F.first(at, True).over(ahead)).withColumn("_next", F.lead("bin").over(by)).withColumn("_n1", F.lead(on).over(by))
    # The run that a step touches lies between the last observed bin up to its left end and the first from its right end.
    right = near.withColumn("_r1", F.lead("_b1").over(by)).where("_next IS NOT NULL")
    kind = F.when(F.col("_on") & F.col("_n1"), "observed").when(F.col("_b0").isNull() | F.col("_r1").isNull(), "edge").when(F.col("_r1") - F.col("_b0") - 1 <= short, "short").otherwise("long")
    n = lambda k: F.count_if(F.col("_k") == k).alias(k)
    return right.withColumn("_k", kind).groupBy("user_id").agg(F.count("*").alias("steps"), n("observed"), n("short"), n("long"), n("edge"))


def step_error(filled: DataFrame, columns, keys=KEYS) -> DataFrame:
    """Mean absolute and root mean square step between neighbouring bins under each fill."""
    by = Window.partitionBy(*keys).orderBy("bin")
    steps = filled.select(*keys, *[(F.lead(c).over(by) - F.col(c)).alias(c) for c in columns])
    return steps.groupBy("user_id").agg(*[x for c in columns for x in (F.avg(F.abs(c)).alias(f"{c}_mae"), F.sqrt(F.avg(F.col(c) * F.col(c))).alias(f"{c}_rms"))])


def shuffle_within_day(grid: DataFrame, tag: str, keys=KEYS) -> DataFrame:
    """Deals a day's observed values to its observed bins in the order of a hash; the mask stays."""
    seen = grid.where("hr IS NOT NULL").select(*keys, "bin", "hr")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("bin"))
    drawn = F.row_number().over(Window.partitionBy(*keys).orderBy(fn.hash_rank_key(tag, *[F.col(k) for k in keys], F.col("bin"))))
    dealt = seen.select(*keys, "bin", place.alias("_r")).join(seen.select(*keys, F.col("hr").alias("shuffled"), drawn.alias("_r")), [*keys, "_r"]).drop("_r")
    return grid.join(dealt, [*keys, "bin"], "left")


def hide_stretches(grid: DataFrame, tiers: dict[str, tuple[int, int]], tag: str, each: int = 1, keys=KEYS) -> DataFrame:
    """Hidden stretches: for each user and tier (least, most bins) up to `each` observed runs, and in each a stretch inside it.

    Runs, lengths and starts are drawn by hashes of tag, tier, user, day and start. A run holds a bin more at either end, which stays. Returns
    (user_id, day, gap_tier, first, last).
    """
    draw = lambda *c: F.conv(F.substring(fn.hash_rank_key(tag, *c), 1, 8), 16, 10).cast("long")
    runs = bin_runs(grid, keys).where("NOT missing")
    tier = F.explode(F.array(*[F.struct(F.lit(n).alias("gap_tier"), F.lit(a).alias("least"), F.lit(b).alias("most")) for n, (a, b) in tiers.items()]))
    open_ = runs.select(*keys, "start", "end", "length", tier.alias("t")).select(*keys, "start", "end", "length", "t.*").where("length >= least + 2")
    key = (F.col("gap_tier"), F.col("user_id"), F.col("day"), F.col("start"))
    place = F.row_number().over(Window.partitionBy("user_id", "gap_tier").orderBy(fn.hash_rank_key(tag, *key), "day", "start"))
    chosen = open_.withColumn("_r", place).where(F.col("_r") <= each)
    k = F.col("least") + draw(F.lit("length"), *key) % (F.least(F.col("most"), F.col("length") - 2) - F.col("least") + 1)
    first = F.col("start") + 1 + draw(F.lit("start"), *key) % (F.col("length") - 1 - F.col("_k"))
    return chosen.withColumn("_k", k).withColumn("first", first.cast("long")).select(*keys, "gap_tier", "first", (F.col("first") + F.col("_k") - 1).cast("long").alias("last"))


def fill_error(grid: DataFrame, hidden: DataFrame, k_max: int, occupancy=(0.25, 0.5), constant: float = 0.0, keys=KEYS) -> DataFrame:
    """MAE, RMSE and jump at the left edge of five fills over hidden stretches, by gap tier, the user's occupancy tier, both and neither.

    Each stretch is hidden in a copy of its day of its own; templates come from all days without any hidden bin. Fills: clock
    template, level, constant, straight line and monotone cubic through what is left. Every stretch counts once.
    """
    keys, one = list(keys), ["user_id", "day", "gap_tier", "first"]
    covered = grid.join(hidden, keys).where(F.col("bin").between(F.col("first"), F.col("last"))).select(*keys, "bin").distinct()
    left = grid.join(covered, [*keys, "bin"], "left_anti")
    share = grid.groupBy("user_id").agg(F.avg(F.col("hr").isNotNull().cast("double")).alias("_o"))
    copies = grid.join(hidden, keys).withColumn("_in", F.col("bin").between(F.col("first"), F.col("last"))).withColumn("truth", F.when(F.col("_in"), F.col("hr"))).withColumn("hr", F.when(~F.col("_in"), F.col("hr")))
    filled = fill_pchip(fill_linear(fill_global(fill_clock(copies, left), left, constant), 10**9, one), k_max, one)
    before = F.lag("hr").over(Window.partitionBy(*one).orderBy("bin"))
    done = filled.withColumn("_left", before).where("_in")
    guesses = {"clock": "filled", "level": "level", "constant": "fixed", "linear": "linear", "cubic": "pchip"}
    e = {n: F.col(c) - F.col("truth") for n, c in guesses.items()}
    per = done.groupBy(*one).agg(*[F.struct(F.lit(n).alias("fill"), F.avg(F.abs(e[n])).alias("mae"), F.sqrt(F.avg(e[n] * e[n])).alias("rmse"), F.max(F.when(F.col("bin") == F.col("first"), F.abs(F.col(c) - F.col("_left")))).alias("jump")).alias(n) for n, c in guesses.items()])
    per = per.select(*one, F.explode(F.array(*guesses)).alias("x")).join(share, "user_id")
    tier = F.when(F.col("_o") < occupancy[0], "low").when(F.col("_o") < occupancy[1], "medium").otherwise("high")
    per = per.select("gap_tier", tier.alias("occupancy_tier"), "x.*")
    out = per.groupingSets([[F.col("fill")], [F.col("fill"), F.col("gap_tier")], [F.col("fill"), F.col("occupancy_tier")], [F.col("fill"), F.col("gap_tier"), F.col("occupancy_tier")]], "fill", "gap_tier", "occupancy_tier")
    sem = lambda c: F.coalesce(F.stddev_samp(c) / F.sqrt(F.count("*")), F.lit(0.0)).alias(f"{c}_sem")
    out = out.agg(F.grouping("gap_tier").alias("_g"), F.grouping("occupancy_tier").alias("_p"), F.count("*").alias("n"), *[x for c in ("mae", "rmse", "jump") for x in (F.avg(c).alias(c), sem(c))])
    return out.withColumn("gap_tier", F.when(F.col("_g") == 1, "ALL").otherwise(F.col("gap_tier"))).withColumn("occupancy_tier", F.when(F.col("_p") == 1, "ALL").otherwise(F.col("occupancy_tier"))).drop("_g", "_p")
