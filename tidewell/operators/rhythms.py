"""Trends and periods of daily series: sums of products over (series, trial period), closed-form solves in SQL."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def detrend(series: DataFrame, keys=("user_id",)) -> DataFrame:
    """Residuals of each series from its own line on the calendar day; a series of one day has residual 0."""
    t = F.col("day").cast("double")
    fit = series.groupBy(*keys).agg(F.coalesce(F.regr_slope("value", t), F.lit(0.0)).alias("_b"), F.avg("value").alias("_m"), F.avg(t).alias("_t"))
    return series.join(fit, list(keys)).withColumn("residual", F.col("value") - F.col("_m") - F.col("_b") * (t - F.col("_t"))).drop("_b", "_m", "_t")


#: Trial periods in days: half-day steps from 14 to 56. Flanks of the peak band: up to 22 and from 38 days.
PERIODS = [x / 2 for x in range(28, 113)]
FLANKS = ((14.0, 22.0), (38.0, 56.0))


def spectrum(series: DataFrame, periods: list[float] = PERIODS, keys=("user_id",), value: str = "residual") -> DataFrame:
    """Normalised power (the explained share of the sum of squares) and amplitude of each trial period: least squares of value on cos and sin.

    Periods are a literal array, so each day's products are summed map-side and only sums are shuffled.
    """
    x = series.select(*keys, F.col("day").cast("double").alias("t"), F.col(value).alias("y"), F.explode(F.array(*map(F.lit, periods))).alias("period"))
    a = 2 * math.pi * F.col("t") / F.col("period")
    x = x.withColumn("c", F.cos(a)).withColumn("s", F.sin(a))
    m = x.groupBy(*keys, "period").agg(F.count("*").alias("n"), *[F.avg(F.col(p) * F.col(q)).alias(p + q) for p, q in ("cc", "ss", "cs", "cy", "sy", "yy")])
    det = F.col("cc") * F.col("ss") - F.col("cs") ** 2
    b = (F.col("cy") * F.col("ss") - F.col("sy") * F.col("cs")) / det
    g = (F.col("sy") * F.col("cc") - F.col("cy") * F.col("cs")) / det
    ok = (det > 1e-9) & (F.col("yy") > 1e-12)
    return m.select(*keys, "period", "n", F.when(ok, (b * F.col("cy") + g * F.col("sy")) / F.col("yy")).alias("power"), F.when(ok, F.hypot(b, g)).alias("amplitude"), F.when(ok, F.atan2(g, b)).alias("phase"))


def peak(powers: DataFrame, keys=("user_id",), flanks=FLANKS) -> DataFrame:
    """The period of the largest power, ties to the shorter, its amplitude and phase, and its share of the median power of the flanks."""
    inside = F.lit(False)
    for low, high in flanks:
        inside = inside | F.col("period").between(low, high)
    best = F.max_by(F.struct("period", "power", "amplitude", "phase"), F.struct(F.round("power", 9), -F.col("period")))
    return powers.where("power IS NOT NULL").groupBy(*keys).agg(best.alias("p"), F.median(F.when(inside, F.col("power"))).alias("noise_floor")).select(*keys, "p.*", "noise_floor", F.try_divide("p.power", "noise_floor").alias("snr"))


def cosinor_grid(series: DataFrame, periods: list[float] = PERIODS, keys=("user_id",)) -> DataFrame:
    """value on 1, day, cos and sin in one fit for each period: R2 gained over 1 and day, amplitude, acrophase, F(2, n - 4) and its p.

    What day explains is taken out of the products of the others, which leaves two equations. The products are summed up in
    one task for each series (a few thousand days), so no row for each period is shuffled.
    """
    keys, grid = list(keys), np.array(periods, float)
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    pairs = ("cc", "ss", "cs", "cy", "sy", "yy", "ct", "st", "yt", "tt")

    def products(day: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Covariances of each period over the days that have both; NaN where no day has."""
        a = 2 * math.pi * day[:, None] / grid
        v = {"c": np.cos(a), "s": np.sin(a), "t": (day - day[0])[:, None], "y": y[:, None]}
        own = lambda rows: {k: x[rows] - x[rows].mean(axis=0) for k, x in v.items()} if rows.any() else {k: np.full((1, 1), np.nan) for k in v}
        every, live = own(np.ones(len(day), bool)), own(~np.isnan(y))
        return {p + q: np.broadcast_to((of[p] * of[q]).mean(axis=0), grid.shape) for p, q in pairs for of in [live if "y" in (p, q) else every]}

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), 512):
                own = frame.iloc[at : at + 512]
                sums = [products(np.asarray(t, float), np.asarray(y, float)) for t, y in zip(own["_t"], own["_y"], strict=True)]
                out = own[keys].iloc[np.repeat(np.arange(len(own)), len(grid))].reset_index(drop=True)
                out["period"], out["n"] = np.tile(grid, len(own)), np.repeat(own["_t"].map(len).to_numpy(), len(grid))
                for p in pairs:
                    x = np.concatenate([s[p] for s in sums])
                    out[p] = pd.arrays.FloatingArray(np.nan_to_num(x), np.isnan(x))
                yield out

    m = in_order(series, keys).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", period double, n long, " + ", ".join(f"{p} double" for p in pairs))
    part = {p + q: F.col(p + q) - F.coalesce(F.try_divide(F.col(f"{p}t") * F.col(f"{q}t"), F.col("tt")), F.lit(0.0)) for p, q in pairs[:6]}
    det = part["cc"] * part["ss"] - part["cs"] ** 2
    b, g = (part["cy"] * part["ss"] - part["sy"] * part["cs"]) / det, (part["sy"] * part["cc"] - part["cy"] * part["cs"]) / det
    m = m.where("n > 4").select(*keys, "period", "n", "yy", part["yy"].alias("_null"), F.when(det > 1e-9, b).alias("_b"), F.when(det > 1e-9, g).alias("_g"), F.when(det > 1e-9, b * part["cy"] + g * part["sy"]).alias("_gain"))
    df = F.col("n") - 4
    f = F.when(F.col("_null") - F.col("_gain") > 1e-12, F.col("_gain") / 2 / ((F.col("_null") - F.col("_gain")) / df))
    out = m.select(*keys, "period", "n", F.try_divide("_gain", "yy").alias("delta_r2"), (1 - F.try_divide("_null", "yy")).alias("r2_null"), F.hypot("_b", "_g").alias("amplitude"), F.atan2("_g", "_b").alias("acrophase"), f.alias("f"))
    return out.withColumn("p", F.pow(1 + 2 * F.col("f") / df, -df / 2))


#: Rows (of windows) whose waves a task holds at once.
HELD = 1 << 15
#: Windows of so many days at most are solved by products of matrices of windows and days.
NARROW_DAYS = 512


def window_powers(day: np.ndarray, y: np.ndarray, start: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(power, amplitude, phase) (window, period) of detrended windows, whose rows lie one after another from `start` on; NaN where there is none.

    What `spectrum(detrend(..))` gives. Rows without a value count as days, not as values.
    """
    n, live = np.diff(np.append(start, len(day))), ~np.isnan(y)
    add = lambda v: np.add.reduceat(v, start, axis=0)
    row = lambda v: np.repeat(v, n)
    with np.errstate(all="ignore"):
        y, k = np.where(live, y, 0.0), add(live.astype(float))
        m = add(y) / k
        t = day - row(add(day) / n)
        own = (t - row(add(t * live) / k)) * live
        size = add(own * own)
        slope = np.where(size > 0, add(own * (y - row(m))) / np.where(size > 0, size, 1.0), 0.0)
        left = np.where(live, y - row(m) - row(slope) * t, 0.0)
        since = (day - row(day[start])).astype(np.int64)
        width = int(since.max()) + 1
        if width <= NARROW_DAYS:  # waves from a window's first day on are the same for all windows, so the sums are matrix products that its phase turns
            at = row(np.arange(len(start))) * width + since
            dense = lambda v: np.bincount(at, weights=v, minlength=len(start) * width).reshape(-1, width)
            turn, phase = 2 * math.pi * np.arange(width)[:, None] / periods, 2 * math.pi * day[start][:, None] / periods
            c, s = np.cos(phase), np.sin(phase)
            values, days = dense(left), dense(None)
            p, q = values @ np.cos(turn), values @ np.sin(turn)
            cy, sy = (c * p - s * q) / k[:, None], (s * p + c * q) / k[:, None]
            p, q = days @ np.cos(2 * turn) / n[:, None], days @ np.sin(2 * turn) / n[:, None]
            c, s = c * c - s * s, 2 * c * s
            twice, cs = c * p - s * q, (s * p + c * q) / 2
            cc, ss = (1 + twice) / 2, (1 - twice) / 2
        else:
            turn = 2 * math.pi * day[:, None] / periods
            c, s = np.cos(turn), np.sin(turn)
            cc, ss, cs = (add(v) / n[:, None] for v in (c * c, s * s, c * s))
            cy, sy = (add(v * left[:, None]) / k[:, None] for v in (c, s))
        yy = (add(left * left) / k)[:, None]
        det = cc * ss - cs * cs
        b, g = (cy * ss - sy * cs) / det, (sy * cc - cy * cs) / det
        fine = (det > 1e-9) & (yy > 1e-12)
        return tuple(np.where(fine, v, np.nan) for v in ((b * cy + g * sy) / yy, np.hypot(b, g), np.arctan2(g, b)))


def window_peaks(day: np.ndarray, y: np.ndarray, start: np.ndarray, periods, flanks=FLANKS) -> tuple[np.ndarray, pd.DataFrame]:
    """(windows that have a power, their `peak`) of rows as in window_powers, some HELD rows at a time."""
    grid = np.sort(np.array(periods, float))
    inside = np.any([(grid >= low) & (grid <= high) for low, high in flanks], axis=0)
    ends, at, out = np.append(start, len(day)), 0, []
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + HELD, "right")) - 1)
        power, amplitude, phase = window_powers(day[ends[at] : ends[to]], y[ends[at] : ends[to]], start[at:to] - start[at], grid)
        some = np.flatnonzero(~np.isnan(power).all(axis=1))
        power, best = power[some], np.nan_to_num(np.round(power[some], 9), nan=-np.inf).argmax(axis=1)  # the shortest of equal ones
        pick = np.arange(len(some))
        flank = np.sort(power[:, inside], axis=1)  # NaN last
        many = (~np.isnan(flank)).sum(axis=1)
        middle = lambda i: flank[pick, np.clip(i, 0, max(flank.shape[1] - 1, 0))] if flank.shape[1] else np.full(len(some), np.nan)
        floor = (middle((many - 1) // 2) + middle(many // 2)) / 2
        ratio = np.divide(power[pick, best], floor, out=np.full(len(some), np.nan), where=floor != 0)
        out.append((some + at, pd.DataFrame({"period": grid[best], "power": power[pick, best], "amplitude": amplitude[some][pick, best], "phase": phase[some][pick, best], "noise_floor": floor, "snr": ratio})))
        at = to
    return np.concatenate([i for i, _ in out]), pd.concat([f for _, f in out], ignore_index=True)


PEAK_SCHEMA = "period double, power double, amplitude double, phase double, noise_floor double, snr double"


def in_order(series: DataFrame, keys) -> DataFrame:
    """(keys, _t, _y): days and values of each series in the order of days; series are dealt by a hash of their keys (by the keys themselves Spark would coalesce them), since their work is not in bytes."""
    own = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col("day").cast("long").alias("t"), F.col("value").cast("double").alias("y")))).alias("_o"))
    flat = own.select(*keys, F.transform("_o", lambda r: r["t"]).alias("_t"), F.transform("_o", lambda r: r["y"]).alias("_y"))
    return flat.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def nulls_of(frame: pd.DataFrame) -> pd.DataFrame:
    """Numbers that aren't there as nulls."""
    return frame.assign(**{c: pd.array(frame[c].where(frame[c].notna(), None), "Float64") for c in ("noise_floor", "snr")})


def series_peaks(series: DataFrame, periods: list[float] = PERIODS, keys=("user_id",)) -> DataFrame:
    """`peak(spectrum(detrend(series)))`, found in one task for each series (a few thousand days): no row for each period is shuffled."""
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), 512):
                own = frame.iloc[at : at + 512]
                n = own["_t"].map(len).to_numpy()
                some, found = window_peaks(np.concatenate(own["_t"].to_list()).astype(float), np.concatenate([np.asarray(v, float) for v in own["_y"]]), np.cumsum(n) - n, periods)
                yield pd.concat([own[keys].iloc[some].reset_index(drop=True), nulls_of(found)], axis=1)

    return in_order(series, keys).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + PEAK_SCHEMA)


def sliding_spectrum(series: DataFrame, periods: list[float] = PERIODS, window: int = 90, step: int = 15, min_days: int = 45) -> DataFrame:
    """Peak period of each window of `window` days that starts `step` days after the one before, from a user's first day on, with min_days days or more.

    Windows lie wholly within a user's first and last day. A user's days are shuffled once; their windows are cut and solved in one task.
    """
    user = {f.name: f.dataType.simpleString() for f in series.schema}["user_id"]

    def windows(day: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first days, starts of rows, days, values) of a user's windows that have enough days."""
        since = day - day[0]
        number = np.concatenate([since // step - j for j in range(-(-window // step))])
        row = np.tile(np.arange(len(day)), -(-window // step))
        own = (number >= 0) & (since[row] - number * step < window) & (number <= (since[-1] - window) // step)
        row, number = row[own], number[own]
        order = np.lexsort((row, number))
        row, number = row[order], number[order]
        found, count = np.unique(number, return_counts=True)
        row, found, count = row[np.repeat(count >= min_days, count)], found[count >= min_days], count[count >= min_days]
        return day[0] + found * step, np.cumsum(count) - count, day[row].astype(float), y[row]

    def run(frames):
        for frame in frames:
            for who, t, y in zip(frame["user_id"], frame["_t"], frame["_y"], strict=True):
                first, start, day, value = windows(np.asarray(t, np.int64), np.asarray(y, float))
                if len(start):
                    some, found = window_peaks(day, value, start, periods)
                    out = nulls_of(found)
                    out.insert(0, "start_day", first[some])
                    out.insert(0, "user_id", who)
                    yield out

    return in_order(series, ("user_id",)).mapInPandas(run, f"user_id {user}, start_day long, {PEAK_SCHEMA}")


def period_drift(peaks: DataFrame, low: float = 25.0, high: float = 35.0) -> DataFrame:
    """Spread between the quartiles of a user's peak periods over windows, and the share of them between low and high."""
    q = lambda p: F.percentile("period", F.lit(p))
    return peaks.groupBy("user_id").agg(F.count("*").alias("windows"), (q(0.75) - q(0.25)).alias("drift"), F.avg(F.col("period").between(low, high).cast("double")).alias("share_in_band"))


def phase_coherence(powers: DataFrame, stratum: str, near: float = 29.530589) -> DataFrame:
    """Mean resultant length of users' phases at each period of each stratum, the level that one in 20 uniform sets exceeds, and the share of the stratum's periods above theirs."""
    r = powers.where("phase IS NOT NULL").groupBy(stratum, "period").agg(F.count("*").alias("n"), F.hypot(F.avg(F.cos("phase")), F.avg(F.sin("phase"))).alias("coherence"))
    r = r.withColumn("null95", F.sqrt(-F.log(F.lit(0.05)) / F.col("n")))
    share = r.groupBy(stratum).agg(F.avg((F.col("coherence") > F.col("null95")).cast("double")).alias("exceed_share"), F.min_by("coherence", F.struct(F.abs(F.col("period") - near), "period")).alias("coherence_near"), F.max_by("period", F.struct(F.round("coherence", 9), -F.col("period"))).alias("period_at_max"))
    return r.join(share, stratum)


#: Trial values of the day-to-day correlation: hundredths up to 0.99, and 0.995.
PHIS = [*(x / 100 for x in range(100)), 0.995]


def ar1(series: DataFrame, keys=("user_id",), value: str = "residual", least: int = 3) -> DataFrame:
    """Calendar AR(1): phi of the largest profile likelihood on days of any gaps, of equal ones the smallest, and the variance there.

    Days a and b correlate by phi ** (b - a). Phi comes from a grid, a literal array beside each day, so only sums are shuffled.
    """
    w = Window.partitionBy(*keys).orderBy("day")
    x = series.select(*keys, F.col(value).alias("y"), F.lag(value).over(w).alias("_p"), (F.col("day") - F.lag("day").over(w)).alias("_g"))
    x = x.withColumn("phi", F.explode(F.array(*map(F.lit, PHIS))))  # behind the window, which would see its copies
    at = F.when(F.col("_p").isNull(), 0.0).otherwise(F.pow("phi", "_g"))
    rest = F.greatest(1 - at * at, F.lit(1e-12))
    sums = x.groupBy(*keys, "phi").agg(F.count("*").alias("days"), F.sum((F.col("y") - at * F.coalesce("_p", F.lit(0.0))) ** 2 / rest).alias("_q"), F.sum(F.log(rest)).alias("_d")).where(F.col("days") >= least)
    variance = F.greatest(F.col("_q") / F.col("days"), F.lit(1e-12))
    cost = F.round(F.col("days") * F.log(variance) + F.col("_d"), 6)
    return sums.groupBy(*keys).agg(F.max("days").alias("days"), F.min_by(F.struct("phi", variance.alias("variance")), F.struct(cost, "phi")).alias("b")).select(*keys, "days", "b.*")
