"""Fits of periods and phases behind nuisance terms for many windows at once, recording controls, and phases of the moon.

Windows hold 180 dates at most, so a batch of them is a few stacked arrays; all windows of a batch are screened, projected and
solved together.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKDAYS = ("tue", "wed", "thu", "fri", "sat", "sun")
#: Periods of 3 to 60 days, even in frequency, with the ends of the 25 to 35 day band; and that band by half days.
BROAD = [1 / f for f in sorted({*(k / 720 for k in range(12, 241)), 1 / 35, 1 / 25})]
NARROW = [25 + k / 2 for k in range(21)]
#: Windows solved together.
STACK = 64

#: Julian days of 1970-01-01 and 2000-01-01 12:00, coefficients of mean elongation, solar and lunar anomaly in degrees by powers of Julian centuries,
#: and the largest periodic terms of the true elongation and of the true anomaly in degrees.
JD_1970, JD_2000, CENTURY = 2440587.5, 2451545.0, 36525.0
MEAN_ELONGATION = (297.8501921, 445267.1114034, -0.0018819, 1 / 545868.0, -1 / 113065000.0)
SOLAR_ANOMALY = (357.5291092, 35999.0502909, -0.0001536, 1 / 24490000.0)
LUNAR_ANOMALY = (134.9633964, 477198.8675055, 0.0087414, 1 / 69699.0, -1 / 14712000.0)
ELONGATION_TERMS = ((6.289, (0, 0, 1)), (-2.100, (0, 1, 0)), (1.274, (2, 0, -1)), (0.658, (2, 0, 0)), (0.214, (0, 0, 2)), (0.110, (1, 0, 0)))
ANOMALY_TERMS = ((6.289, 1), (1.274, 2), (0.658, 3), (0.214, 4))


def _mean(day: Column, coefficients) -> Column:
    """A polynomial in Julian centuries, in degrees from 0 to 360."""
    t = (day.cast("double") + JD_1970 - JD_2000) / CENTURY
    value = F.lit(0.0)
    for c in reversed(coefficients):
        value = value * t + c
    return F.pmod(value, F.lit(360.0))


def lunar_elongation(day: Column) -> Column:
    """Elongation of the moon from the sun in degrees by days since 1970: 0 at new moon, 180 at full moon; within about 0.1 degrees of the truncated series."""
    d, m, l = (_mean(day, c) for c in (MEAN_ELONGATION, SOLAR_ANOMALY, LUNAR_ANOMALY))  # noqa: E741
    terms = [F.lit(a) * F.sin(F.radians(d * i + m * j + l * k)) for a, (i, j, k) in ELONGATION_TERMS]
    return F.pmod(sum(terms, d), F.lit(360.0))


def lunar_anomaly(day: Column) -> Column:
    """True anomaly of the moon in degrees: 0 at perigee."""
    l = _mean(day, LUNAR_ANOMALY)  # noqa: E741
    return F.pmod(sum((F.lit(a) * F.sin(F.radians(l * k)) for a, k in ANOMALY_TERMS), l), F.lit(360.0))


def screened(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(basis, kept) of stacked designs (window, date, column): an ordered factorisation that drops what depends on columns before.

    A column goes if it is shorter than 1e-10 or what those kept leave of it is at most 1e-4 of its length; basis has zeros in its place.
    """
    basis, kept = np.zeros_like(columns), np.zeros((columns.shape[0], columns.shape[2]), bool)
    for j in range(columns.shape[2]):
        v = columns[:, :, j]
        long = np.sqrt(np.einsum("wt,wt->w", v, v))
        left = v
        for _ in range(2 if j else 0):
            left = left - np.matmul(basis[:, :, :j], np.matmul(left[:, None], basis[:, :, :j]).transpose(0, 2, 1))[:, :, 0]
        rest = np.sqrt(np.einsum("wt,wt->w", left, left))
        kept[:, j] = (long >= 1e-10) & (rest > 1e-4 * long)
        basis[:, :, j] = np.where(kept[:, j, None], left / np.where(rest > 0, rest, 1.0)[:, None], 0.0)
    return basis, kept


def waves(turn: np.ndarray, basis: np.ndarray, live: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (window, term, response, cos and sin) of what is left of the responses on cos and sin of turns (window, date, term), and the sums of squares they explain."""
    across = basis.transpose(0, 2, 1)
    clean = lambda m: m - np.matmul(basis, np.matmul(across, m))
    c, s = clean(np.cos(turn) * live[:, :, None]), clean(np.sin(turn) * live[:, :, None])
    cc, cs, ss = (np.einsum("wtk,wtk->wk", a, b) for a, b in ((c, c), (c, s), (s, s)))
    right = np.stack([np.matmul(c.transpose(0, 2, 1), left), np.matmul(s.transpose(0, 2, 1), left)], -1)
    size, axes = np.linalg.eigh(np.stack([np.stack([cc, cs], -1), np.stack([cs, ss], -1)], -1))
    usable = size > 1e-9 * live.sum(axis=1)[:, None, None]  # what the nuisance leaves nothing of falls out
    inverse = np.where(usable, 1 / np.where(usable, size, 1.0), 0.0)
    b = np.matmul(right, np.matmul(axes * inverse[:, :, None, :], axes.transpose(0, 1, 3, 2)))
    return b, b[..., 0] * right[..., 0] + b[..., 1] * right[..., 1]


def stacked(series: DataFrame, keys, used, empty: bool = False) -> DataFrame:
    """(keys, _n, _own): a row for each window with its dates and columns in the order of dates, flat; dates with a null are left out, and windows without others unless `empty`.

    Windows are dealt to the session's shuffle partitions by a hash of their keys: their work is in solving, not in bytes, and Spark would
    otherwise put the few bytes of many windows into one task. Dealt by the keys themselves, the shuffle would be the group's own, which Spark coalesces.
    """
    names = ["_d", *[f"_{i}" for i in range(len(used))]]
    rows = series.select(*keys, F.col("day").cast("double").alias("_d"), *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(used)])
    if not empty:
        rows = rows.dropna(subset=names)
    whole = reduce(lambda a, c: a & F.col(c).isNotNull() & ~F.isnan(c), names, F.lit(True))
    windows = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(whole, F.struct(*names)))).alias("_own"))
    flat = windows.select(*keys, F.size("_own").cast("long").alias("_n"), F.flatten(F.transform("_own", lambda r: F.array(r["_d"], *[r[f"_{i}"] for i in range(len(used))]))).alias("_own"))
    return flat.repartition(int(series.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))


def unstacked(frame: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(values (window, date, column), live (window, date)) of rows of `stacked`; zeros follow a window's last date."""
    n = frame["_n"].to_numpy()
    wide = np.zeros((len(frame), max(int(n.max()), 1), width))
    live = np.arange(wide.shape[1]) < n[:, None]
    wide[live] = np.concatenate([np.asarray(own, float) for own in frame["_own"]]).reshape(-1, width)
    return wide, live


def nuisance(day: np.ndarray, mask: np.ndarray, coverage, degree: int, weekdays: bool) -> np.ndarray:
    """Designs (window, date, column): intercept, powers of the elapsed share of the window, weekdays from Tuesday on, coverage columns."""
    span = np.maximum((day * mask).max(axis=1) - day[:, 0], 1.0)
    t = (day - day[:, :1]) / span[:, None]
    columns = [t**p * mask for p in range(degree + 1)]
    if weekdays:
        columns += [(np.mod(day + 3, 7) == d) * mask for d in range(1, 7)]
    return np.stack([*columns, *coverage], -1)


def window_fits(series: DataFrame, periods=(), keys=("user_id", "window_index"), responses=("value",), coverage=(), phases=(), degree: int = 1, weekdays: bool = True) -> DataFrame:
    """(keys, response, period, phase, n, kept, dropped, available, zero_variance, explained, amplitude, angle): fits of each response of each window.

    Behind intercept, powers of the elapsed days up to `degree`, weekdays from Tuesday on and the coverage columns, in that order, a cosine and
    sine of each period (of days since 1970) and of each phase (a column of degrees by date) are fitted. All responses of a window share
    one projector. kept counts the nuisance columns, dropped names those that depend on earlier ones. A response that doesn't vary, before or behind the nuisance, has
    zero_variance 1; it isn't available then, nor with two dates or fewer more than columns, and the fit is null. Dates with a null in a
    column used are left out; a key's rows are one window of few dates.
    """
    keys, grid, responses, coverage, phases = list(keys), np.array([float(p) for p in periods]), list(responses), list(coverage), list(phases)
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    names = ["intercept", *(("trend", "trend_2", "trend_3")[:degree]), *(WEEKDAYS if weekdays else ()), *coverage]
    used = [*responses, *coverage, *phases]
    windows = stacked(series, keys, used)
    terms = [(float(p), None) for p in grid] + [(None, p) for p in phases]
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["response string, period double, phase string, n long, kept long, dropped string, available int, zero_variance int, explained double, amplitude double, angle double"])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        n, w = frame["_n"].to_numpy(), len(frame)
        wide, live = unstacked(frame, len(used) + 1)
        day, mask = wide[:, :, 0], live.astype(float)
        at = 1 + len(responses)
        basis, kept = screened(nuisance(day, mask, [wide[:, :, at + i] for i in range(len(coverage))], degree, weekdays))
        y = wide[:, :, 1:at]
        left = y - np.einsum("wtp,wpr->wtr", basis, np.einsum("wtp,wtr->wpr", basis, y))
        mean = y.sum(axis=1) / n[:, None]
        total, rest = (((y - mean[:, None]) * mask[:, :, None]) ** 2).sum(axis=1), (left**2).sum(axis=1)
        flat = (np.sqrt(total / n[:, None]) < 1e-6) | (rest <= 1e-12 * np.maximum(1.0, total))
        fine = ~flat & (n > kept.sum(axis=1) + 2)[:, None]
        turn = np.concatenate([2 * math.pi * day[:, :, None] / grid, np.radians(wide[:, :, at + len(coverage) :])], -1)
        b, gained = waves(turn, basis, mask, left)
        share = np.clip(gained / np.where(rest > 0, rest, 1.0)[:, None], 0.0, 1.0)
        many, count = len(terms), len(responses)
        spread = lambda v: np.repeat(v, many * count)
        by_response = lambda v: np.broadcast_to(v[:, None, :], (w, many, count)).reshape(-1)
        out = {key: frame[key].repeat(many * count).to_numpy() for key in keys}
        gone = [", ".join(c for c, ok in zip(names, row, strict=True) if not ok) for row in kept]
        out |= {"response": np.tile(responses, w * many), "period": np.tile(np.repeat([p for p, _ in terms], count), w), "phase": np.tile(np.repeat(np.array([p for _, p in terms], object), count), w), "n": spread(n), "kept": spread(kept.sum(axis=1)), "dropped": spread(np.array(gone, object)), "available": by_response(fine.astype(int)), "zero_variance": by_response(flat.astype(int))}
        hide = ~by_response(fine)
        for name, v in (("explained", share), ("amplitude", np.hypot(b[..., 0], b[..., 1])), ("angle", np.arctan2(b[..., 1], b[..., 0]))):
            out[name] = pd.array(np.where(hide, 0.0, v.reshape(-1)), "Float64")
            out[name][hide] = pd.NA
        out["period"] = pd.array([None if p is None else p for p in out["period"]], "Float64")
        return pd.DataFrame(out)

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), STACK):
                yield solve(frame.iloc[at : at + STACK])

    return windows.mapInPandas(run, schema)


def peaks(fits: DataFrame, low: float, high: float, keys=("user_id", "window_index", "response")) -> DataFrame:
    """(keys, available, zero_variance, peak_period, peak_share, peak_amplitude, band_mean) over periods from low to high.

    The peak is the largest share, the least period on ties; band_mean is the trapezoid mean of the share over frequencies.
    """
    keys = list(keys)
    inside = fits.where(F.col("period").between(low - 1e-9, high + 1e-9))
    own = F.sort_array(F.collect_list(F.when(F.col("explained").isNotNull(), F.struct((1 / F.col("period")).alias("f"), F.col("explained").alias("s")))))
    best = F.max_by(F.struct("period", "explained", "amplitude"), F.when(F.col("explained").isNotNull(), F.struct(F.round("explained", 12), -F.col("period"))))
    got = inside.groupBy(*keys).agg(F.max("available").alias("available"), F.max("zero_variance").alias("zero_variance"), best.alias("b"), own.alias("o"))
    steps = F.transform(F.sequence(F.lit(1), F.size("o") - 1), lambda i: (F.col("o")[i]["f"] - F.col("o")[i - 1]["f"]) * (F.col("o")[i]["s"] + F.col("o")[i - 1]["s"]) / 2)
    area = F.when(F.size("o") > 1, F.aggregate(steps, F.lit(0.0), lambda a, v: a + v) / (F.element_at("o", -1)["f"] - F.element_at("o", 1)["f"]))
    return got.select(*keys, "available", "zero_variance", F.col("b.period").alias("peak_period"), F.col("b.explained").alias("peak_share"), F.col("b.amplitude").alias("peak_amplitude"), area.alias("band_mean"))


def day_signals(grid: DataFrame, blocks: int = 4, bins: int = 8) -> DataFrame:
    """(user_id, day, p10, occupancy, block_0, ...) of each day of a full bin grid: the tenth percentile, and the observed share of the day and of each block of the clock."""
    seen = F.col("hr").isNotNull().cast("double")
    share = [F.avg(F.when(F.floor(F.col("bin") * blocks / bins) == b, seen)).alias(f"block_{b}") for b in range(blocks)]
    return grid.groupBy("user_id", "day").agg(F.percentile("hr", F.lit(0.1)).alias("p10"), F.avg(seen).alias("occupancy"), *share)


def recording_controls(days: DataFrame, windows: DataFrame, periods=NARROW) -> DataFrame:
    """22 controls of each window (user_id, window_index): level and trend of p10, clock coverage, span and longest gap, and the fits of the recording itself.

    days: day_signals; windows: user_id, window_index, start_day, end_day. Occupancy and night occupancy are fitted together behind trend and
    weekdays, p10 also behind the block shares; of these only the flags of p10 are controls. Gaps reach to the window's edges. A fit that
    isn't available has null amplitude, share and period.
    """
    keys, blocks = ["user_id", "window_index"], [c for c in days.columns if c.startswith("block_")]
    inside = days.select("user_id", "day", "p10", "occupancy", *blocks).join(windows.select(*keys, "start_day", "end_day"), "user_id").where(F.col("day").between(F.col("start_day"), F.col("end_day")) & F.col("p10").isNotNull())
    t = F.col("day").cast("double")
    order = F.sort_array(F.collect_list("day"))
    gaps = F.concat(F.array(F.col("_o")[0] - F.col("start_day"), F.col("end_day") - F.element_at("_o", -1)), F.transform(F.sequence(F.lit(1), F.size("_o") - 1), lambda i: F.col("_o")[i] - F.col("_o")[i - 1] - 1))
    own = inside.groupBy(*keys, "start_day", "end_day").agg(F.count("*").alias("_n"), F.avg("p10").alias("p10_mean"), F.stddev_samp("p10").alias("p10_sd"), F.regr_slope("p10", t).alias("p10_slope"), F.regr_syy("p10", t).alias("_yy"), F.regr_sxy("p10", t).alias("_xy"), *[F.avg(b).alias(f"{b}_mean") for b in blocks], order.alias("_o"))
    rest = F.when(F.col("_n") > 2, F.sqrt(F.greatest(F.col("_yy") - F.col("p10_slope") * F.col("_xy"), F.lit(0.0)) / (F.col("_n") - 2)))
    longest = F.array_max(F.when(F.size("_o") > 1, gaps).otherwise(F.array(F.col("_o")[0] - F.col("start_day"), F.col("end_day") - F.col("_o")[0])))
    plain = own.select(*keys, "p10_mean", "p10_sd", "p10_slope", rest.alias("p10_residual_sd"), *[f"{b}_mean" for b in blocks], (F.element_at("_o", -1) - F.col("_o")[0]).alias("span"), longest.alias("longest_gap"))
    night = inside.withColumn("night", F.col(blocks[0]))
    level = peaks(window_fits(inside, periods, keys, ["p10"], blocks), min(periods), max(periods)).select(*keys, F.col("available").alias("hr_available"), F.col("zero_variance").alias("hr_zero_variance"))
    both = peaks(window_fits(night, periods, keys, ["occupancy", "night"]), min(periods), max(periods))
    of = lambda name, c, out: F.max(F.when(F.col("response") == name, F.col(c))).alias(out)
    fits = both.groupBy(*keys).agg(*[of(r, c, f"{r}_{out}") for r in ("occupancy", "night") for c, out in (("peak_amplitude", "amplitude"), ("peak_share", "share"), ("peak_period", "period"), ("available", "available"), ("zero_variance", "zero_variance"))])
    return plain.join(level, keys).join(fits, keys)


def rotation_null(angles: DataFrame, groups, keys, rotations: int = 32, tag: str = "turn") -> DataFrame:
    """(groups, n, coherence, null_mean, null_max, p) of angles in radians: mean resultant length against that of seeded turns of each window.

    Turning a window's basis by an offset adds the offset to its angle, so no fit is repeated: a turn keeps data, dates and
    nuisance and breaks what phases have in common. p counts turns of at least the coherence, the data among them.
    """
    groups, keys = list(groups), list(keys)
    own = angles.where(F.col("angle").isNotNull()).select(*groups, *keys, "angle", F.explode(F.sequence(F.lit(0), F.lit(rotations))).alias("r"))
    draw = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(tag), *[F.col(k).cast("string") for k in keys], F.col("r").cast("string"))), 1, 8), 16, 10).cast("double") / 2.0**32
    at = F.col("angle") + F.when(F.col("r") > 0, 2 * math.pi * draw).otherwise(0.0)
    each = own.groupBy(*groups, "r").agg(F.count("*").alias("n"), F.hypot(F.avg(F.cos(at)), F.avg(F.sin(at))).alias("c"))
    first = F.max(F.when(F.col("r") == 0, F.col("c")))
    got = each.groupBy(*groups).agg(F.max("n").alias("n"), first.alias("coherence"), F.avg(F.when(F.col("r") > 0, F.col("c"))).alias("null_mean"), F.max(F.when(F.col("r") > 0, F.col("c"))).alias("null_max"), F.collect_list(F.when(F.col("r") > 0, F.col("c"))).alias("_c"))
    return got.select(*groups, "n", "coherence", "null_mean", "null_max", ((1 + F.size(F.filter("_c", lambda v: v >= F.col("coherence")))) / (1.0 + rotations)).alias("p"))
