"""Clock curves of participants and periods of window series behind nuisance terms.

Series here are short (24 hours, or the dates of one window), so a task solves stacks of them with numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators.inference import ols_hc3
from tidewell.operators.spectra import STACK, stacked, unstacked, waves

#: Most dates times terms of the windows solved together.
CELLS = 1 << 20


def curve_features(hours: DataFrame, keys=("user_id",)) -> DataFrame:
    """Of the hourly curve (n, vsum by hour): night mean, day less night, weighted morning slope, range, entropy above the lowest hour."""
    g = hours.groupBy(*keys, "hour").agg(F.sum("n").alias("n"), F.sum("vsum").alias("vsum")).where("n > 0").withColumn("m", F.col("vsum") / F.col("n"))
    part = lambda lo, hi, v: F.sum(F.when(F.col("hour").between(lo, hi), v))
    n, h = F.col("n"), F.col("hour").cast("double") - 7  # about the middle of the morning, whose products stay small
    out = g.groupBy(*keys).agg(
        F.try_divide(part(0, 5, F.col("vsum")), part(0, 5, n)).alias("night_mean"), F.try_divide(part(8, 19, F.col("vsum")), part(8, 19, n)).alias("_day"), F.max("m").alias("_hi"), F.min("m").alias("_lo"), F.sum("m").alias("_sum"), F.count("*").alias("hours"),
        F.count_if(F.col("hour").between(5, 9)).alias("_k"), part(5, 9, n).alias("_n"), part(5, 9, n * h).alias("_x"), part(5, 9, F.col("vsum")).alias("_y"), part(5, 9, n * h * h).alias("_xx"), part(5, 9, h * F.col("vsum")).alias("_xy"), F.collect_list("m").alias("_ms"),
    )
    c = F.col
    slope = F.when(c("_k") >= 2, fn.steady((c("_n") * c("_xy") - c("_x") * c("_y")) / F.nullif(c("_n") * c("_xx") - c("_x") * c("_x"), F.lit(0.0)), 12))
    mass = c("_sum") - c("hours") * c("_lo")
    # At most 24 values: the entropy of each hour's share of what lies above the lowest one.
    entropy = F.aggregate("_ms", F.lit(0.0), lambda a, v: a - F.when(v > c("_lo"), (v - c("_lo")) / mass * F.log((v - c("_lo")) / mass)).otherwise(0.0))
    return out.select(*keys, "hours", "night_mean", (c("_day") - c("night_mean")).alias("day_night"), slope.alias("morning_slope"), (c("_hi") - c("_lo")).alias("range"), F.when(mass > 1e-12, entropy).otherwise(0.0).alias("entropy"))


def circadian_24h(hours: DataFrame, keys=("user_id",)) -> DataFrame:
    """Weighted fit of three harmonics of 24 hours to each key's hourly means, least-norm where hours are missing, beside curve_features."""
    def clock_fit(n: pd.Series, total: pd.Series) -> pd.DataFrame:
        def waves(h: np.ndarray) -> np.ndarray:
            turns = 2 * np.pi * np.outer(h, np.arange(1, 4)) / 24
            return np.column_stack([np.ones(len(h))] + [f(turns[:, k]) for k in range(3) for f in (np.cos, np.sin)])

        w, s = (np.array([list(v) for v in c], dtype=float).reshape(-1, 24) for c in (n, total))
        y = np.divide(s, w, out=np.zeros_like(s), where=w > 0)
        basis, fine, root = waves(np.arange(24.0)), np.arange(0, 24, 0.25), np.sqrt(w)
        coef = np.einsum("upk,uk->up", np.linalg.pinv(root[:, :, None] * basis, rcond=1e-10), root * y)
        left = np.sqrt(np.sum(w * (y - coef @ basis.T) ** 2, axis=1) / np.maximum(w.sum(axis=1), 1e-9))
        swing = np.hypot(coef[:, 1::2], coef[:, 2::2])
        peak = fine[np.argmax(np.round(coef @ waves(fine).T, 9), axis=1)]
        return pd.DataFrame({"level": coef[:, 0], "amplitude_1": swing[:, 0], "amplitude_2": swing[:, 1], "amplitude_3": swing[:, 2], "peak_hour": peak, "residual_sd": left})

    solve = F.pandas_udf(clock_fit, "level double, amplitude_1 double, amplitude_2 double, amplitude_3 double, peak_hour double, residual_sd double")
    at = lambda c: F.array(*[F.coalesce(F.sum(F.when(F.col("hour") == h, F.col(c))), F.lit(0)).cast("double") for h in range(24)])
    rows = hours.where("n > 0").groupBy(*keys).agg(at("n").alias("_n"), at("vsum").alias("_s"))
    fit = rows.select(*keys, solve("_n", "_s").alias("f")).select(*keys, "f.*")
    return fit.join(curve_features(hours, keys), list(keys))


def nuisance_spectrum(series: DataFrame, periods, keys=("user_id", "window_index"), covariates=(), degree: int = 1, weekdays: bool = True) -> DataFrame:
    """Share of a window's variance that each period explains behind intercept, trend, weekdays and covariates.

    A row for each key and period: n, explained, amplitude, angle. Terms that depend on others, such as those of a
    weekday that never occurs, fall out by rank. explained is null for a series without variance behind the nuisance.
    """
    keys, grid, extra = list(keys), [float(p) for p in periods], list(covariates)
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["period double", "n long", "explained double", "amplitude double", "angle double"])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        n = frame["_n"].to_numpy()
        wide, live = unstacked(frame, 2 + len(extra))
        mask, day, y = live.astype(float), wide[:, :, 0], wide[:, :, 1]
        basis, rank = spanned([*trend(day, live, n, degree), *[wide[:, :, 2 + i] for i in range(len(extra))], *(weekday_columns(day, mask) if weekdays else ())])
        left = y[:, :, None] - np.matmul(basis, np.matmul(basis.transpose(0, 2, 1), y[:, :, None]))
        total, size = (left[:, :, 0] ** 2).sum(axis=1), (y * y).sum(axis=1)
        fine = (n > rank + 2) & (total > 1e-12 * np.maximum(size, 1e-300))
        b, gained = waves(2 * math.pi * day[:, :, None] / np.array(grid), basis, mask, left)
        b, many = b[:, :, 0] + 0.0, len(grid)  # no negative zeros
        out = {k: frame[k].repeat(many).to_numpy() for k in keys} | {"period": np.tile(grid, len(frame)), "n": np.repeat(n, many)}
        for name, v in (("explained", gained[:, :, 0] / np.where(total > 0, total, 1.0)[:, None] + 0.0), ("amplitude", np.hypot(b[..., 0], b[..., 1])), ("angle", np.arctan2(b[..., 1], b[..., 0]))):
            out[name] = optional(v.reshape(-1), np.repeat(fine, many))
        return pd.DataFrame(out)

    return in_stacks(series, keys, ["value", *extra], len(grid), solve, schema)


def in_stacks(series: DataFrame, keys, used, terms: int, solve, schema: str) -> DataFrame:
    """`solve` over frames of `stacked` windows, those without values too: STACK of them at a time, or fewer long ones."""

    def run(frames):
        for frame in frames:
            most = int(min(STACK, max(1, CELLS // (max(int(frame["_n"].max()), 1) * terms))))
            for at in range(0, len(frame), most):
                yield solve(frame.iloc[at : at + most])

    return stacked(series, keys, used, empty=True).mapInPandas(run, schema)


def trend(day: np.ndarray, live: np.ndarray, n: np.ndarray, degree: int) -> list[np.ndarray]:
    """Powers from 0 to `degree` of days about a window's mean, over its span; zero beyond its dates."""
    span = np.where(live, day, -np.inf).max(axis=1) - np.where(live, day, np.inf).min(axis=1)
    t = (day - (day.sum(axis=1) / np.maximum(n, 1))[:, None]) / np.maximum(span, 1.0)[:, None]
    return [np.where(live, t**d, 0.0) for d in range(degree + 1)]


def weekday_columns(day: np.ndarray, mask: np.ndarray) -> list[np.ndarray]:
    return [(np.mod(day + 3, 7) == d) * mask for d in range(1, 7)]


def spanned(columns) -> tuple[np.ndarray, np.ndarray]:
    """(basis, rank) of what columns (window, date) span in each window, by singular values above 1e-9 of the largest."""
    u, size, _ = np.linalg.svd(np.stack(columns, -1), full_matrices=False)
    kept = size > 1e-9 * np.maximum(size.max(axis=1, initial=0.0), 1e-300)[:, None]
    return u * kept[:, None, :], kept.sum(axis=1)


def optional(values: np.ndarray, there: np.ndarray):
    """Numbers, null where they aren't there."""
    out = pd.array(np.where(there, values, 0.0), "Float64")
    out[~there] = pd.NA
    return out


def band_summary(spectrum: DataFrame, low: float, high: float, keys=("user_id", "window_index")) -> DataFrame:
    """Peak period, its share and amplitude within a band, and the band's mean share by trapezoids."""
    w = Window.partitionBy(*keys).orderBy("period")
    inside = spectrum.where(F.col("explained").isNotNull() & F.col("period").between(low, high))
    area = (F.col("period") - F.lag("period").over(w)) * (F.col("explained") + F.lag("explained").over(w)) / 2
    best = F.max_by(F.struct("period", "explained", "amplitude"), F.struct(F.round("explained", 9), -F.col("period"))).alias("b")
    out = inside.withColumn("_a", area).groupBy(*keys).agg(best, F.try_divide(F.sum("_a"), F.max("period") - F.min("period")).alias("band_mean"))
    return out.select(*keys, F.col("b.period").alias("peak_period"), F.col("b.explained").alias("peak_share"), F.col("b.amplitude").alias("peak_amplitude"), "band_mean")


def partial_r2(series: DataFrame, period: float, keys=("user_id", "window_index")) -> DataFrame:
    """What weekdays, then a period, add to R2 over intercept and trend, from nested fits of each window."""
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["n long", "r2_trend double", "r2_weekdays double", "r2_period double"])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        n = frame["_n"].to_numpy()
        wide, live = unstacked(frame, 2)
        mask, day, y = live.astype(float), wide[:, :, 0], wide[:, :, 1]
        turn = 2 * math.pi * day / period
        blocks = [[mask], trend(day, live, n, 1)[1:], weekday_columns(day, mask), [np.cos(turn) * mask, np.sin(turn) * mask]]
        rss = []
        for i in range(len(blocks)):
            basis, _ = spanned([c for b in blocks[: i + 1] for c in b])
            rss.append(((y[:, :, None] - np.matmul(basis, np.matmul(basis.transpose(0, 2, 1), y[:, :, None])))[:, :, 0] ** 2).sum(axis=1))
        some = rss[0] > 1e-12
        part = [optional((a - b) / np.where(some, rss[0], 1.0), some) for a, b in zip(rss, rss[1:])]
        return pd.DataFrame({k: frame[k].to_numpy() for k in keys} | {"n": n} | dict(zip(("r2_trend", "r2_weekdays", "r2_period"), part, strict=True)))

    return in_stacks(series, keys, ["value"], 10, solve, schema)


def frozen_forecast(fitted: DataFrame, later: DataFrame, period: float) -> DataFrame:
    """Correlation of window 2's residuals with window 1's wave carried on in calendar phase; fitted has amplitude and phase by user."""
    wave = F.col("amplitude") * F.cos(2 * math.pi * F.col("day") / period - F.col("phase"))
    return later.join(fitted.select("user_id", "amplitude", "phase"), "user_id").withColumn("_w", wave).groupBy("user_id").agg(F.count("*").alias("n"), F.corr("_w", "residual").alias("r"))


def calendar_phase(powers: DataFrame) -> DataFrame:
    """The day of its period, from day 0 on, at which each wave peaks."""
    return powers.withColumn("peak_day", F.pmod(F.col("phase") / (2 * math.pi) * F.col("period"), F.col("period")))


def coverage_residuals(rows: DataFrame, train: DataFrame, features, on) -> DataFrame:
    """Each feature less what its regression on the coverage columns, fitted on train, predicts."""
    out = rows
    for f in features:
        beta = {r.term: r.estimate for r in ols_hc3(train, f, on)[0].collect()}  # one row for each term
        fit = sum((F.col(c).cast("double") * beta.get(c, 0.0) for c in on), F.lit(beta.get("intercept", 0.0)))
        out = out.withColumn(f"{f}_residual", F.col(f) - fit)
    return out
