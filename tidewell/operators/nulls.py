"""Null replicates of window spectra: a covariance of two decays fitted by restricted likelihood, series drawn from it, and what the spectrum exceeds.

The likelihood of a window runs through a Kalman filter of two states, so a candidate costs as many steps as there are dates, and
all candidates of all windows of a batch take each step together; no matrix of dates by dates is built.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidewell.operators.spectra import BROAD, NARROW, nuisance, screened, stacked, unstacked, waves

#: Decay a day of the slow part, and the most of the fast part.
SLOW, FASTEST = (0.98, 0.995), 0.95
#: Windows and candidates that take a step together.
STACK, LANES = 16, 2048
#: A grid of GRID x GRID shares and decays for each slow decay, then ROUNDS grids of 5 x 5 about the best, each of half the spacing.
GRID, ROUNDS = 9, 10
EDGE = 1e-3


def gram(day: np.ndarray, live: np.ndarray, columns: np.ndarray, share: np.ndarray, fast: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(products, logdet) of columns (window, date, column) under R = share * fast^|t-u| + (1 - share) * slow^|t-u|.

    share, fast and slow are (window, candidate). products (window, candidate, column, column) is columns' R^-1 columns, logdet
    is log |R|. Each column is filtered by the same gains; its innovations over their deviation are the whitened column.
    """
    w, t, c = columns.shape
    k = share.shape[1]
    a, b, cross = share.copy(), 1 - share, np.zeros((w, k))
    m1, m2 = np.zeros((w, k, c)), np.zeros((w, k, c))
    white, logdet = np.zeros((w, k, t, c)), np.zeros((w, k))
    for i in range(t):
        on = live[:, i, None]
        if i:
            gap = np.where(live[:, i], day[:, i] - day[:, i - 1], 0.0)[:, None]
            d1, d2 = fast**gap, slow**gap
            a, b, cross = d1 * d1 * a + share * (1 - d1 * d1), d2 * d2 * b + (1 - share) * (1 - d2 * d2), d1 * d2 * cross
            m1, m2 = d1[..., None] * m1, d2[..., None] * m2
        f = np.where(on, np.maximum(a + b + 2 * cross, 1e-300), 1.0)
        g1, g2 = np.where(on, (a + cross) / f, 0.0), np.where(on, (b + cross) / f, 0.0)
        step = np.where(on[..., None], columns[:, None, i] - m1 - m2, 0.0)
        white[:, :, i] = step / np.sqrt(f)[..., None]
        logdet += np.log(f)
        m1, m2 = m1 + g1[..., None] * step, m2 + g2[..., None] * step
        a, b, cross = a - g1 * g1 * f, b - g2 * g2 * f, cross - g1 * g2 * f
    return np.matmul(white.transpose(0, 1, 3, 2), white), logdet


def restricted(day: np.ndarray, live: np.ndarray, y: np.ndarray, basis: np.ndarray, kept: np.ndarray, share: np.ndarray, fast: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(negative restricted log likelihood without its constant, variance) of y (window, date) behind an orthonormal basis, at candidates (window, candidate); the variance is the best one."""
    nll, variance = np.empty(share.shape), np.empty(share.shape)
    own, left = np.concatenate([y[:, :, None], basis], -1), np.maximum(live.sum(axis=1) - kept.sum(axis=1), 1)[:, None]
    many = max(1, LANES // len(y))
    for at in range(0, share.shape[1], many):
        part = slice(at, at + many)
        g, logdet = gram(day, live, own, share[:, part], fast[:, part], slow[:, part])
        x = g[..., 1:, 1:] + np.eye(basis.shape[2]) * ~kept[:, None, :, None]
        rest = g[..., 0, 0] - np.einsum("wkp,wkp->wk", g[..., 0, 1:], np.linalg.solve(x, g[..., 1:, :1])[..., 0])
        variance[:, part] = np.maximum(rest, 1e-300) / left
        nll[:, part] = 0.5 * (logdet + np.linalg.slogdet(x)[1] + left * (np.log(variance[:, part]) + 1))
    return nll, variance


def fit_decays(day: np.ndarray, live: np.ndarray, y: np.ndarray, basis: np.ndarray, kept: np.ndarray) -> dict[str, np.ndarray]:
    """v1, phi1, v2, phi2 and nll of each window: the least restricted likelihood over share, fast decay (below 0.95) and the two slow decays."""
    w = len(y)
    low, high = np.array([EDGE, EDGE]), np.array([1 - EDGE, FASTEST - EDGE])
    axes = [np.linspace(a, b, GRID) for a, b in zip(low, high, strict=True)]
    first = np.stack([m.ravel() for m in np.meshgrid(*axes, indexing="ij")], -1)
    spread = np.stack([m.ravel() for m in np.meshgrid(*[np.arange(-2, 3) / 2] * 2, indexing="ij")], -1)
    best = None
    for slow in SLOW:
        at, step = np.broadcast_to(first, (w, *first.shape)), (high - low) / (GRID - 1)
        for _ in range(ROUNDS + 1):
            nll, variance = restricted(day, live, y, basis, kept, at[..., 0], at[..., 1], np.full(at.shape[:2], slow))
            i, rows = nll.argmin(axis=1), np.arange(w)
            mine = np.column_stack([at[rows, i], variance[rows, i], nll[rows, i], np.full(w, slow)])
            at, step = np.clip(mine[:, None, :2] + spread * step, low, high), step / 2
        best = mine if best is None else np.where((mine[:, 3] < best[:, 3])[:, None], mine, best)
    share, fast, variance, nll, slow = best.T
    return {"v1": share * variance, "phi1": fast, "v2": (1 - share) * variance, "phi2": slow, "nll": nll}


def draw_series(day: np.ndarray, live: np.ndarray, fit: dict[str, np.ndarray], seeds, replicates: int) -> np.ndarray:
    """Series (window, date, replicate) with the fitted covariance, zero after a window's last date; a window's draws depend on its seed alone."""
    w, t = day.shape
    out = np.zeros((w, t, replicates))
    noise = np.zeros((w, 2, t, replicates))
    for i, seed in enumerate(seeds):
        n = int(live[i].sum())
        noise[i, :, :n] = np.random.Generator(np.random.PCG64(seed)).standard_normal((2, n, replicates))
    for j, (v, phi) in enumerate((("v1", "phi1"), ("v2", "phi2"))):
        size, x = np.sqrt(fit[v]), None
        for k in range(t):
            if k == 0:
                x = size[:, None] * noise[:, j, 0]
            else:
                d = fit[phi] ** np.where(live[:, k], day[:, k] - day[:, k - 1], 0.0)
                x = d[:, None] * x + (size * np.sqrt(np.maximum(0.0, 1 - d * d)))[:, None] * noise[:, j, k]
            out[:, k] += np.where(live[:, k, None], x, 0.0)
    return out


def seed_of(tag: str, key) -> int:
    return int.from_bytes(hashlib.sha256("|".join([tag, *map(str, key)]).encode()).digest()[:8], "little")


def shares(day: np.ndarray, live: np.ndarray, basis: np.ndarray, left: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(explained, amplitude) (window, period, response) of what the nuisance leaves of responses."""
    b, gained = waves(2 * math.pi * day[:, :, None] / periods, basis, live.astype(float), left)
    rest = (left**2).sum(axis=1)
    return np.clip(gained / np.maximum(rest, 1e-12)[:, None], 0.0, 1.0), np.hypot(b[..., 0], b[..., 1])


def behind(basis: np.ndarray, mask: np.ndarray, v: np.ndarray) -> np.ndarray:
    """What a basis leaves of responses (window, date, response), on live dates."""
    return (v - np.einsum("wtp,wpr->wtr", basis, np.einsum("wtp,wtr->wpr", basis, v))) * mask[:, :, None]


def null_endpoints(series: DataFrame, keys=("user_id", "window_index"), value: str = "value", coverage=(), band=(25.0, 35.0), replicates: int = 199, broad=tuple(BROAD), narrow=tuple(NARROW), degree: int = 1, weekdays: bool = True, tag: str = "null") -> DataFrame:
    """A row for each window: the fitted covariance, and what its spectrum holds beyond that of seeded series of this covariance.

    status is ok, few_dates (two or fewer more than nuisance columns) or flat (no variance before or behind the nuisance); other columns
    than n and kept are null then. v1, phi1, v2, phi2, nll: the fit. band_excess is the trapezoid mean over frequencies of the band of explained less its mean over
    replicates, band_excess_se the error of that mean. peak_share is the most of `narrow`, peak_period the least such period and peak_amplitude its
    amplitude; null_peak is the replicates' mean peak, peak_excess the difference and p counts replicates that reach it, the data among them.
    spectrum, null_mean and null_variance are arrays over `broad`. Nuisance terms are those of window_fits. Dates with a null in a column
    used are left out. Seeds are hashes of the keys, so a task that runs again draws the same series; it solves STACK windows at a time.
    """
    keys, coverage = list(keys), list(coverage)
    wide_periods, narrow_periods = np.sort(np.array(broad, float))[::-1], np.sort(np.array(narrow, float))
    frequency = 1 / wide_periods
    inside = (wide_periods >= band[0] - 1e-9) & (wide_periods <= band[1] + 1e-9)
    if inside.sum() < 2 or replicates < 2:
        raise ValueError("the band needs two periods of `broad`, and two replicates")
    kinds = {f.name: f.dataType.simpleString() for f in series.schema}
    numbers = ["v1", "phi1", "v2", "phi2", "nll", "band_excess", "band_excess_se", "peak_period", "peak_share", "peak_amplitude", "null_peak", "peak_excess", "p"]
    curves = ["spectrum", "null_mean", "null_variance"]
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["n long, kept long, status string", *[f"{c} double" for c in numbers], *[f"{c} array<double>" for c in curves]])
    over = lambda v: np.trapezoid(v[:, inside], frequency[inside], axis=1) / (frequency[inside][-1] - frequency[inside][0])

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        wide, live = unstacked(frame, 2 + len(coverage))
        day, mask, y = wide[:, :, 0], live.astype(float), wide[:, :, 1]
        n = live.sum(axis=1)
        basis, kept = screened(nuisance(day, mask, [wide[:, :, 2 + i] for i in range(len(coverage))], degree, weekdays))
        left = behind(basis, mask, y[:, :, None])
        total, rest = ((y - (y.sum(axis=1) / n)[:, None]) ** 2 * mask).sum(axis=1), (left[:, :, 0] ** 2).sum(axis=1)
        flat = (np.sqrt(total / n) < 1e-6) | (rest <= 1e-12 * np.maximum(1.0, total))
        few = n <= kept.sum(axis=1) + 2
        out = {k: frame[k].to_numpy() for k in keys} | {"n": n, "kept": kept.sum(axis=1), "status": np.where(few, "few_dates", np.where(flat, "flat", "ok"))}
        ok = np.flatnonzero(~few & ~flat)
        made = {c: np.full(len(frame), None, object) for c in [*numbers, *curves]}
        if len(ok):
            day, live, basis, kept, left = day[ok], live[ok], basis[ok], kept[ok], left[ok]
            fit = fit_decays(day, live, left[:, :, 0], basis, kept)
            names = frame[keys].iloc[ok].itertuples(index=False, name=None)
            all_ = np.concatenate([left, behind(basis, mask[ok], draw_series(day, live, fit, [seed_of(tag, k) for k in names], replicates))], -1)
            seen, _ = shares(day, live, basis, all_, wide_periods)
            mean, variance = seen[..., 1:].mean(axis=-1), seen[..., 1:].var(axis=-1, ddof=1)
            each = over(seen.transpose(0, 2, 1).reshape(-1, len(wide_periods))).reshape(len(ok), -1)
            near, amplitude = shares(day, live, basis, all_, narrow_periods)
            best = np.round(near[..., 0], 12).argmax(axis=1)
            at, top = np.arange(len(ok)), near.max(axis=1)
            got = fit | {
                "band_excess": each[:, 0] - each[:, 1:].mean(axis=1), "band_excess_se": each[:, 1:].std(axis=1, ddof=1) / math.sqrt(replicates), "peak_period": narrow_periods[best], "peak_share": top[:, 0],
                "peak_amplitude": amplitude[at, best, 0], "null_peak": top[:, 1:].mean(axis=1), "peak_excess": top[:, 0] - top[:, 1:].mean(axis=1), "p": (1 + (top[:, 1:] >= top[:, :1]).sum(axis=1)) / (1 + replicates),
            }
            for c in numbers:
                made[c][ok] = got[c]
            for c, v in zip(curves, (seen[..., 0], mean, variance), strict=True):
                made[c][ok] = [list(map(float, r)) for r in v]
        out |= {c: pd.array(made[c], "Float64") for c in numbers} | {c: made[c] for c in curves}
        return pd.DataFrame(out)

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), STACK):
                yield solve(frame.iloc[at : at + STACK])

    return stacked(series, keys, [value, *coverage]).mapInPandas(run, schema)
