"""Stacked fits of windows, recording controls, moon phases and the rotation null against plain versions."""

from __future__ import annotations

import hashlib
import math
from datetime import date

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from tidewell.operators import harmonics, spectra as sc
from tidewell.plans import harmonic_queries as hq
from tidewell.plans import registry

KEYS = ("user_id", "window_index")


def fit_plain(rows, response, coverage, angles, degree=1, weekdays=True):
    """(n, kept, dropped, available, zero variance, [(share, amplitude, angle)]) of one window, column by column and angle by angle; rows are (day, {name: value})."""
    rows = sorted((r for r in rows if r[1][response] is not None and all(r[1][c] is not None for c in coverage)), key=lambda r: r[0])
    day, y = np.array([r[0] for r in rows], float), np.array([r[1][response] for r in rows], float)
    n = len(day)
    t = (day - day[0]) / max(np.ptp(day), 1.0)
    cols = [(["intercept", "trend", "trend_2", "trend_3"][p], t**p) for p in range(degree + 1)]
    if weekdays:
        cols += [(name, ((day + 3) % 7 == d).astype(float)) for d, name in enumerate(sc.WEEKDAYS, 1)]
    cols += [(c, np.array([r[1][c] for r in rows], float)) for c in coverage]
    kept, dropped = np.zeros((n, 0)), []
    for name, v in cols:
        rest = v - kept @ np.linalg.lstsq(kept, v, rcond=1e-10)[0] if kept.shape[1] else v
        if np.linalg.norm(v) >= 1e-10 and np.linalg.norm(rest) > 1e-4 * np.linalg.norm(v):
            kept = np.column_stack([kept, v])
        else:
            dropped.append(name)
    rss = lambda m: float(np.sum((y - m @ np.linalg.lstsq(m, y, rcond=1e-10)[0]) ** 2))
    flat = y.std() < 1e-6 or rss(kept) <= 1e-12 * max(1.0, float(np.sum((y - y.mean()) ** 2)))
    fine = not flat and n > kept.shape[1] + 2
    out = []
    for of_row in angles:
        a = np.array([of_row(d, r) for d, r in rows])
        full = np.column_stack([kept, np.cos(a), np.sin(a)])
        b = np.linalg.lstsq(full, y, rcond=1e-10)[0]
        clean = np.linalg.matrix_rank(full, 1e-7) == full.shape[1]
        out.append((1 - rss(full) / rss(kept), np.hypot(*b[-2:]), np.arctan2(b[-1], b[-2]), clean) if fine else None)
    return n, kept.shape[1], ", ".join(dropped), int(fine), int(flat), out


def windows_of(rows, columns):
    out = {}
    for r in rows:
        out.setdefault((r.user_id, r.window_index), []).append((r.day, {c: r[c] for c in columns}))
    return out


def assert_fits(got, own, responses, coverage, periods, phases=(), **how):
    angles = [lambda d, r, p=p: 2 * math.pi * d / p for p in periods] + [lambda d, r, c=c: math.radians(r[c]) for c in phases]
    by = {}
    for r in got:
        by.setdefault((r.user_id, r.window_index, r.response), {})[r.period if r.phase is None else r.phase] = r
    assert set(by) == {(*k, r) for k in own for r in responses}
    for (user, window, response), rows in by.items():
        n, kept, dropped, fine, flat, want = fit_plain(own[user, window], response, coverage, angles, **how)
        for at, w in zip([*periods, *phases], want, strict=True):
            r = rows[at]
            assert (r.n, r.kept, r.dropped, r.available, r.zero_variance) == (n, kept, dropped, fine, flat), (user, response)
            assert (r.explained is None) == (w is None) == (r.amplitude is None)
            if w is not None and w[3]:
                assert r.explained == pytest.approx(w[0], abs=1e-6) and r.amplitude == pytest.approx(w[1], rel=1e-5, abs=1e-7)
                assert abs(np.exp(1j * r.angle) - np.exp(1j * w[2])) < 1e-4 or w[1] < 1e-6


def test_fits_behind_coverage(spark):
    """Ordered dropping of columns, short and flat windows, several responses, nulls, phases beside periods."""
    rng = np.random.default_rng(0)
    rows = []
    for user in range(70):
        days = np.sort(rng.choice(180, [2, 9, 40, 90][user % 4], replace=False)) + 19_000
        if user % 5 == 0:
            days = days // 7 * 7  # one weekday only; repeated dates
        for d in days.tolist():
            a, b = rng.random(2).tolist()
            rows.append((user, 1, d, 5.0 if user == 7 else float(np.cos(2 * np.pi * d / 28) + rng.normal()), float(a), a if user % 3 else 0.0, 1.0 - a, float(rng.random()) if rng.random() < 0.95 else None, float(360 * b)))
    names = ["user_id", "window_index", "day", "value", "other", "c1", "c2", "c3", "moon"]
    df = spark.createDataFrame(rows, "user_id long, window_index long, day long, value double, other double, c1 double, c2 double, c3 double, moon double").repartition(3)
    got = sc.window_fits(df, [7.0, 13.5, 28.0], responses=["value", "other"], coverage=["c1", "c2", "c3"], phases=["moon"]).collect()
    own = windows_of(df.collect(), names[3:])
    own = {k: [r for r in v if r[1]["c3"] is not None] for k, v in own.items()}
    assert_fits(got, own, ["value", "other"], ["c1", "c2", "c3"], [7.0, 13.5, 28.0], ["moon"])
    assert {r.dropped for r in got} >= {"c1", "c2"} and {r.zero_variance for r in got} == {0, 1} == {r.available for r in got}
    cubic = sc.window_fits(df, [28.0], degree=3, weekdays=False).collect()
    assert_fits(cubic, windows_of(df.collect(), ["value"]), ["value"], [], [28.0], degree=3, weekdays=False)
    assert sc.window_fits(df.where("false"), [28.0]).collect() == []


def test_registered_spectra(spark):
    days = hq.first_days(spark, SF).withColumn("night", F.col("block_0"))
    own = windows_of(days.collect(), ["p10", "occupancy", "night", *hq.quarters])
    some = {k: own[k] for k in sorted(own)[:12]}
    fits = sc.window_fits(days, sc.BROAD, responses=["p10"], coverage=hq.quarters).collect()
    assert len(fits) == 231 * len(own)
    assert_fits([r for r in fits if (r.user_id, r.window_index) in some], some, ["p10"], hq.quarters, sc.BROAD)
    names = {r.period for r in registry.QUERIES["nuisance_spectrum"](spark, SF).select("period").distinct().collect()}
    assert sorted(names) == pytest.approx(sorted(sc.BROAD), abs=1e-6)
    recording = sc.window_fits(days, sc.NARROW, responses=["occupancy", "night"]).collect()
    assert_fits([r for r in recording if (r.user_id, r.window_index) in some], some, ["occupancy", "night"], [], sc.NARROW)
    got = {(r.user_id, r.window_index): r for r in registry.QUERIES["narrow_spectrum"](spark, SF).collect()}
    for k in some:
        mine = sorted((r for r in sc.window_fits(days.where(F.col("user_id") == k[0]), sc.NARROW, responses=["p10"], coverage=hq.quarters).collect()), key=lambda r: r.period) if k == min(some) else None
        if mine and mine[0].available:
            f, s = 1 / np.array([r.period for r in mine]), np.array([r.explained for r in mine])
            assert got[k].band_mean == pytest.approx(np.trapezoid(s[::-1], f[::-1]) / (1 / 25 - 1 / 35), abs=1e-5)
            assert (got[k].peak_period, got[k].peak_share) == (mine[int(s.argmax())].period, pytest.approx(s.max(), abs=1e-5))


def test_recording_controls(spark):
    days = hq.first_days(spark, SF).withColumn("night", F.col("block_0"))
    own = windows_of(days.collect(), ["p10", "occupancy", "night", *hq.quarters])
    got = {(r.user_id, r.window_index): r for r in registry.QUERIES["q_controls"](spark, SF).collect()}
    assert set(got) == set(own) and len(next(iter(got.values()))) == 24
    angles = [lambda d, r, p=p: 2 * math.pi * d / p for p in sc.NARROW]
    for k, rows in list(own.items())[:15]:
        r, rows = got[k], sorted(rows, key=lambda x: x[0])
        d, y = np.array([x[0] for x in rows], float), np.array([x[1]["p10"] for x in rows])
        slope, cut = np.polyfit(d - d[0], y, 1)
        left = y - cut - slope * (d - d[0])
        gaps = [0, d[0] + 179 - d[-1], *(np.diff(d) - 1)]
        assert (r.p10_mean, r.p10_sd, r.p10_slope, r.p10_residual_sd) == tuple(pytest.approx(v, abs=2e-5) for v in (y.mean(), y.std(ddof=1), slope, math.sqrt((left**2).sum() / (len(d) - 2))))
        assert [r[f"{b}_mean"] for b in hq.quarters] == [pytest.approx(np.mean([x[1][b] for x in rows]), abs=1e-5) for b in hq.quarters]
        assert (r.span, r.longest_gap) == (d[-1] - d[0], max(gaps))
        _, _, _, fine, flat, _ = fit_plain(rows, "p10", hq.quarters, [])
        assert (r.hr_available, r.hr_zero_variance) == (fine, flat)
        for name in ("occupancy", "night"):
            _, _, _, fine, flat, want = fit_plain(rows, name, [], angles)
            assert (r[f"{name}_available"], r[f"{name}_zero_variance"]) == (fine, flat)
            if fine and all(w[3] for w in want):
                best = max(range(21), key=lambda i: (round(want[i][0], 9), -i))
                assert r[f"{name}_share"] == pytest.approx(want[best][0], abs=1e-5)
                if sorted(w[0] for w in want)[-2] < want[best][0] - 1e-6:
                    assert (r[f"{name}_period"], r[f"{name}_amplitude"]) == (sc.NARROW[best], pytest.approx(want[best][1], rel=1e-3, abs=1e-5))


def test_moon(spark):
    """New and full moons of the year 2000 (dates and hours of public almanacs); anomalies a month apart are the same."""
    at = lambda m, d, h: (date(2000, m, d) - date(1970, 1, 1)).days + h / 24
    new, full = [at(1, 6, 18.2), at(2, 5, 13.1), at(7, 31, 2.4)], [at(1, 21, 4.7), at(7, 16, 13.9)]
    days = spark.createDataFrame([(d,) for d in new + full], "day double")
    got = [r.e for r in days.select(sc.lunar_elongation(F.col("day")).alias("e")).collect()]
    assert all(min(e, 360 - e) < 0.6 for e in got[:3]) and all(abs(e - 180) < 0.6 for e in got[3:])
    noon = at(1, 1, 12)  # from which centuries count, so polynomials are their first terms there
    mean = math.radians(134.9633964)
    want = 134.9633964 + 6.289 * math.sin(mean) + 1.274 * math.sin(2 * mean) + 0.658 * math.sin(3 * mean) + 0.214 * math.sin(4 * mean)
    month = 27.55455  # days from perigee to perigee, in the mean
    got = [r.a for r in spark.createDataFrame([(noon + k * month,) for k in range(-50, 51)], "day double").select(sc.lunar_anomaly(F.col("day")).alias("a")).collect()]
    assert got[50] == pytest.approx(want, abs=1e-9) and all(abs(a - want) < 0.2 for a in got)


def test_rotation_null(spark):
    rng = np.random.default_rng(4)
    rows = [(u, 1, term, float(a)) for u in range(60) for term, a in (("locked", 1 + 0.3 * rng.normal()), ("free", rng.uniform(-3, 3)))] + [(99, 1, "free", None)]
    got = {r.term: r for r in sc.rotation_null(spark.createDataFrame(rows, "user_id long, window_index long, term string, angle double"), ["term"], KEYS).collect()}
    for term in ("locked", "free"):
        own = [(u, a) for u, _, t, a in rows if t == term and a is not None]
        turn = lambda u, r: 2 * math.pi * int(hashlib.md5(f"turn|{u}|1|{r}".encode()).hexdigest()[:8], 16) / 2**32 if r else 0.0
        c = [abs(np.mean([np.exp(1j * (a + turn(u, r))) for u, a in own])) for r in range(33)]
        r = got[term]
        assert (r.n, r.coherence, r.null_mean, r.null_max) == (60, pytest.approx(c[0]), pytest.approx(np.mean(c[1:])), pytest.approx(max(c[1:])))
        assert r.p == pytest.approx((1 + sum(v >= c[0] for v in c[1:])) / 33)
    assert got["locked"].p < 0.05 < got["free"].p


def test_angles_of_named_phases(spark):
    rows = hq.moons(spark, SF)
    own = windows_of(rows.collect(), ["value", "lunar", "anomalistic"])
    some = dict(sorted(own.items())[:10])
    got = [r for r in hq.named_angles(spark, SF).collect() if (r.user_id, r.window_index) in some]
    assert_fits(got, some, ["value"], [], hq.SHAM, ["lunar", "anomalistic"])


def test_slope_halfway_is_rounded_as_it_is(spark):
    """A morning whose slope ends in 5 at the seventh decimal: cancellation must not tip it."""
    from fractions import Fraction

    from tidewell import functions as fn

    rng = np.random.default_rng(3)
    rows, want = [], {}
    for user in range(400):
        own = [(h, Fraction(int(rng.integers(0, 20000)), 100)) for h in (5, 5, 5, 6, 7, 7, 8, 9)]
        mean_h, mean_v = Fraction(sum(h for h, _ in own), 8), sum(v for _, v in own) / 8
        slope = sum((h - mean_h) * (v - mean_v) for h, v in own) / sum((h - mean_h) ** 2 for h, _ in own)
        want[user] = float(int(abs(slope) * 10**6 + Fraction(1, 2)) * (1 if slope >= 0 else -1)) / 1e6
        for h in (5, 6, 7, 8, 9):
            v = [float(x) for g, x in own if g == h]
            rows.append((user, h, len(v), float(np.sum(v))))
    got = harmonics.curve_features(spark.createDataFrame(rows, "user_id long, hour long, n long, vsum double")).select("user_id", fn.r6(F.col("morning_slope")).alias("s")).collect()
    assert {r.user_id: r.s for r in got} == want


def test_peaks_in_tasks_are_those_of_joined_spectra(spark):
    """Series with gaps, nulls, constant values and a day repeated: series_peaks against detrend, spectrum and peak; sliding windows against the same over windows cut by hand; few rows held at once."""
    from tidewell.operators import rhythms

    rng = np.random.default_rng(5)
    rows = []
    for user in range(6):
        for day in sorted(rng.choice(400, 180, replace=False)):
            value = 7.0 if user == 1 else None if user == 2 and day % 9 == 0 else float(10 * np.sin(day / 4.5) + rng.normal())
            rows += [(user, int(day), value)] * (1 + (user == 3 and day % 50 == 0))
    rows.append((9, 5, 1.0))
    series = spark.createDataFrame(rows, "user_id long, day long, value double")
    cut = [(u, 15 * k + min(d for v, d, _ in rows if v == u), d, y) for u, d, y in rows for k in range(28)]
    span = {u: (min(d for v, d, _ in rows if v == u), max(d for v, d, _ in rows if v == u)) for u, _, _ in rows}
    cut = [(u, a, d, y) for u, a, d, y in cut if a <= d < a + 90 and a + 90 <= span[u][1] + 1 and a + 90 - 1 < span[u][1] + 1]
    counts = {}
    for u, a, _, _ in cut:
        counts[u, a] = counts.get((u, a), 0) + 1
    windows = spark.createDataFrame([(u, a, d, y) for u, a, d, y in cut if counts[u, a] >= 30 and a + 90 <= span[u][1]], "user_id long, start_day long, day long, value double")
    plain = lambda df, keys: {tuple(r[k] for k in keys): tuple(None if v is None else round(v, 7) for v in (r.period, r.power, r.amplitude, r.phase, r.noise_floor, r.snr)) for r in df.collect()}
    both = ("user_id", "start_day")
    assert plain(rhythms.series_peaks(series), ("user_id",)) == plain(rhythms.peak(rhythms.spectrum(rhythms.detrend(series))), ("user_id",))
    got = rhythms.sliding_spectrum(series, min_days=30)
    assert plain(got, both) == plain(rhythms.peak(rhythms.spectrum(rhythms.detrend(windows, both), keys=both), both), both)
    assert "Window" not in got._jdf.queryExecution().toString() and got._jdf.queryExecution().toString().count("Generate") == 0
