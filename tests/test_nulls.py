"""Null replicates of spectra: the filter against dense covariances, fits against many candidates, draws against their covariance."""

from __future__ import annotations

import numpy as np
import pytest

from tidewell.operators import nulls, spectra

RNG = np.random.default_rng(11)


def window(n, seed=0):
    rng = np.random.default_rng(seed)
    return np.sort(rng.choice(180, n, replace=False)).astype(float) + 19_000


def dense(day, share, fast, slow):
    gap = np.abs(day[:, None] - day)
    return share * fast**gap + (1 - share) * slow**gap


def batch(sizes):
    """Windows of several sizes as one stack: day, live, y, basis, kept."""
    days = [window(n, n) for n in sizes]
    t = max(sizes)
    day, live, y = np.zeros((len(sizes), t)), np.zeros((len(sizes), t), bool), np.zeros((len(sizes), t))
    for i, d in enumerate(days):
        day[i, : len(d)], live[i, : len(d)], y[i, : len(d)] = d, True, RNG.normal(0, 2, len(d)).cumsum() * 0.3 + RNG.normal(0, 1, len(d))
    basis, kept = spectra.screened(spectra.nuisance(day, live.astype(float), [], 1, True))
    return day, live, y, basis, kept


def plain_nll(day, y, basis, kept, share, fast, slow):
    """By the dense covariance on the space that the basis leaves."""
    x = basis[:, kept]
    u, s, _ = np.linalg.svd(np.eye(len(y)) - x @ x.T)
    q = u[:, s > 0.5]
    m, z = q.T @ dense(day, share, fast, slow) @ q, q.T @ y
    v = z @ np.linalg.solve(m, z) / len(z)
    return 0.5 * (np.linalg.slogdet(m)[1] + len(z) * (np.log(v) + 1)), v


def test_restricted_likelihood_against_dense():
    day, live, y, basis, kept = batch([20, 55, 90])
    cand = [(0.5, 0.3, 0.98), (0.05, 0.9, 0.995), (0.95, 0.01, 0.98), (0.7, 0.6, 0.995)]
    nll, v = nulls.restricted(day, live, y, basis, kept, *[np.tile([c[j] for c in cand], (3, 1)) for j in range(3)])
    for i, n in enumerate((20, 55, 90)):
        for j, c in enumerate(cand):
            assert (nll[i, j], v[i, j]) == pytest.approx(plain_nll(day[i, :n], y[i, :n], basis[i, :n], kept[i], *c), rel=1e-8)


def test_fit_is_no_worse_than_many_candidates():
    day, live, y, basis, kept = batch([40, 90, 120])
    fit = nulls.fit_decays(day, live, y, basis, kept)
    share = fit["v1"] / (fit["v1"] + fit["v2"])
    for i, n in enumerate((40, 90, 120)):
        own = lambda *c: plain_nll(day[i, :n], y[i, :n], basis[i, :n], kept[i], *c)  # noqa: B023, E731
        assert own(share[i], fit["phi1"][i], fit["phi2"][i])[0] == pytest.approx(fit["nll"][i], rel=1e-8)
        others = [own(a, f, s)[0] for a in np.linspace(0.001, 0.999, 15) for f in np.linspace(0.001, 0.949, 15) for s in nulls.SLOW]
        assert fit["nll"][i] <= min(others) + 1e-3


def test_draws_have_the_covariance_and_their_seed():
    day, live = np.zeros((2, 6)), np.array([[True] * 6, [True] * 4 + [False] * 2])
    day[0], day[1, :4] = (0, 1, 4, 5, 30, 31), (0, 2, 3, 50)
    fit = {"v1": np.array([2.0, 1.0]), "phi1": np.array([0.5, 0.8]), "v2": np.array([1.0, 3.0]), "phi2": np.array([0.98, 0.995])}
    x = nulls.draw_series(day, live, fit, [1, 2], 200_000)
    for i, n in enumerate((6, 4)):
        v = fit["v1"][i] + fit["v2"][i]
        assert np.allclose(np.cov(x[i, :n]), v * dense(day[i, :n], fit["v1"][i] / v, fit["phi1"][i], fit["phi2"][i]), atol=0.05)
    assert not x[1, 4:].any()
    alone = nulls.draw_series(day[1:, :4], live[1:, :4], {k: f[1:] for k, f in fit.items()}, [2], 200_000)
    assert np.array_equal(alone[0], x[1, :4])


def rows_of(kinds):
    rng = np.random.default_rng(5)
    rows = []
    for u, kind in enumerate(kinds):
        d = window(100, u)
        noise = rng.normal(0, 1, len(d))
        v = {"wave": 4 * np.cos(2 * np.pi * d / 30) + noise, "noise": noise, "flat": np.full(len(d), 3.0), "few": noise}[kind]
        rows += [(u, 1, int(a), float(b)) for a, b in zip(d, v, strict=True)][: 8 if kind == "few" else None]
    return rows + [(0, 1, None, 1.0), (0, 1, 19_999, None)]


def test_endpoints_of_waves_noise_and_unfit_windows(spark):
    df = spark.createDataFrame(rows_of(["wave", "flat", "few"] + ["noise"] * 20), "user_id long, window_index long, day long, value double")
    got = {r.user_id: r for r in nulls.null_endpoints(df, replicates=99).collect()}
    assert [got[u].status for u in range(4)] == ["ok", "flat", "few_dates", "ok"] and got[1].p is None and got[2].spectrum is None and got[2].n == 8
    assert got[0].n == 100 and abs(got[0].peak_period - 30) <= 1 and got[0].peak_amplitude == pytest.approx(4, abs=0.6)
    # A wave this strong is partly taken for slow noise by the fit; it still stands above the replicates.
    assert got[0].peak_excess > 0.2 and got[0].p <= 0.05 and got[0].band_excess > 0
    noise = [got[u] for u in range(3, 23)]
    assert 0.25 < np.mean([r.p for r in noise]) < 0.75 and min(r.p for r in noise) >= 0.01
    assert all(len(r.spectrum) == len(r.null_mean) == len(r.null_variance) == len(spectra.BROAD) for r in noise)
    # Observed peaks are those of window_fits.
    fits = {r.user_id: r for r in spectra.peaks(spectra.window_fits(df, spectra.NARROW), 25, 35).collect()}
    for u in (0, *range(3, 23)):
        assert (got[u].peak_share, got[u].peak_period, got[u].peak_amplitude) == pytest.approx((fits[u].peak_share, fits[u].peak_period, fits[u].peak_amplitude), rel=1e-8)


def test_replicates_against_plain(spark):
    """Null columns from least squares on each drawn series by itself."""
    df = spark.createDataFrame(rows_of(["noise"]), "user_id long, window_index long, day long, value double")
    r = nulls.null_endpoints(df, replicates=25, tag="t").first()
    d = window(100, 0)
    t = (d - d[0]) / (d[-1] - d[0])
    x = np.column_stack([np.ones(100), t] + [np.mod(d + 3, 7) == k for k in range(1, 7)]).astype(float)
    fit = {k: np.array([r[k]]) for k in ("v1", "phi1", "v2", "phi2")}
    own = nulls.draw_series(d[None], np.ones((1, 100), bool), fit, [nulls.seed_of("t", (0, 1))], 25)[0]
    left = lambda m, y: np.sum((y - m @ np.linalg.lstsq(m, y, rcond=None)[0]) ** 2)
    wave = lambda p: np.column_stack([x, np.cos(2 * np.pi * d / p), np.sin(2 * np.pi * d / p)])
    share = lambda y, periods: np.array([1 - left(wave(p), y) / left(x, y) for p in periods])
    tops = [share(own[:, b], spectra.NARROW).max() for b in range(25)]
    assert r.null_peak == pytest.approx(np.mean(tops)) and r.p == pytest.approx((1 + sum(v >= r.peak_share for v in tops)) / 26)
    broad = sorted(spectra.BROAD, reverse=True)
    null = np.array([share(own[:, b], broad) for b in range(25)])
    assert r.null_mean == pytest.approx(null.mean(axis=0), abs=1e-9) and r.null_variance == pytest.approx(null.var(axis=0, ddof=1), abs=1e-9)
    f = 1 / np.array(broad)
    on = (f >= 1 / 35 - 1e-12) & (f <= 1 / 25 + 1e-12)
    mean = lambda v: np.trapezoid(v[on], f[on]) / (f[on][-1] - f[on][0])
    assert r.band_excess == pytest.approx(mean(np.array(r.spectrum)) - np.mean([mean(v) for v in null]), abs=1e-9)
    assert r.band_excess_se == pytest.approx(np.std([mean(v) for v in null], ddof=1) / 5)


def test_no_windows(spark):
    assert nulls.null_endpoints(spark.createDataFrame([], "user_id long, window_index long, day long, value double")).count() == 0
