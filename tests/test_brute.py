"""Registered queries that SQL can't express, against numpy on what their views hold."""

from __future__ import annotations

import numpy as np
import pytest
from oracle import SF

from tidewell.plans import harmonic_queries, inference_queries, model_queries, registry, score_queries
from tidewell.plans import views as vw


def spectra(rows, keys, periods, degree=1, weekdays=True):
    """(n, share, amplitude, angle) by key and period: nested fits by least squares on plain design matrices."""
    groups = {}
    for r in rows:
        if r.value is not None:
            groups.setdefault(tuple(r[k] for k in keys), []).append((r.day, r.value))
    out = {}
    for key, own in groups.items():
        day, y = np.array(sorted(own), float).T
        t = (day - day.mean()) / max(np.ptp(day), 1.0)
        base = np.column_stack([*(t**d for d in range(degree + 1)), *([(day + 3) % 7 == d for d in range(1, 7)] if weekdays else [])]).astype(float)
        rss = lambda m: float(np.sum((y - m @ np.linalg.lstsq(m, y, rcond=1e-9)[0]) ** 2))  # noqa: E731, B023
        for p in periods:
            full = np.column_stack([base, np.cos(2 * np.pi * day / p), np.sin(2 * np.pi * day / p)])
            if len(day) <= np.linalg.matrix_rank(base) + 2 or rss(base) <= 1e-9 * float(y @ y):
                out[(*key, p)] = (len(day), None, None, None)
                continue
            b = np.linalg.lstsq(full, y, rcond=1e-9)[0]
            clean = rss(base) - rss(full) > 1e-6 * rss(base)  # else the period is one of the nuisance, as 7 days are
            out[(*key, p)] = (len(day), 1 - rss(full) / rss(base), *((np.hypot(*b[-2:]), np.arctan2(b[-1], b[-2])) if clean else (None, None)))
    return out


SPECTRA = {
    "window_spectrum": (harmonic_queries.series, ("user_id", "window_index"), [7.0 + i / 2 for i in range(57)], 1, True),
    "seasonal_spectrum": (harmonic_queries.series, ("user_id", "window_index"), [28.0, 30.0], 3, True),
    "occupancy_spectrum": (harmonic_queries.occupied, ("user_id",), [5.0, 7.0, 10.0, 14.0], 1, False),
}


@pytest.mark.parametrize("name", sorted(SPECTRA))
def test_spectra(spark, name):
    view, keys, periods, degree, weekdays = SPECTRA[name]
    want = spectra(view(spark, SF).collect(), keys, periods, degree, weekdays)
    got = {(*(r[k] for k in keys), r.period): r for r in registry.QUERIES[name](spark, SF).collect()}
    assert set(got) == set(want) and want
    for k, (n, share, amplitude, _) in want.items():
        r = got[k]
        assert r.n == n and (r.explained is None) == (share is None)
        if share is not None:
            assert r.explained == pytest.approx(share, abs=2e-5)
        if amplitude is not None:
            assert r.amplitude == pytest.approx(amplitude, abs=1e-4)


def test_fixed_period_angles(spark):
    want = {}
    for (_, window, p), (_, share, amplitude, angle) in spectra(harmonic_queries.series(spark, SF).collect(), ("user_id", "window_index"), [7.0, 28.0, 29.530588, 30.4375]).items():
        if amplitude is not None:
            want.setdefault((window, p), []).append((share, angle))
    got = {(r.window_index, r.period): r for r in registry.QUERIES["period_coherence"](spark, SF).collect()}
    assert set(want) <= set(got)
    for k, own in want.items():
        if k[1] != 7.0:  # weekdays leave nothing of seven days
            share, angle = np.array(own).T
            assert (got[k].n, got[k].coherence, got[k].explained) == (len(own), pytest.approx(abs(np.exp(1j * angle).mean()), abs=1e-4), pytest.approx(share.mean(), abs=1e-4))


def test_age_curves(spark):
    rows = inference_queries.people(spark, SF).collect()
    k = inference_queries._k
    cube = lambda x, t: np.maximum(x - t, 0) ** 3
    basis = lambda x: np.column_stack([np.ones_like(x), x, *((cube(x, t) - cube(x, k[2]) * (k[3] - t) / (k[3] - k[2]) + cube(x, k[3]) * (k[2] - t) / (k[3] - k[2])) / (k[3] - k[0]) ** 2 for t in k[:2])])
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    beta = np.linalg.lstsq(basis(x), y, rcond=None)[0]
    got = sorted((r.x, r.fit, r.slope) for r in registry.QUERIES["age_curves"](spark, SF).collect())
    at = np.array(sorted({v for v in x if k[0] <= v <= k[-1]}))
    assert [g[0] for g in got] == at.tolist()
    assert [g[1] for g in got] == pytest.approx((basis(at) @ beta).tolist(), rel=1e-6, abs=1e-4)
    assert [g[2] for g in got] == pytest.approx(((basis(at + 1e-5) - basis(at - 1e-5)) @ beta / 2e-5).tolist(), rel=1e-3, abs=1e-2)


def test_ancova_of_two_factors(spark):
    sal = {r.user_id: r.salutation for r in vw.demographics(spark, SF).collect()}
    rows = [(r.y, r.grp, sal[r.user_id]) for r in inference_queries.people(spark, SF).collect() if sal[r.user_id] is not None]
    x = np.array([[1, *(g == i for i in range(1, 5)), s == 20, s == 30] for _, g, s in rows], float)
    y = np.array([r[0] for r in rows])
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e = (y - x @ beta) / (1 - np.einsum("ij,jk,ik->i", x, inv, x))
    se = np.sqrt(np.diag(inv @ (x * e[:, None] ** 2).T @ x @ inv))
    got = {r.term: r for r in registry.QUERIES["ancova_factors"](spark, SF).collect()}
    for i, name in enumerate(["intercept", *score_queries._two]):
        assert (got[name].estimate, got[name].se) == (pytest.approx(beta[i], rel=1e-6), pytest.approx(se[i], rel=1e-6))


def test_top_features(spark):
    weights = sorted(((-r.importance, r.feature) for r in model_queries.forest_parts(spark, SF)[1].collect()))[:5]
    got = [(r.feature, r.importance) for r in registry.QUERIES["topk_features"](spark, SF).collect()]
    assert sorted(got) == sorted((f, pytest.approx(-w, abs=1e-6)) for w, f in weights)


def test_forest_depth_is_chosen_out_of_fold(spark):
    from tidewell.operators import modelling

    rng = np.random.default_rng(3)
    a, b = rng.random(400), rng.random(400)
    rows = spark.createDataFrame([(i, float(x), float(z), float((x > 0.5) != (z > 0.5))) for i, (x, z) in enumerate(zip(a, b, strict=True))], "user_id long, a double, b double, y double")
    depth, areas = modelling.tune_forest(rows, ["a", "b"], "user_id", depths=(1, 5))
    got = {r.depth: r.auroc for r in areas.collect()}
    assert depth == 5 and got[5] > 0.9 > got[1]  # one split can't tell exclusive-or
