"""Calibration, transfer, pruning and permutation importance against plain numpy."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import modelling


def area(y, score):
    y, score = np.asarray(y), np.round(np.asarray(score, float), 9)
    on, off = score[y == 1], score[y == 0]
    return float(np.mean((on[:, None] > off).astype(float) + 0.5 * (on[:, None] == off)))


def newton(x, y, rounds=50):
    """Slope and intercept of the logistic map of greatest likelihood."""
    m, b = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-m @ b))
        b = b + np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m, m.T @ (y - p))
    return b


def test_platt_against_newton(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(0, 1.5, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(1.3 * x - 0.4)))).astype(int)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, x, strict=True))] + [(400, 1, None)], "user_id long, y long, score double")
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate((-3, -0.5, 0, 0.2, 4))] + [(9, None)], "user_id long, score double")
    got = {r.user_id: r.calibrated for r in modelling.platt(df, rows).collect()}
    a, b = newton(x, y)
    assert got.pop(9) is None and len(got) == 5
    for i, v in enumerate((-3, -0.5, 0, 0.2, 4)):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(a * v + b))), abs=1e-4)


def test_transfer_against_plain(spark):
    rng = np.random.default_rng(22)
    y, home, away = rng.integers(0, 2, 120), rng.integers(0, 9, 120) / 8, rng.integers(0, 5, 120) / 4
    of = lambda s: spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "y long, score double")
    r = modelling.transfer(of(home), of(away)).first()
    assert (r["local"], r.imported, r.effect) == pytest.approx((area(y, home), area(y, away), area(y, away) - area(y, home)))
    assert modelling.transfer(of(home).where("y = 1"), of(away).where("y = 1")).first().effect is None


def digest(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def test_permutation_importance_against_plain(spark):
    rng = np.random.default_rng(23)
    n = 150
    y = rng.integers(0, 2, n)
    x = {"a": y + rng.normal(0, 0.8, n), "b": rng.normal(0, 1, n)}
    ids = (np.arange(n) * 7 + 3).tolist()
    df = spark.createDataFrame([(i, int(t), float(a), float(b)) for i, t, a, b in zip(ids, y, x["a"], x["b"], strict=True)], "user_id long, y long, a double, b double")
    got = {r.feature: r.loss for r in modelling.permutation_importance(lambda rows: rows.withColumn("score", 2 * F.col("a") - 0.3 * F.col("b")), df, ["a", "b"], "user_id", "p").collect()}
    score = lambda c: 2 * c["a"] - 0.3 * c["b"]
    for f in ("a", "b"):
        to = sorted(range(n), key=lambda i: digest(f"p|{f}|to", ids[i]))  # noqa: B023
        frm = sorted(range(n), key=lambda i: digest(f"p|{f}|from", ids[i]))  # noqa: B023
        dealt = x[f].copy()
        dealt[to] = x[f][frm]
        assert got[f] == pytest.approx(area(y, score(x)) - area(y, score(x | {f: dealt})), abs=1e-9)
    assert got["a"] > 0.1 > abs(got["b"])


def test_pruning_against_plain(spark):
    rng = np.random.default_rng(24)
    a = rng.integers(0, 12, 200).astype(float)
    c = rng.normal(0, 1, 200)
    table = np.column_stack([a, np.exp(a), -a + rng.normal(0, 0.2, 200), c, c + rng.normal(0, 0.9, 200), np.full(200, 2.0), rng.normal(0, 1, 200)])
    names = list("abcdefg")
    rank = lambda v: np.array([np.mean(np.flatnonzero(np.sort(v) == x)) for x in v])
    with np.errstate(invalid="ignore"):
        r = np.corrcoef(np.array([rank(v) for v in table.T]))
    df = spark.createDataFrame(table.tolist(), ", ".join(f"{n} double" for n in names))
    for limit in (0.3, 0.95, 0.999):
        kept = []
        for i in range(7):
            if not any(abs(r[i, j]) > limit for j in kept):
                kept.append(i)
        assert modelling.prune_correlated(df, names, limit) == [names[i] for i in kept]
    assert modelling.prune_correlated(df, names) != names
