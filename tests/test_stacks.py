"""Stacked fits against each window by itself, and that few bytes don't end up in few tasks."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import harmonics, rhythms, spectra


def rows(seed: int = 5):
    """Windows of many lengths, dates that repeat, values that are null, one flat window and one without any value."""
    rng = np.random.default_rng(seed)
    out = [(u, 1, int(d), float(rng.normal(60, 5)) if rng.random() > 0.1 else None) for u in range(80) for d in 9000 + np.sort(rng.choice(180, rng.integers(1, 120)))]
    return out + [(100, 1, 9000 + i, 60.0) for i in range(40)] + [(101, 1, 9000 + i, None) for i in range(5)] + [(102, 1, 9000 + i // 2, float(i % 7)) for i in range(60)]


def alone(own, period):
    """(n, explained, r2_trend, r2_weekdays, r2_period) of one window by least squares."""
    day, y = np.array([(d, v) for *_, d, v in own if v is not None], float).reshape(-1, 2).T
    turn = 2 * math.pi * day / period
    blocks = [[np.ones_like(day)], [day - (day.mean() if len(day) else 0)], [((day + 3) % 7 == d) * 1.0 for d in range(1, 7)], [np.cos(turn), np.sin(turn)]]
    rss, cols = [], []
    for b in blocks:
        cols += b
        x = np.column_stack(cols)
        rss.append(float(((y - x @ np.linalg.lstsq(x, y, rcond=1e-9)[0]) ** 2).sum()) if len(y) else 0.0)
    rank = np.linalg.matrix_rank(np.column_stack(cols[:-2]), rtol=1e-9) if len(y) else 0
    fine = len(y) > rank + 2 and rss[2] > 1e-12 * max(float(y @ y), 1e-300)
    return len(y), 1 - rss[3] / rss[2] if fine else None, *[(a - b) / rss[0] if rss[0] > 1e-12 else None for a, b in zip(rss, rss[1:])]


def test_stacks_against_single_windows(spark):
    all_ = rows()
    df = spark.createDataFrame(all_, "user_id long, window_index long, day long, value double")
    spectrum = {r.user_id: r for r in harmonics.nuisance_spectrum(df, [28.0]).collect()}
    parts = {r.user_id: r for r in harmonics.partial_r2(df, 28.0).collect()}
    users = {r[0] for r in all_}
    assert set(spectrum) == set(parts) == users
    for u in users:
        n, explained, *r2 = alone([r for r in all_ if r[0] == u], 28.0)
        assert spectrum[u].n == parts[u].n == n and spectrum[u].explained == pytest.approx(explained, abs=1e-9)
        assert [parts[u].r2_trend, parts[u].r2_weekdays, parts[u].r2_period] == [pytest.approx(v, abs=1e-9) for v in r2]


@pytest.mark.parametrize("dealt", (lambda d: harmonics.nuisance_spectrum(d, [28.0]), lambda d: spectra.window_fits(d, [28.0]), lambda d: rhythms.series_peaks(d, [20.0, 28.0])))
def test_windows_are_dealt_to_all_partitions(spark, dealt):
    df = spark.createDataFrame(rows(), "user_id long, window_index long, day long, value double").where("value IS NOT NULL")
    tasks = dealt(df).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_cosinor_grid_sums_in_tasks(spark):
    """Against least squares with a null value and a short series; no shuffle has a row for each period."""
    own = {(u, d): v for u, _, d, v in rows()}
    df = spark.createDataFrame([(u, d, v) for (u, d), v in own.items() if u != 101 and v is not None], "user_id long, day long, value double")
    plan = df.transform(rhythms.cosinor_grid, [20.0, 28.0])
    assert "Generate" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {(r.user_id, r.period): r for r in plan.collect()}
    for u in {u for u, _ in own} - {101}:
        day, y = np.array([(d, v) for (w, d), v in own.items() if w == u and v is not None], float).reshape(-1, 2).T
        assert ((u, 28.0) in got) == (len(y) > 4)
        if len(y) < 60:
            continue
        x = np.column_stack([np.ones_like(day), day - day.mean(), np.cos(2 * math.pi * day / 28), np.sin(2 * math.pi * day / 28)])
        rss = [float(((y - x[:, :k] @ np.linalg.lstsq(x[:, :k], y, rcond=None)[0]) ** 2).sum()) for k in (1, 2, 4)]
        r = got[u, 28.0]
        assert r.n == len(y) and [r.delta_r2, r.r2_null] == [pytest.approx(v, abs=1e-9) for v in ((rss[1] - rss[2]) / rss[0], 1 - rss[1] / rss[0])]


def test_model_rows_are_read_from_scratch(spark):
    from oracle import SF

    from tidewell.plans import model_queries

    for rows in model_queries.parts(spark, SF)[0]:
        assert not any(f.endswith("documents.parquet") or "/documents.parquet/" in f for f in rows.inputFiles())
