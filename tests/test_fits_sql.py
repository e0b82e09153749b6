"""The SQL of fits against the operators on windows that the test tables don't have: dependent columns, short and flat windows, nulls."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd
from oracle import rows_of

from tidewell.operators import harmonics as hm, spectra as sc
from tidewell.plans import fits_sql as fs

KEYS = "user_id, window_index"


def windows() -> pd.DataFrame:
    rng = np.random.default_rng(5)
    parts = []
    for u, (step, n) in enumerate([(1, 90), (7, 40), (2, 60), (1, 9), (1, 60)]):  # every day, one weekday only, .., too few, flat
        day = 19000 + step * np.arange(n)
        share = rng.random(n)
        value = np.full(n, 4.0) if u == 4 else 60 + np.sin(2 * np.pi * day / 28) + rng.normal(size=n)
        parts.append(pd.DataFrame({"user_id": u, "window_index": 1, "day": day, "value": value, "other": rng.random(n), "share_1": share, "share_2": 1 - share, "share_3": np.zeros(n) if u % 2 else rng.random(n)}))
    out = pd.concat(parts, ignore_index=True)
    out.loc[3, "other"] = None
    return out


def same(df, sql: str, rows: pd.DataFrame) -> list:
    con = duckdb.connect()
    con.register("rows", rows)
    cur = con.execute(f"WITH sr AS (SELECT * REPLACE (CASE WHEN isnan(other) THEN NULL ELSE other END AS other) FROM rows), {sql}")
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    got = df.collect()
    assert rows_of(df.columns, got) == rows_of(names, cur.fetchall())
    return got


def spark_rows(spark, rows: pd.DataFrame):
    return spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in rows.astype(object).itertuples(index=False)], "user_id long, window_index long, day long, value double, other double, share_1 double, share_2 double, share_3 double")


def test_dependent_columns_are_dropped_in_the_same_order(spark):
    rows = windows()
    ctes, fit = fs.window_fits("sr", KEYS, [12.5, 28.0], ["value", "other"], ["share_1", "share_2", "share_3"])
    got = same(sc.window_fits(spark_rows(spark, rows), [12.5, 28.0], responses=["value", "other"], coverage=["share_1", "share_2", "share_3"]), f"{ctes} {fit}", rows)
    dropped = {r.user_id: r.dropped for r in got}
    assert dropped[0] == "share_2" and dropped[1].endswith("share_2, share_3") and dropped[1].count(",") >= 7  # one weekday: its own column is the intercept's, the others are zero
    assert {r.available for r in got if r.user_id == 3} == {0} and {r.zero_variance for r in got if r.user_id == 4 and r.response == "value"} == {1}


def test_spectrum_of_short_and_flat_windows(spark):
    rows = windows().drop(index=3)
    ctes, fit = fs.spectrum("sr", KEYS, [7.0, 20.0, 28.0])
    got = same(hm.nuisance_spectrum(spark_rows(spark, rows), [7.0, 20.0, 28.0]), f"{ctes} {fit}", rows)
    assert all(r.explained is None for r in got if r.user_id in (3, 4))


def test_elimination_solves_weighted_least_squares():
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"k": np.repeat([1, 2], 50), "x": rng.normal(size=100), "z": rng.normal(size=100), "w": rng.random(100) + 0.1, "y": rng.normal(size=100)})
    con = duckdb.connect()
    con.register("rows", rows)
    got = dict(con.execute(f"WITH {fs.solved('rows', 'k', ['1.0', 'x', 'z'], 'y', 'w')} SELECT k, b FROM lq").fetchall())
    for k, own in rows.groupby("k"):
        root = np.sqrt(own["w"].to_numpy())
        want = np.linalg.lstsq(root[:, None] * np.column_stack([np.ones(50), own["x"], own["z"]]), root * own["y"].to_numpy(), rcond=None)[0]
        assert np.allclose(got[k], want, rtol=1e-10)
