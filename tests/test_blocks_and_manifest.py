"""Wide blocks against plain counts; partitions of broken and repeated runs."""

from __future__ import annotations

import numpy as np
import pytest
from oracle import SF
from pyspark.sql import functions as F

from tidewell.operators import blocks
from tidewell.plans import registry
from tidewell.sources import files, manifest

DAY = 86_400_000


def test_block_has_its_305_columns(spark):
    assert len(registry.QUERIES["static_block"](spark, SF).columns) == 306


def test_block_against_plain(spark):
    rng = np.random.default_rng(0)
    days = [(u, d, *[float(v) for v in rng.normal(50, 9, 5)], int(rng.integers(1, 90)), float(rng.integers(1, 9000)), int(rng.integers(1, 24))) for u in range(6) for d in rng.choice(40, u + 1, replace=False).tolist()]
    events = [(u, d, d * DAY + int(ms)) for u, d, *_ in days for ms in rng.integers(0, DAY, 30)] + [(0, 1000, 1000 * DAY)]
    own = spark.createDataFrame(days, "user_id long, day long, mean double, median double, sd double, vmin double, vmax double, n long, cov_s double, hours long")
    got = {r.user_id: r for r in blocks.day_block(own, spark.createDataFrame(events, "user_id long, day long, local_ms long"), 24).collect()}
    for u in range(6):
        mine = [r for r in days if r[0] == u]
        seen = {(d, ms % DAY // 3_600_000) for v, d, ms in events if v == u and d in {r[1] for r in mine}}
        assert [got[u][f"bin_{b}"] for b in range(24)] == [pytest.approx(sum(b == x for _, x in seen) / len(mine)) for b in range(24)]
        for i, s in enumerate(("mean", "median", "sd", "vmin", "vmax", "n", "cov_h", "hours")):
            v = np.array([r[2 + i] / (3600 if s == "cov_h" else 1) for r in mine], float)
            assert got[u][f"{s}_mean"] == pytest.approx(v.mean()) and (got[u][f"{s}_sd"] is None if len(v) == 1 else got[u][f"{s}_sd"] == pytest.approx(v.std(ddof=1)))
        off, on = [r[2] for r in mine if (r[1] + 3) % 7 >= 5], [r[2] for r in mine if (r[1] + 3) % 7 < 5]
        assert got[u].weekend_contrast == (pytest.approx(np.mean(off) - np.mean(on)) if off and on else None)


def plain_curve(own):
    """The 35 features of one day's (hour, n, vsum), by plain numpy."""
    n, total = np.zeros(24), np.zeros(24)
    for h, k, v in own:
        n[h], total[h] = k, v
    on = n > 0
    m = np.where(on, total / np.maximum(n, 1), np.nan)
    waves = lambda h: np.array([[1.0] + [f(2 * np.pi * k * x / 24) for k in (1, 2, 3) for f in (np.cos, np.sin)] for x in h])
    at, r = np.flatnonzero(on), np.sqrt(n[on])
    b = np.linalg.lstsq(waves(at) * r[:, None], m[on] * r, rcond=1e-10)[0]
    fine = np.arange(0, 24, 0.25)
    left = np.sqrt(np.sum(n[on] * (m[on] - waves(at) @ b) ** 2) / n.sum())
    part = lambda lo, hi: np.average(m[lo:hi][on[lo:hi]], weights=n[lo:hi][on[lo:hi]]) if on[lo:hi].any() else np.nan
    x = at[(at >= 5) & (at <= 9)]
    slope = np.nan if len(x) < 2 else np.polyfit(x, m[x], 1, w=np.sqrt(n[x]))[0]
    above = m[on] - m[on].min()
    p = above[above > 0] / above.sum() if above.sum() > 0 else np.array([])
    return [b[0], np.hypot(*b[1:3]), np.hypot(*b[3:5]), np.hypot(*b[5:7]), fine[np.argmax(np.round(waves(fine) @ b, 9))], left, part(0, 6), slope, part(8, 20) - part(0, 6), np.ptp(m[on]), -np.sum(p * np.log(p)), *m]


def test_date_profile_against_plain(spark):
    rng = np.random.default_rng(1)
    hours = [(u, d, int(h), int(rng.integers(1, 9)), float(rng.normal(300, 40))) for u in range(5) for d in range(10, 10 + 4 * u + 1) for h in rng.choice(24, int(rng.integers(1, 25)), replace=False)]
    got = {r.user_id: r for r in blocks.date_profile(blocks.day_curves(spark.createDataFrame(hours, "user_id long, day long, hour long, n long, vsum double"))).collect()}
    names = (*blocks.FITTED, *blocks.CURVE, *blocks.HOURS)
    assert len(got) == 5 and len(got[0]) == 86
    for u in range(5):
        by = {d: plain_curve([r[2:] for r in hours if r[0] == u and r[1] == d]) for d in {r[1] for r in hours if r[0] == u}}
        table = np.array([by[d] for d in sorted(by)])
        rest = np.array([(d + 3) % 7 >= 5 for d in sorted(by)])
        for i, c in enumerate(names):
            v = table[:, i][~np.isnan(table[:, i])]
            assert got[u][f"{c}_mean"] == (pytest.approx(v.mean(), abs=1e-7) if len(v) else None), c
            assert got[u][f"{c}_sd"] == (pytest.approx(v.std(ddof=1), abs=1e-7) if len(v) > 1 else None), c
            if c in blocks.CURVE:
                wd, we = (x[~np.isnan(x)] for x in (table[~rest, i], table[rest, i]))
                for k, x in (("wd", wd), ("we", we)):
                    assert got[u][f"{c}_{k}"] == (pytest.approx(x.mean(), abs=1e-7) if len(x) else None), c
                assert got[u][f"{c}_wd_diff"] == (pytest.approx(wd.mean() - we.mean(), abs=1e-7) if len(wd) and len(we) else None), c


def test_date_profile_of_no_days(spark):
    assert blocks.date_profile(blocks.day_curves(spark.createDataFrame([], "user_id long, day long, hour long, n long, vsum double"))).count() == 0


def files_of(spark, path):
    return {r.f for r in spark.read.parquet(path).select(F.input_file_name().alias("f")).distinct().collect()}


def test_broken_run_is_done_again_by_partition(spark):
    path = files.scratch(spark, "parts")
    df = spark.range(1000).withColumn("part", F.when(F.col("id") % 5 > 0, F.col("id") % 5)).repartition(3)
    assert {r.part: r.rows for r in manifest.write_partitions(df.where("part <= 2"), path, ["part"]).collect()} == {1: 200, 2: 200}
    before = files_of(spark, path)
    broken = df.where("part >= 2 AND id < 500")
    assert {r.part for r in manifest.write_partitions(broken, path, ["part"], finish=False).collect()} == {1, 2}
    assert before < files_of(spark, path)
    done = manifest.write_partitions(df, path, ["part"])
    assert {r.part: r.rows for r in done.collect()} == {None: 200, 1: 200, 2: 200, 3: 200, 4: 200}
    assert before < files_of(spark, path)  # finished partitions kept their files
    assert {r.id for r in spark.read.parquet(path).collect()} == set(range(1000)) and spark.read.parquet(path).count() == 1000
    again = files_of(spark, path)
    assert manifest.write_partitions(df, path, ["part"]).count() == 5 and files_of(spark, path) == again
