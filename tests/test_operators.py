"""Hand fixtures of single operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators import cohorts, epochs, evaluation, gaps, ranks, splits, windows


@pytest.fixture
def ten_days(spark):
    values = [10.0, 20.0, None, 40.0, 50.0, 60.0, 70.0, 80.0, 90.0, 100.0]
    return spark.createDataFrame([(1, 100 + i, v, i != 2) for i, v in enumerate(values)], "user_id long, day long, value double, adequate boolean")


def test_rolling_calendar(ten_days):
    got = {r.day - 100: r.rolling for r in windows.rolling_calendar(ten_days, 7, 4).collect()}
    assert got == pytest.approx({4: 30, 5: 36, 6: 250 / 6, 7: 320 / 6, 8: 65, 9: 70})
    last_off = ten_days.withColumn("adequate", F.col("adequate") & (F.col("day") != 109))
    assert sorted(r.day - 100 for r in windows.rolling_calendar(last_off, 7, 4).collect()) == [4, 5, 6, 7, 8]
    assert windows.rolling_calendar(ten_days, 30, 15).count() == 0


def test_endpoint_slope(spark):
    rolled = spark.createDataFrame([(1, 1, 42.0), (2, 1, 7.0), (2, 2, 7.0)], "user_id long, day long, rolling double")
    got = {r.user_id: (r.sd, r.slope) for r in windows.endpoint_slope(rolled).collect()}
    assert got == {1: (None, None), 2: (0.0, 0.0)}


def test_collapse_duplicates(spark):
    rows = spark.createDataFrame([(1, 10, 60.0), (1, 10, 60.0), (2, 11, 61.0), (2, 11, 70.0)], "user_id long, day long, value double")
    assert [tuple(r) for r in epochs.collapse_duplicates(rows).collect()] == [(1, 10, 60.0)]
    assert tuple(epochs.duplicate_counts(rows).first()) == (1, 1, 1)


def test_daily_qc(spark):
    assert tuple(epochs.daily_qc(spark.createDataFrame([(60.0,), (24.0,), (None,)], "value double")).first()) == (1, 1, 1)


def test_union_coverage(spark):
    spans = [(0, 60), (60, 120), (200, 260), (210, 220), (300, 300)]
    rows = spark.createDataFrame([(1, 1, 1, a * 1000, b * 1000) for a, b in spans], "user_id long, channel long, day long, start_ms long, end_ms long")
    assert epochs.union_coverage(rows).first().cov_s == 180


def test_sd_of_one_reading_is_zero(spark):
    row = epochs.day_stats(spark.createDataFrame([(1, 1, 1, 1, 70.0)], "user_id long, channel long, day long, hour long, value double")).first()
    assert (row.n, row.sd) == (1, 0.0)


@pytest.mark.parametrize(("per_block", "minimum", "eligible"), [(16, 15, True), (12, 15, False)])
def test_window_180(spark, per_block, minimum, eligible):
    dates = spark.createDataFrame([(1, 30 * b + i) for b in range(6) for i in range(per_block)], "user_id long, day long")
    got = windows.window_180(dates, minimum, 90).where("window_index = 1").collect()
    assert [r.start_day for r in got] == ([0] if eligible else [])


@pytest.mark.parametrize("capacity", [(10, 10, 10, 10, 10, 40), (15,) * 6, (10, 11, 12, 17, 20, 20)])
def test_block_quotas(spark, capacity):
    got = {r.block: r.quota for r in windows.block_quotas(spark.createDataFrame([(1, b, c) for b, c in enumerate(capacity)], "user_id long, block long, capacity long"), 90, 10).collect()}
    assert sum(got.values()) == 90 and all(10 <= got[b] <= c for b, c in enumerate(capacity))
    if capacity == (15,) * 6:
        assert set(got.values()) == {15}


def test_week_starts_on_monday(spark):
    # day 0 is Thursday, 1970-01-01
    assert tuple(spark.range(1).select(fn.weekday(F.lit(0)), fn.week_start(F.lit(0)), fn.weekday(F.lit(4))).first()) == (3, -3, 0)


def test_prefix_timeline_never_looks_ahead(spark):
    rows = [(1, d, float(d * d)) for d in range(4)]
    make = lambda n: sorted(map(tuple, windows.prefix_timeline(spark.createDataFrame(rows[:n], "user_id long, day long, value double")).collect()))
    assert make(4)[:2] == make(2)


def test_fills_keep_observed_bins_and_edges(spark):
    hr = [None, 60.0, None, 80.0, None, None, None, 50.0, None]
    grid = spark.createDataFrame([(1, 1, i, v) for i, v in enumerate(hr)], "user_id long, day long, bin long, hr double")
    filled = gaps.fill_clock(grid, grid)
    got = {r.bin: r.linear for r in gaps.fill_linear(filled, 2).collect()}
    assert all(got[i] == v for i, v in enumerate(hr) if v is not None)
    assert got[2] == 70 and got[0] == got[8] == got[5] == 60  # edges and long gaps take the median of all
    assert {r.bin: r.diff for r in gaps.clean_diff(grid).collect()} == dict.fromkeys(range(9), 0.0)


def test_circular_smooth_wraps(spark):
    p = spark.createDataFrame([(i, 1.0 if i == 0 else 0.0) for i in range(24)], "bin long, hr double")
    got = {r.bin: r.smooth for r in gaps.circular_smooth(p, 24, 1.5).collect()}
    assert got[1] == pytest.approx(got[23]) and sum(got.values()) == pytest.approx(1.0)


def test_thresholds_take_all_ties(spark):
    p = spark.createDataFrame([("a", i, 1 if i < 3 else 0, 0.9 if i < 4 else 0.1) for i in range(8)], "arm string, user_id long, y long, score double")
    both = p.selectExpr("arm", "user_id", "y", "score", "explode(array('val', 'test')) as split")
    got = {r.side: r for r in evaluation.select_thresholds(both, 0.7).collect()}
    assert (got[1].tau, got[1].n_val, got[1].right_test, got[1].recall_test) == (0.9, 4, 3, 1.0) and (got[0].tau, got[0].n_test, got[0].right_test) == (0.1, 4, 4)
    assert [r.tau for r in evaluation.select_thresholds(both, 0.99, bound="cp").collect()] == [None, None]


def test_binomial_tail(spark):
    rows = [(k, n) for n in (1, 2, 5, 40, 300) for k in {0, 1, n // 3, n // 2, n - 1, n}]
    for share in (0.05, 0.5, 0.8):
        for r in spark.createDataFrame(rows, "k long, n long").withColumn("p", evaluation.binomial_tail(F.col("k"), F.col("n"), share)).collect():
            assert r.p == pytest.approx(sum(math.comb(r.n, i) * share**i * (1 - share) ** (r.n - i) for i in range(r.k, r.n + 1)), abs=1e-9)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(k, None if i % 9 == 0 else float(v)) for k in ("a", "b") for i, v in enumerate(rng.integers(0, 40, 500))] + [("c", 1.5), ("d", None)]
    got = {r.k: r for r in ranks.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"q1": 0.25, "m": 0.5, "p9": 0.9}).collect()}
    assert set(got) == {"a", "b", "c"}
    for k in got:
        assert [got[k].q1, got[k].m, got[k].p9] == pytest.approx(list(np.quantile([v for x, v in rows if x == k and v is not None], [0.25, 0.5, 0.9])))


def test_auroc_of_ties_is_half(spark):
    p = spark.createDataFrame([("a", 1, 0.5), ("a", 0, 0.5)], "arm string, y long, score double")
    assert evaluation.auroc(p).first().auroc == 0.5


def test_holm(spark):
    t = spark.createDataFrame([(1, "a", 0.01), (1, "b", 0.04), (1, "c", 0.03)], "fam long, test string, p double")
    got = {r.test: r.adjusted for r in evaluation.holm(t, ["fam"]).collect()}
    assert got == pytest.approx({"a": 0.03, "c": 0.06, "b": 0.06})


def test_largest_remainder_ties_go_first(spark):
    got = {r.grp: r.share for r in splits.largest_remainder(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "grp string, n long"), 10).collect()}
    assert got == {"a": 4, "b": 3, "c": 3}


def test_stratified_split_ignores_row_order(spark):
    rows = [(i, i % 2) for i in range(80)]
    a, b = (splits.stratified_split(spark.createDataFrame(r, "id long, y long"), "id", "y", "t") for r in (rows, rows[::-1]))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert {r.split: r["count"] for r in a.groupBy("split").count().collect()} == {"train": 56, "test": 12, "val": 12}


def test_checked_join_rejects_repeated_keys(spark):
    left, right = spark.createDataFrame([(1,)], "k long"), spark.createDataFrame([(1, 2), (1, 3)], "k long, v long")
    with pytest.raises(PySparkException):
        cohorts.checked_join(left, right, ["k"]).collect()


def test_rayleigh_of_equal_angles(spark):
    a = spark.createDataFrame([(1, math.pi / 3)] * 5, "k long, angle double")
    row = evaluation.rayleigh(a, ["k"]).first()
    assert (row.length, row.mean_angle) == pytest.approx((1.0, math.pi / 3))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "user_id long, channel long, day long, hour long, start_ms long, end_ms long, source long, value double")
    assert epochs.day_table(none).count() == cohorts.source_set(none).count() == epochs.source_stats(none).count() == 0
