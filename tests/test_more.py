"""Operators that SQL doesn't express, against brute force, and edge cases of readers."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import epochs, evaluation, features, gaps, harmonics, inference, modelling, ranks, rhythms, splits, windows
from tidewell.plans import registry as q
from tidewell.sources import files

RNG = np.random.default_rng(3)


def test_running_totals_with_nulls_and_many_buckets(spark):
    rows = [(k, float(v), int(c)) for k in ("a", None) for v, c in zip(range(300), RNG.integers(1, 9, 300))]
    got = ranks.running_totals(spark.createDataFrame(rows, "k string, v double, c long"), ["k"], "v", ("c",)).collect()
    assert len(got) == 600
    for r in got:
        assert r.c_before == sum(c for k, v, c in rows if k == r.k and v < r.v) and r.c_total == sum(c for k, _, c in rows if k == r.k)


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(5000).withColumn("g", F.when(F.col("id") % 3 > 0, F.col("id") % 3))
    got = ranks.hash_rank(df, ["g"], F.sha2(F.col("id").cast("string"), 256), "id").collect()
    for g in (None, 1, 2):
        own = sorted(r["rank"] for r in got if r.g == g)
        assert own == list(range(1, len(own) + 1)) and {r.rank_of for r in got if r.g == g} == {len(own)}


def test_balanced_folds(spark):
    rows = spark.range(103).withColumn("s", F.when(F.col("id") % 4 > 0, F.col("id") % 4))
    got = splits.balanced_folds(rows, "id", ["s"], "t", 5)
    assert {r["count"] for r in got.groupBy("fold").count().collect()} <= {20, 21}
    for s in got.groupBy("s").pivot("fold", [0, 1, 2, 3, 4]).count().collect():
        assert max(s[1:]) - min(s[1:]) <= 1


def test_delong_of_perfect_order(spark):
    p = spark.createDataFrame([("a", 1, 0.9), ("a", 1, 0.8), ("a", 0, 0.1), ("a", 0, 0.2)], "arm string, y long, score double")
    r = evaluation.delong(p).first()
    assert (r.auroc, r.se) == (1.0, 0.0)


def test_one_class_or_no_spread_gives_nulls(spark):
    p = spark.createDataFrame([("a", "g", 1, 0.5), ("a", "h", 1, 0.5)], "arm string, grp string, y long, score double")
    assert tuple(evaluation.delong(p).first())[1:] == (None, None, None, None)
    assert evaluation.best_threshold(p).first().balanced_accuracy is None and evaluation.mann_whitney(p).first().z is None
    assert evaluation.welch(p, ["arm"], "y", "score").first().t is None and evaluation.kruskal_wallis(p, ["arm"], "grp", "score").first().h is None
    assert evaluation.proper_scores(p).first().skill is None and evaluation.smd(p, "grp", "g", "score").first().smd is None


def test_ols_hc3_against_numpy(spark):
    x = RNG.normal(size=(40, 2))
    y = 1 + x @ [2.0, -1.0] + RNG.normal(size=40)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)] + [(None, 1.0, 1.0)], "a double, b double, y double")
    terms, cov = inference.ols_hc3(df, "y", ["a", "b"])
    design = np.column_stack([np.ones(40), x])
    inv = np.linalg.inv(design.T @ design)
    beta = inv @ design.T @ y
    w = ((y - design @ beta) / (1 - np.sum(design @ inv * design, axis=1))) ** 2
    assert [r.estimate for r in terms.collect()] == pytest.approx(list(beta))
    assert cov == pytest.approx(inv @ (design.T * w) @ design @ inv)
    assert inference.ols_hc3(df.limit(0), "y", ["a", "b"])[0].count() == 0


def test_nuisance_spectrum_against_nested_fits(spark):
    day = np.sort(RNG.choice(180, 80, replace=False)) + 19000.0
    y = 50 + 0.02 * day + 3 * np.cos(2 * np.pi * day / 28) + RNG.normal(size=80)
    df = spark.createDataFrame([(1, 1, int(d), float(v)) for d, v in zip(day, y)] + [(2, 1, 5, 1.0)], "user_id long, window_index long, day long, value double")
    got = {(r.user_id, r.period): r for r in harmonics.nuisance_spectrum(df, [20.0, 28.0]).collect()}
    base = np.column_stack([np.ones(80), day - day.mean()] + [((day + 3) % 7 == k).astype(float) for k in range(1, 7)])
    rss = lambda x: float(np.sum((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2))
    for p in (20.0, 28.0):
        full = np.column_stack([base, np.cos(2 * np.pi * day / p), np.sin(2 * np.pi * day / p)])
        assert got[1, p].explained == pytest.approx(1 - rss(full) / rss(base))
        assert got[2, p].explained is None
    assert harmonics.band_summary(harmonics.nuisance_spectrum(df, [20.0, 24.0, 28.0, 32.0]), 20, 32).first().peak_period == 28.0
    assert harmonics.partial_r2(df, 28.0).where("user_id = 1").first().r2_period == pytest.approx((rss(base) - rss(np.column_stack([base, np.cos(2 * np.pi * day / 28), np.sin(2 * np.pi * day / 28)]))) / float(np.sum((y - y.mean()) ** 2)))


def test_circadian_fit(spark):
    curve = [60 + 8 * math.cos(2 * math.pi * (h - 15) / 24) for h in range(24)]
    df = spark.createDataFrame([(1, h, 4, 4 * v) for h, v in enumerate(curve)] + [(2, 7, 2, 140.0)], "user_id long, hour long, n long, vsum double")
    got = {r.user_id: r for r in harmonics.circadian_24h(df).collect()}
    r = got[1]
    assert (r.level, r.amplitude_1, r.amplitude_2, r.peak_hour, r.residual_sd) == pytest.approx((60, 8, 0, 15, 0), abs=1e-6)
    assert got[2].residual_sd == pytest.approx(0, abs=1e-9) and got[2].range == 0 and got[2].entropy == 0 and got[2].morning_slope is None


def test_fill_pchip_keeps_order_and_lines(spark):
    hr = [1.0, 2.0, None, None, 5.0, 6.0, None, 4.0]
    grid = spark.createDataFrame([(1, 1, i, v) for i, v in enumerate(hr)], "user_id long, day long, bin long, hr double").withColumn("filled", F.coalesce("hr", F.lit(0.0)))
    got = {r.bin: r.pchip for r in gaps.fill_pchip(grid, 3).collect()}
    assert [got[i] for i in (2, 3)] == pytest.approx([3.0, 4.0])  # a straight run stays straight
    assert got[6] == pytest.approx(5.0)  # one neighbour on the right: a line
    assert gaps.gap_exposure(grid, 1).first().asDict() == {"user_id": 1, "steps": 7, "observed": 2, "short": 2, "long": 3, "edge": 0}


def test_perturbations_keep_counts(spark):
    rows = spark.createDataFrame([(1, 3000, 5, i, i * 60_000, float(i), i * 60_000, 0) for i in range(20)], "user_id long, channel long, day long, event_id long, start_ms long, value double, local_ms long, hour long")
    assert sorted(r.value for r in epochs.perturb_events(rows, "shuffle", "t").collect()) == [float(i) for i in range(20)]
    assert {r.value for r in epochs.perturb_events(rows, "resample", "t").collect()} <= {float(i) for i in range(20)}
    assert epochs.perturb_events(rows, "resample", "t").count() == 20 and 0 < epochs.perturb_events(rows, "thin", "t", 0.5).count() < 20
    with pytest.raises(ValueError):
        epochs.perturb_events(rows, "none", "t")


def test_period_persistence(spark):
    df = spark.createDataFrame([(u, w, 28.0 if u < 3 else 20.0 + 5 * w) for u in range(4) for w in (1, 2)], "user_id long, window_index long, period double")
    assert inference.period_persistence(df).first().share == 0.75


def test_transitions(spark):
    df = spark.createDataFrame([(1, x, v) for x, v in enumerate([2.0, 1.0, -1.0, -3.0, 0.5])] + [(2, 0, 1.0), (2, 1, 0.5)], "k long, x long, v double")
    got = {r.k: r for r in inference.transitions(df, ["k"], "x", "v").collect()}
    assert (got[1].lowest_at, got[1].crossing) == (3, 1.5) and (got[2].lowest_at, got[2].crossing) == (None, None)


def test_prepare_and_models(spark):
    rows = [(i, float(i % 2), float(i % 2) * 3 + (i % 5) if i % 9 else None, "ab"[i % 2], 1.0) for i in range(80)]
    df = spark.createDataFrame(rows, "user_id long, y double, a double, g string, flat double")
    new = spark.createDataFrame([(100, 1.0, None, "z", 2.0)], df.schema)
    ready, names = modelling.prepare(df, df.unionByName(new), ["a", "flat"], ["g"])
    assert names == ["x_a", "x_a_missing", "x_g_a", "x_g_b"]
    last = ready.where("user_id = 100").first()
    assert (last.x_g_a, last.x_g_b, last.x_a_missing) == (0.0, 0.0, 1.0)
    train = ready.where("user_id < 100")
    model = modelling.ridge_fit(train, train, ["x_a", "x_g_b"])
    scored = modelling.linear_score(model, train, ["x_a", "x_g_b"])
    assert evaluation.auroc(scored.withColumn("arm", F.lit("m"))).first().auroc == 1.0
    assert [r.score for r in scored.orderBy("user_id").limit(5).collect()] == pytest.approx([r.prediction for r in model.transform(modelling._assembled(train, ["x_a", "x_g_b"])).orderBy("user_id").limit(5).collect()])
    dealt = modelling.permute(train.select("user_id", "x_a"), "x_a", "user_id", "t")
    assert sorted(r.x_a for r in dealt.collect()) == sorted(r.x_a for r in train.collect())
    with pytest.raises(ValueError):
        modelling.prepare(df, df, [], ["user_id"], max_levels=5)


def test_uploads(spark):
    rows = [(1, "2024-01-02T03:04:05+02:00", "61"), (1, "2024-01-02T03:04:05Z", "x"), (1, "2024-01-02T03:04:05", "60"), (1, "1999-01-02T03:04:05Z", "60"), (1, "nothing", "60"), (None, None, None)]
    got = files.normalize_upload(spark.createDataFrame(rows, "user_id long, timestamp string, hr string")).collect()
    assert [r.reason for r in got] == [None, "hr", "offset", "year", "timestamp", "timestamp"]
    assert (got[0].start_ms, got[0].tz_min, got[0].end_ms) == (1704157445000, 120.0, 1704157445000)


def test_files_of_differing_columns(spark, tmp_path):
    (tmp_path / "1.csv").write_text("startTimestamp,type,longValue\n5,3000,61\n6,3000,bad\n")
    (tmp_path / "2.csv").write_text('note,longValue,source,"startTimestamp",type\n"a, b",70,3,9,3001\n')
    (tmp_path / "3.csv").write_text("startTimestamp,type,longValue\n")
    (tmp_path / "4.csv").write_text("startTimestamp,type\n1,2\n")
    (tmp_path / "5.csv").write_text("")
    (tmp_path / "6.csv").write_text("startTimestamp,type,longValue\n,,\n")
    path = str(tmp_path)
    rows = files.scan_coerced(spark, path)
    assert sorted((r.user_id, r.startTimestamp, r.longValue, r.source) for r in rows.where("user_id < 3").collect() if r.longValue is not None) == [(1, 5.0, 61.0, None), (2, 9.0, 70.0, 3.0)]
    names = rows.select("file").distinct().unionByName(files.headers(spark, path).select("file")).distinct()
    got = {r.file.rsplit("/", 1)[1]: r.status for r in files.scan_status(names, rows, files.headers(spark, path)).collect()}
    assert got == {"1.csv": "ok", "2.csv": "ok", "3.csv": "header_only", "4.csv": "missing_required_columns", "6.csv": "no_valid_core_event"}
    inventory = {r.user_id: r.state for r in files.file_inventory(spark, path, spark.createDataFrame([(1,), (5,), (8,)], "user_id long")).collect()}
    assert inventory == {1: "nonempty", 5: "zero_byte", 8: "missing"}


def test_folds_are_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1, 0)], "user_id long, fold long")
    files.sink_folds(df, str(tmp_path / "f"))
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        files.sink_folds(df, str(tmp_path / "f"))


def test_empty_days(spark):
    none = spark.createDataFrame([], "user_id long, channel long, day long, n long, cov_s double, hours long, mean double, sd double, median double, vmin double, vmax double, adequate boolean")
    assert features.channel_summary(none).count() == 0 and windows.nested_k(none.select("user_id", "day"), (3,)).count() == 0
    assert rhythms.phase_coherence(rhythms.spectrum(spark.createDataFrame([], "user_id long, day long, residual double"), [7.0]).selectExpr("*", "1 as team"), "team").count() == 0


def test_registry_has_all():
    assert set(q.ORACLE_SQL) <= set(q.QUERIES) and len(q.QUERIES) > 200
