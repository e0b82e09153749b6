"""Subgroups of thirds, checks of assignments and both null rules of circular smoothing against plain versions."""

from __future__ import annotations

import numpy as np
import pytest

from tidewell.operators import features, gaps, splits


def test_subgroups_are_31(spark):
    rng = np.random.default_rng(3)
    rows = [(u, *[None if u == 7 and i == 2 else float(v) for i, v in enumerate(rng.integers(0, 9, 4))]) for u in range(200)]
    names = {"history": "a", "occupancy": "b", "continuity": "c", "variability": "d"}
    df = spark.createDataFrame(rows, "user_id long, a double, b double, c double, d double")
    got = features.subgroups(df, df.where("user_id < 100"), names, (("history", "occupancy"), ("continuity", "occupancy"))).collect()
    cuts = [np.quantile([r[i + 1] for r in rows[:100] if r[i + 1] is not None], (1 / 3, 2 / 3)) for i in range(4)]
    want = []
    for u, *v in rows:
        level = {n: None if x is None else "low" if x <= c[0] else "middle" if x <= c[1] else "high" for n, x, c in zip(names, v, cuts, strict=True)}
        own = {"overall": "all", **level} | {f"{a}_x_occupancy": f"{level[a]}/{level['occupancy']}" if level[a] else None for a in ("history", "continuity")}
        want += [(u, k, x) for k, x in own.items() if x]
    assert sorted((r.user_id, r.dimension, r.level) for r in got) == sorted(want)
    assert len({(r.dimension, r.level) for r in got}) == 31


def test_split_checks_find_each_fault(spark):
    rows = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (3, 0), (3, 1), (4, None), (5, 2), (6, 1), (7, 0), (8, 1), (None, 1)], "k long, y long")
    good = [(1, "train"), (2, "train"), (3, "val"), (4, "val"), (5, "test"), (6, "val"), (7, "test"), (8, "test")]
    of = lambda a: {r.check: r.violations for r in splits.split_checks(rows, "k", "y", spark.createDataFrame(a, "k long, split string")).collect()}
    base = {"missing_entity": 1, "missing_label": 1, "conflicting_label": 1, "other_label": 1, "unassigned": 0, "unknown_entity": 0, "assigned_twice": 0, "unknown_split": 0, "single_class": 1}
    assert of(good) == base
    assert of(good[1:] + [(9, "train"), (2, "odd"), (6, None)]) == base | {"unassigned": 1, "unknown_entity": 1, "assigned_twice": 2, "unknown_split": 2, "single_class": 3 - 1}
    assert of([]) == base | {"unassigned": 8, "single_class": 3}
    none = spark.createDataFrame([], "k long, y long")
    assert {r.check: r.violations for r in splits.split_checks(none, "k", "y", spark.createDataFrame([], "k long, split string")).collect()} == dict.fromkeys(base, 0) | {"single_class": 3}


@pytest.mark.parametrize("nulls", ("normalize", "omit"))
@pytest.mark.parametrize("sigma", (0.0, 1.5, 9.0))
def test_smoothing_of_profiles_with_gaps(spark, nulls, sigma):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(24) < 0.4, np.nan, rng.normal(60, 9, 24))
    df = spark.createDataFrame([(b, None if np.isnan(v) else float(v)) for b, v in enumerate(x)], "bin long, hr double")
    got = {r.bin: r.smooth for r in gaps.circular_smooth(df, 24, sigma, nulls=nulls).collect()}
    reach = int(4 * sigma + 0.5)
    for b in range(24):
        own = [(np.exp(-0.5 * (k / sigma) ** 2) if k else 1.0, x[(b - k) % 24]) for k in range(-reach, reach + 1) if not np.isnan(x[(b - k) % 24])]
        want = None if not own or (nulls == "omit" and np.isnan(x[b])) else sum(w * v for w, v in own) / sum(w for w, _ in own)
        assert got.get(b) == (None if want is None else pytest.approx(want))


def test_smoothing_refuses_other_rules(spark):
    with pytest.raises(ValueError, match="normalize or omit"):
        gaps.circular_smooth(spark.range(1), 24, 1.0, nulls="drop")
