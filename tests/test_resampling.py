"""Draws that keep strata and folds of given weights, against plain versions."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import evaluation, folds, inference, resampling

M = 2**32


def mix_plain(x):
    for by, times in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
        x = ((x ^ (x >> by)) * times) % M
    return x


def hits_plain(stratum, n, draw, tag, chunk):
    """Hits of one draw: each goes down the tree of ranks by its own trial."""
    out = Counter()

    def down(k, a, h):
        if not h:
            return
        if not k:
            out[a] = h
            return
        half = 1 << (k - 1)
        left = h
        if n - a > half:
            seed = int(hashlib.md5(f"{tag}|{stratum}|{k}|{a}".encode()).hexdigest()[:8], 16)
            base = mix_plain((mix_plain(seed) + draw) % M)
            left = sum((mix_plain((base + i) % M) + 0.5) / M < half / min(n - a, 2 * half) for i in range(h))
        down(k - 1, a, left)
        down(k - 1, a + half, h - left)

    down(max((n - 1).bit_length(), chunk.bit_length() - 1), 0, n)
    return [out[r] for r in range(n)]


@pytest.mark.parametrize("chunk", [512, 16])
def test_hits_against_single_trials(monkeypatch, chunk):
    monkeypatch.setattr(resampling, "CHUNK", chunk)
    for n in (1, 2, 15, 16, 17, 100):
        got = np.concatenate([resampling.hits("s", n, c, 5, "t") for c in range(-(-n // chunk))])
        assert got.shape[0] >= n and not got[n:].any() and (got.sum(axis=0) == n).all()
        assert [got[:n, b].tolist() for b in range(5)] == [hits_plain("s", n, b, "t", chunk) for b in range(5)]


def test_hits_are_multinomial(monkeypatch):
    """Means, variances and covariances of counts, from trials and from the sampler of large counts."""
    for trials in (2048, 3):
        monkeypatch.setattr(resampling, "TRIALS", trials)
        n, draws = 12, 20_000
        x = resampling.hits("s", n, 0, draws, f"m{trials}")[:n]
        assert (x.sum(axis=0) == n).all()
        cov = np.cov(x)
        assert np.abs(x.mean(axis=1) - 1).max() < 0.04
        assert np.abs(cov - (np.eye(n) - 1 / n)).max() < 0.05


def test_large_strata_keep_their_size(monkeypatch):
    monkeypatch.setattr(resampling, "TRIALS", 64)
    n = 5000
    got = np.concatenate([resampling.hits("s", n, c, 7, "t") for c in range(-(-n // resampling.CHUNK))])
    assert (got.sum(axis=0) == n).all() and (got >= 0).all() and not got[n:].any()


def test_large_strata_against_single_trials():
    """Strata of more than TRIALS ids hold the same draws as one trial after another."""
    n = resampling.TRIALS + 60
    got = np.concatenate([resampling.hits("s", n, c, 2, "t") for c in range(-(-n // resampling.CHUNK))])
    assert [got[:n, b].tolist() for b in range(2)] == [hits_plain("s", n, b, "t", resampling.CHUNK) for b in range(2)]


def test_blocks_of_draws_are_those_of_one(spark):
    """Draws that other tasks take down the tree are those of one task."""
    n = 1300
    placed = spark.createDataFrame([("s", i, n, "{}", float(i * i), 1) for i in range(n)], "_stratum string, _at long, _n long, _j string, _s double, _c long")
    draws = resampling.BLOCK + 3
    got = {r.draw: (r._s, r.n) for r in resampling.sums(placed, draws, "t").collect()}
    ranks = np.concatenate([resampling.hits("s", n, c, draws, "t") for c in range(3)])[:n]
    assert got == {b: (float((np.arange(n) ** 2) @ ranks[:, b]), n) for b in range(draws)}


def test_order_of_sums_does_not_show_in_bands(spark):
    """Means that differ in the last bits, as sums in another order do, give the same bounds to six decimals."""
    exact = [0.4481] * 1950 + [0.44812] * 50
    bounds = []
    for noise in (0.0, 6e-17, -6e-17):
        draws = spark.createDataFrame([("a", "x", i, v + noise) for i, v in enumerate(exact)], "arm string, grp string, draw int, mean double")
        r = evaluation.bootstrap_bands(draws, spark.createDataFrame([("a", "x", 0.44)], "arm string, grp string, point double"), ["arm"], "grp").first()
        bounds.append((r.low, r.high))
    assert len(set(bounds)) == 1


def arms(spark, n=100):
    """Two strata in which the score is the stratum, in two arms; the second arm scores 1 more; repeated rows of one id, a null score."""
    rows = [(arm, i, int(i >= n), float(i >= n) + add) for arm, add in (("a", 0.0), ("b", 1.0)) for i in range(2 * n)]
    return spark.createDataFrame(rows, "arm string, id long, y int, score double")


def test_draws_keep_strata(spark):
    got = evaluation.bootstrap_means(arms(spark), "y", "id", "score", 300, "t", ["arm"]).collect()
    assert len(got) == 600 and all(r.n == 200 and r["mean"] == (0.5 if r.arm == "a" else 1.5) for r in got)
    single = evaluation.bootstrap_means(arms(spark).where("y = 1"), "y", "id", "score", 50, "t").collect()
    assert len(single) == 50 and all((r.n, r["mean"]) == (200, 1.5) for r in single)


def test_arms_share_draws_and_ids_count_as_units(spark):
    rng = np.random.default_rng(0)
    own = [(i, int(rng.integers(3)) or None, float(rng.normal())) for i in range(700)]
    rows = [(arm, *r) for arm in ("a", "b") for r in own] + [("a", *own[3])] * 2 + [("b", 900, 1, None)]
    df = spark.createDataFrame(rows, "arm string, id long, s int, v double")
    got = {(r.arm, r.draw): (r["mean"], r.n) for r in evaluation.bootstrap_means(df, "s", "id", "v", 40, "u", ["arm"]).collect()}
    ids = {i: s for _, i, s, _ in rows}
    want = {}
    for s in set(ids.values()):
        ranked = sorted((i for i in ids if ids[i] == s), key=lambda i: (hashlib.sha256(f"u|{i}".encode()).hexdigest(), i))
        for b in range(40):
            for i, h in zip(ranked, hits_plain("\0" if s is None else str(s), len(ranked), b, "u", 512), strict=True):
                for arm, j, _, v in rows:
                    if j == i and v is not None and h:
                        t = want.setdefault((arm, b), [0.0, 0])
                        t[0] += h * v
                        t[1] += h
    assert set(got) == set(want) and all(got[k][1] == n and abs(got[k][0] - v / n) < 1e-9 for k, (v, n) in want.items())
    same = inference.paired_difference(evaluation.bootstrap_means(arms(spark), "y", "id", "score", 60, "t", ["arm"]), "b", "a").first()
    assert abs(same["mean"] - 1) < 1e-12 and abs(same.low - 1) < 1e-12 and abs(same.high - 1) < 1e-12


def test_draws_of_nothing(spark):
    assert evaluation.bootstrap_means(arms(spark).where("false"), "y", "id", "score", 5, "t", ["arm"]).collect() == []


def test_feasible_flow():
    assert folds.feasible_flow(4, [(0, 1, 2, 2), (0, 2, 1, 3), (1, 3, 0, 5), (2, 3, 2, 2)], 0, 3) == [2, 2, 2, 2]
    assert folds.feasible_flow(3, [(0, 1, 2, 2), (1, 2, 0, 1)], 0, 2) is None


def test_round_tables():
    rng = np.random.default_rng(1)
    wrong = sums = 0
    for _ in range(120):
        n, k = rng.integers(1, 25), rng.integers(1, 7)
        sizes, levels = rng.integers(0, 40, n), np.stack([rng.integers(0, top, n) for top in (4, 3, 3)], 1).astype(object)
        sizes[0] += 1
        t = folds.fold_sizes(int(sizes.sum()), rng.uniform(0.2, 2, k))
        x, target = folds.round_table(sizes, levels, t), sizes[:, None] * t / sizes.sum()
        assert t.sum() == sizes.sum() and (x.sum(axis=0) == t).all() and (x.sum(axis=1) == sizes).all() and (np.abs(x - target) < 1).all()
        for v in range(3):
            off = np.array([np.abs((x - target)[levels[:, v] == lv].sum(axis=0)).max() for lv in np.unique(levels[:, v])])
            assert v or (off < 1).all()
            wrong, sums = wrong + (off >= 1).sum(), sums + len(off)
    assert wrong <= 0.005 * sums  # of crossing variables, for which no solution is certain


def test_fold_sizes():
    assert folds.fold_sizes(10, [1, 1, 1]).tolist() == [4, 3, 3] and folds.fold_sizes(7, [5, 2, 2, 1]).tolist() == [4, 1, 1, 1] and folds.fold_sizes(0, [1, 2]).tolist() == [0, 0]


def test_weighted_folds(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(3)) or None, "ab"[rng.integers(2)], [None, "p", "q"][min(2, rng.integers(5))]) for i in range(611)]
    df = spark.createDataFrame(rows, "id long, s int, t string, part string").repartition(5)
    got = folds.weighted_folds(df, "id", ["s", "t"], [0.6, 0.3, 0.1], "w", ["part"])
    again = {r.id: r.fold for r in folds.weighted_folds(df.repartition(2), "id", ["s", "t"], [0.6, 0.3, 0.1], "w", ["part"]).collect()}
    own = {r.id: r for r in got.collect()}
    assert {i: r.fold for i, r in own.items()} == again and len(own) == 611 and all((own[i].s, own[i].t, own[i].part) == (s, t, p) for i, s, t, p in rows)
    for part in (None, "p", "q"):
        mine = [r for r in own.values() if r.part == part]
        sizes = folds.fold_sizes(len(mine), [0.6, 0.3, 0.1])
        assert [sum(r.fold == f for r in mine) for f in range(3)] == sizes.tolist()
        for names in (("s",), ("t",), ("s", "t")):
            for level in {tuple(r[c] for c in names) for r in mine}:
                n = [sum(r.fold == f and tuple(r[c] for c in names) == level for r in mine) for f in range(3)]
                assert all(abs(a - sum(n) * z / len(mine)) < 1 for a, z in zip(n, sizes, strict=True))
    report = folds.fold_margins(got, ["s", "t"], [0.6, 0.3, 0.1], ["part"])
    assert report.where("NOT within").count() == 0
    assert report.where(F.col("variable") == "(all)").agg(F.sum("n")).first()[0] == 611
    moved = got.withColumn("fold", F.lit(0).cast("long"))
    assert folds.fold_margins(moved, ["s", "t"], [0.6, 0.3, 0.1], ["part"]).where("NOT within AND variable = 's'").count() == 0  # one fold holds all: targets follow the sizes
    with pytest.raises(ValueError):
        folds.weighted_folds(df, "id", ["s"], [1, 0], "w")
    assert folds.weighted_folds(df.where("false"), "id", ["s"], [1, 2], "w").collect() == []
