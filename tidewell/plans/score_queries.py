"""Registered queries of scores, bands, balance, masks and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators import cohorts, epochs as ep, evaluation as ev, folds as wf, gaps, inference as inf, quality, splits
from tidewell.plans import fits_sql as fs, views as vw
from tidewell.plans.file_queries import OWNER, event_files
from tidewell.plans.inference_queries import OLS, people, preds
from tidewell.plans.queries import COV, CUM, DM, E, GRID, MAN, P, RUNS, add, angles, ANG, days, events, grid, manifest
from tidewell.sources import files

_d = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / ({b}) END"
add("classification_metrics", lambda s, d: ev.classification_metrics(preds(s, d)), f"""SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy, {_d("tp", "tp + fp")} AS precision, {_d("tp", "tp + fn")} AS recall, {_d("2 * tp", "2 * tp + fp + fn")} AS f1,
  {_d("tn", "tn + fn")} AS precision_0, {_d("tn", "tn + fp")} AS recall_0, {_d("2 * tn", "2 * tn + fn + fp")} AS f1_0
FROM (SELECT arm, count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y = 0 AND score >= 0.5) AS fp, count(*) FILTER (y = 1 AND score < 0.5) AS fn, count(*) FILTER (y = 0 AND score < 0.5) AS tn FROM predictions GROUP BY 1)""", P, "accuracy balanced_accuracy precision recall f1 precision_0 recall_0 f1_0")

# Thresholds: even users are val, odd ones test.
halves = lambda s, d: preds(s, d).withColumn("split", F.when(F.col("user_id") % 2 == 0, "val").otherwise("test"))
TH = P + """, tv AS (SELECT arm, score, count(*) FILTER (user_id % 2 = 0 AND y = 1) AS pv, count(*) FILTER (user_id % 2 = 0 AND y = 0) AS nv, count(*) FILTER (user_id % 2 = 1 AND y = 1) AS pt, count(*) FILTER (user_id % 2 = 1 AND y = 0) AS nt FROM predictions GROUP BY ALL),
cv AS (SELECT arm, 1 AS side, score AS tau, sum(pv) OVER h AS rv, sum(nv) OVER h AS wv, sum(pt) OVER h AS rt, sum(nt) OVER h AS wt, sum(pt + nt) OVER a AS tot, sum(pt) OVER a AS cls, pv + nv AS own FROM tv WINDOW h AS (PARTITION BY arm ORDER BY score DESC ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY arm)
  UNION ALL SELECT arm, 0, score, sum(nv) OVER l, sum(pv) OVER l, sum(nt) OVER l, sum(pt) OVER l, sum(pt + nt) OVER a, sum(nt) OVER a, pv + nv FROM tv WINDOW l AS (PARTITION BY arm ORDER BY score ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY arm)),
tc AS (SELECT arm, side::BIGINT AS side, tau, (rv + wv)::BIGINT AS n_val, rv::BIGINT AS right_val, rv / (rv + wv) AS precision_val, (rt + wt)::BIGINT AS n_test, rt::BIGINT AS right_test, rt / nullif(rt + wt, 0) AS precision_test, (rt + wt) / nullif(tot, 0) AS coverage_test, rt / nullif(cls, 0) AS recall_test FROM cv WHERE own > 0)
"""
add("threshold_curves", lambda s, d: ev.threshold_curves(halves(s, d)), "SELECT * FROM tc", TH, "precision_val precision_test coverage_test recall_test")
both_bounds = lambda s, d: ev.select_thresholds(halves(s, d), 0.6).withColumn("bound", F.lit("raw")).unionByName(ev.select_thresholds(halves(s, d), 0.6, bound="cp").withColumn("bound", F.lit("cp")))
add("select_thresholds", both_bounds, """SELECT *, (precision_test + 3.8416 / (2 * nullif(n_test, 0))) / (1 + 3.8416 / nullif(n_test, 0)) - 1.96 * sqrt(precision_test * (1 - precision_test) / nullif(n_test, 0) + 3.8416 / (4 * n_test * nullif(n_test, 0))) / (1 + 3.8416 / nullif(n_test, 0)) AS low,
  (precision_test + 3.8416 / (2 * nullif(n_test, 0))) / (1 + 3.8416 / nullif(n_test, 0)) + 1.96 * sqrt(precision_test * (1 - precision_test) / nullif(n_test, 0) + 3.8416 / (4 * n_test * nullif(n_test, 0))) / (1 + 3.8416 / nullif(n_test, 0)) AS high
FROM (SELECT bound, arm, side, b.tau AS tau, b.n_val AS n_val, b.precision_val AS precision_val, b.n_test AS n_test, b.right_test AS right_test, b.precision_test AS precision_test, b.coverage_test AS coverage_test, b.recall_test AS recall_test FROM (SELECT bound, arm, side, arg_min(tc, CASE side WHEN 1 THEN tau ELSE -tau END) FILTER (ok) AS b
  FROM (SELECT bound, tc, arm, side, tau, CASE bound WHEN 'raw' THEN precision_val >= 0.6 ELSE list_sum(list_transform(range(right_val, n_val + 1), lambda k: exp(lgamma(n_val + 1) - lgamma(k + 1) - lgamma(n_val - k + 1) + k * ln(0.6) + (n_val - k) * ln(0.4)))) <= 0.05 END AS ok FROM tc, (VALUES ('raw'), ('cp')) v(bound)) GROUP BY ALL))""", TH, "tau precision_val precision_test coverage_test recall_test low high")
add("proper_scores", lambda s, d: ev.proper_scores(preds(s, d)), "SELECT *, 1 - brier / nullif(base * (1 - base), 0) AS skill, 2 * n * (-(CASE WHEN base > 0 THEN base * ln(base) ELSE 0 END) - (CASE WHEN base < 1 THEN (1 - base) * ln(1 - base) ELSE 0 END) - log_loss) AS deviance_reduction FROM (SELECT arm, count(*) AS n, avg((score - y) * (score - y)) AS brier, avg(y) AS base, avg(-CASE WHEN y = 1 THEN ln(greatest(least(score, 0.999999), 0.000001)) ELSE ln(1 - greatest(least(score, 0.999999), 0.000001)) END) AS log_loss FROM predictions GROUP BY 1)", P, "brier base log_loss skill deviance_reduction")
add("ece_10", lambda s, d: ev.ece(preds(s, d)), "SELECT arm, sum(n * gap) / sum(n) AS ece FROM (SELECT arm, b, count(*) AS n, abs(avg(score) - avg(y)) AS gap FROM (SELECT arm, score, y, (row_number() OVER (PARTITION BY arm ORDER BY score, sha256('ece|' || user_id), user_id) - 1) * 10 // count(*) OVER (PARTITION BY arm) AS b FROM predictions) GROUP BY ALL) GROUP BY 1", P, "ece")
Q = "quantile_cont(score, 0.25) AS p25, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.75) AS p75"
add("smd", lambda s, d: ev.smd(preds(s, d), "grp", "src0", "score"), f"SELECT a.*, (a.mean - b.mean) / nullif(sqrt((a.sd ** 2 + b.sd ** 2) / 2), 0) AS smd FROM (SELECT grp, count(score) AS n, avg(score) AS mean, stddev_samp(score) AS sd, {Q} FROM predictions GROUP BY 1) a, (SELECT avg(score) AS mean, stddev_samp(score) AS sd FROM predictions WHERE grp = 'src0') b", P, "mean sd smd p25 p50 p75")
add("group_summary", lambda s, d: ev.group_summary(preds(s, d).withColumn("p", 1 - F.col("score")), "grp", "score", "p", 0.2), f"SELECT CASE WHEN grouping(grp) = 1 THEN 'ALL' ELSE grp END AS grp, count(score) AS n, avg(score) AS mean, stddev_samp(score) AS sd, avg((1 - score < 0.2)::INT) AS share_below, sqrt(avg((1 - score < 0.2)::INT) * (1 - avg((1 - score < 0.2)::INT)) / count(*)) AS share_se, {Q} FROM predictions GROUP BY GROUPING SETS ((grp), ())", P, "mean sd share_below share_se p25 p50 p75")
_z = 1.959963984540054
_T = " + ".join(f"{c!r} / df ** {i}" for i, c in enumerate((_z, (_z**3 + _z) / 4, (5 * _z**5 + 16 * _z**3 + 3 * _z) / 96, (3 * _z**7 + 19 * _z**5 + 17 * _z**3 - 15 * _z) / 384)))
add("welch_t", lambda s, d: ev.welch(preds(s, d), ["arm"], "y", "score"), f"SELECT * EXCLUDE (se), diff - ({_T}) * se AS low, diff + ({_T}) * se AS high FROM (SELECT arm, n0, n1, sqrt(v1 / n1 + v0 / n0) AS se, m1 - m0 AS diff, (m1 - m0) / sqrt(v1 / n1 + v0 / n0) AS t, (v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)) AS df, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d FROM (SELECT arm, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, avg(score) FILTER (y = 0) AS m0, avg(score) FILTER (y = 1) AS m1, var_samp(score) FILTER (y = 0) AS v0, var_samp(score) FILTER (y = 1) AS v1 FROM predictions GROUP BY 1))", P, "diff t df d low high")
_x, _t = "(abs(z) / sqrt(2))", "(1 / (1 + 0.3275911 * abs(z) / sqrt(2)))"
NORMAL = f"(0.254829592 * {_t} - 0.284496736 * {_t} ** 2 + 1.421413741 * {_t} ** 3 - 1.453152027 * {_t} ** 4 + 1.061405429 * {_t} ** 5) * exp(-({_x} ** 2))"
add("mann_whitney", lambda s, d: ev.mann_whitney(preds(s, d)), f"SELECT arm, u, z, {NORMAL} AS p FROM (SELECT arm, u, sign(u - p * n / 2) * greatest(abs(u - p * n / 2) - 0.5, 0) / sqrt(p * n / 12 * (p + n + 1 - ties / ((p + n) * (p + n - 1)))) AS z FROM (SELECT arm, sum(pos * (below + neg / 2)) AS u, sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n, sum((pos + neg)::DOUBLE ** 3 - (pos + neg)) AS ties FROM c GROUP BY 1))", CUM, "u z p")

# Balance
cells = lambda s, d: vw.demographics(s, d).withColumn("split", F.col("user_id") % 3)
VARS = ["age_group", "bmi_grp"]
BAL = DM + """, k AS (SELECT user_id % 3 AS split, coalesce(age_group::VARCHAR, '<MISSING>') AS a, coalesce(bmi_grp, '<MISSING>') AS b, coalesce(salutation::VARCHAR, '<MISSING>') AS c FROM demographics),
l AS (SELECT split, 'age_group' AS variable, a AS level FROM k UNION ALL SELECT split, 'bmi_grp', b FROM k UNION ALL SELECT split, 'salutation', c FROM k UNION ALL SELECT split, 'salutation x age_group', c || '|' || a FROM k UNION ALL SELECT split, 'salutation x bmi_grp', c || '|' || b FROM k),
sh AS (SELECT variable, level, split, 100 * coalesce(count(l2.split), 0) / max(total) AS s FROM (SELECT DISTINCT variable, level FROM l) CROSS JOIN (SELECT split, count(*) AS total FROM k GROUP BY 1) LEFT JOIN l l2 USING (variable, level, split) GROUP BY ALL)
"""
balance = lambda s, d: ev.balance_report(cells(s, d), "split", VARS, "salutation")
add("balance_report", balance, "SELECT variable, level, max(s) - min(s) AS max_pp FROM sh GROUP BY ALL", BAL, "max_pp")
add("worst_balance", lambda s, d: ev.worst_balance(balance(s, d).withColumn("max_pp", fn.r6(F.col("max_pp"))), 15), "SELECT variable, level, round(max(s) - min(s), 6) AS max_pp FROM sh GROUP BY ALL ORDER BY max_pp DESC, variable, level LIMIT 15", BAL)
add("balance_joint", lambda s, d: ev.joint_strata(cells(s, d), "split", [*VARS, "salutation"]), "SELECT split, strata, large, strata - count(*) AS zero_cells, large - count(*) FILTER (n >= 10) AS zero_large FROM (SELECT DISTINCT split, a, b, c FROM k) JOIN (SELECT a, b, c, count(*) AS n FROM k GROUP BY ALL) USING (a, b, c), (SELECT count(*) AS strata, count(*) FILTER (n >= 10) AS large FROM (SELECT count(*) AS n FROM k GROUP BY a, b, c)) GROUP BY split, strata, large", BAL)

# Folds of weights 5, 2, 2, 1 within salutations: every level's count against its target
WEIGHTS = (5, 2, 2, 1)
add("weighted_folds", lambda s, d: wf.fold_margins(wf.weighted_folds(vw.demographics(s, d).fillna(-1, ["salutation"]), "user_id", VARS, WEIGHTS, "wf", ["salutation"]), VARS, WEIGHTS, ["salutation"]).drop("n"), """SELECT salutation, variable, level, fold, CASE WHEN variable = '(all)' THEN size ELSE n * size / total END AS target, true AS within
FROM (SELECT salutation, unnest(['(all)', 'age_group', 'bmi_grp', 'age_group x bmi_grp']) AS variable, unnest(['(all)', a, b, a || '|' || b]) AS level FROM q) JOIN (SELECT salutation, variable, level, count(*) AS n FROM (SELECT salutation, unnest(['(all)', 'age_group', 'bmi_grp', 'age_group x bmi_grp']) AS variable, unnest(['(all)', a, b, a || '|' || b]) AS level FROM q) GROUP BY ALL) c USING (salutation, variable, level) JOIN fs USING (salutation) GROUP BY ALL""",
    DM + """, q AS (SELECT coalesce(salutation, -1) AS salutation, coalesce(age_group::VARCHAR, '<MISSING>') AS a, coalesce(bmi_grp, '<MISSING>') AS b FROM demographics),
fs AS (SELECT salutation, total, fold, floor(x) + (row_number() OVER (PARTITION BY salutation ORDER BY round(x - floor(x), 9) DESC, fold) <= total - sum(floor(x)) OVER (PARTITION BY salutation))::INT AS size FROM (SELECT salutation, count(*) AS total, unnest([0, 1, 2, 3]) AS fold, count(*) * unnest([5, 2, 2, 1]) / 10 AS x FROM q GROUP BY 1))
""", "target")

# Circles
add("rayleigh", lambda s, d: ev.rayleigh(angles(s, d), ["user_id"]), """SELECT *, greatest(0, least(1, CASE WHEN n <= 50 THEN exp(sqrt(greatest(0, 1 + 4 * n + 4 * (n::DOUBLE * n - n * z))) - (1 + 2 * n)) WHEN z > 50 THEN 0 ELSE exp(-z) * (1 + (2 * z - z ** 2) / (4 * n) - (24 * z - 132 * z ** 2 + 76 * z ** 3 - 9 * z ** 4) / (288 * n::DOUBLE * n)) END)) AS p
FROM (SELECT user_id, count(*) AS n, sqrt(avg(cos(angle)) ** 2 + avg(sin(angle)) ** 2) AS length, atan2(avg(sin(angle)), avg(cos(angle))) AS mean_angle, 1 - sqrt(avg(cos(angle)) ** 2 + avg(sin(angle)) ** 2) AS variance, count(*) * (avg(cos(angle)) ** 2 + avg(sin(angle)) ** 2) AS z FROM an GROUP BY 1)""", ANG, "length mean_angle variance z p")
add("phase_histogram", lambda s, d: ev.phase_histogram(angles(s, d), ["user_id"]).select("user_id", "bin", "n", "density"), "SELECT user_id, bin, n, n / sum(n) OVER (PARTITION BY user_id) / (2 * pi() / 24) AS density FROM (SELECT user_id, least(floor((angle + pi()) / (2 * pi() / 24)), 23)::BIGINT AS bin, count(*) AS n FROM an GROUP BY ALL)", ANG, "density")
team_angles = lambda s, d: angles(s, d).select((F.col("user_id") % 4).alias("team"), "angle")
add("phase_uniformity", lambda s, d: ev.phase_uniformity(team_angles(s, d), ["team"]).select("team", "n", "length", "z", "p", "mode_bin", "chi_square"), """SELECT team, r.n, length, z, greatest(0, least(1, CASE WHEN r.n <= 50 THEN exp(sqrt(greatest(0, 1 + 4 * r.n + 4 * (r.n::DOUBLE * r.n - r.n * z))) - (1 + 2 * r.n)) WHEN z > 50 THEN 0 ELSE exp(-z) * (1 + (2 * z - z ** 2) / (4 * r.n) - (24 * z - 132 * z ** 2 + 76 * z ** 3 - 9 * z ** 4) / (288 * r.n::DOUBLE * r.n)) END)) AS p, mode_bin, chi_square
FROM (SELECT user_id % 4 AS team, count(*) AS n, sqrt(avg(cos(angle)) ** 2 + avg(sin(angle)) ** 2) AS length, count(*) * (avg(cos(angle)) ** 2 + avg(sin(angle)) ** 2) AS z FROM an GROUP BY 1) r
JOIN (SELECT team, arg_max(bin, (n, -bin)) AS mode_bin, sum(n ** 2) * 24 / sum(n) - sum(n) AS chi_square FROM (SELECT user_id % 4 AS team, least(floor((angle + pi()) / (2 * pi() / 24)), 23)::BIGINT AS bin, count(*) AS n FROM an GROUP BY ALL) GROUP BY 1) USING (team)""", ANG, "length z p chi_square")

# Resampling: 2,000 draws that keep strata; the SQL splits hits by counted trials, as the operator does for strata of up to 2,048 ids
DRAWS = 2000
boot = lambda s, d, keys=("arm",): ev.bootstrap_means(preds(s, d), "y", "user_id", "score", DRAWS, "boot", keys)
_turn = lambda x, by, times=None: f"xor({x}, {x} >> {by})" + (f" * {times}::UBIGINT % 4294967296::UBIGINT" if times else "")


def _mixed(values: str) -> str:
    """SQL of resampling.mix over a list."""
    for by, times in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        values = f"list_transform({values}, lambda x: {_turn('x', by, times)})"
    return values


_seed = "[('0x' || substr(md5('boot|' || y || '|' || k || '|' || a), 1, 8))::UBIGINT]"
_base = _mixed(f"list_transform({_mixed(_seed)}, lambda x: (x + draw::UBIGINT) % 4294967296::UBIGINT)") + "[1]"
_trials = _mixed("list_transform(range(0, hits), lambda i: (base + i::UBIGINT) % 4294967296::UBIGINT)")
BOOT = P.replace("WITH ", "WITH RECURSIVE ", 1) + f""", dr AS (SELECT unnest(range(0, {DRAWS})) AS draw),
bu AS (SELECT y, user_id, row_number() OVER (PARTITION BY y ORDER BY sha256('boot|' || user_id), user_id) - 1 AS a FROM (SELECT DISTINCT y, user_id FROM predictions)),
bt AS (SELECT y, n, greatest(ceil(log2(n)), 9)::BIGINT AS k, 0::BIGINT AS a, draw, n AS hits FROM (SELECT y, count(*) AS n FROM bu GROUP BY 1), dr
  UNION ALL SELECT y, n, k - 1, c.a, draw, c.hits FROM (SELECT y, n, k, draw, unnest([{{'a': a, 'hits': l}}, {{'a': a + half, 'hits': hits - l}}]) AS c FROM (SELECT *, CASE WHEN n - a <= half THEN hits ELSE len(list_filter({_trials}, lambda x: (x::DOUBLE + 0.5) / 4294967296.0 < half / least(n - a, 2 * half))) END AS l
    FROM (SELECT *, 1::BIGINT << (k - 1) AS half, {_base} AS base FROM bt WHERE k > 0))) WHERE c.hits > 0),
bw AS (SELECT p.arm, p.grp, p.score, draw, coalesce(hits, 0) AS w FROM (SELECT * FROM predictions JOIN bu USING (y, user_id)) p CROSS JOIN dr LEFT JOIN (SELECT y, a, draw, hits FROM bt WHERE k = 0) USING (y, a, draw)),
bm AS (SELECT arm, draw, sum(w * score) / nullif(sum(w) FILTER (score IS NOT NULL), 0) AS mean FROM bw GROUP BY ALL), bg AS (SELECT arm, grp, draw, sum(w * score) / nullif(sum(w) FILTER (score IS NOT NULL), 0) AS mean FROM bw GROUP BY ALL)
"""
_iv = lambda v, p="": f"avg({v}) AS {p}mean, quantile_cont({v}, 0.025) AS {p}low, quantile_cont({v}, 0.975) AS {p}high"
add("stratified_bootstrap", lambda s, d: inf.group_means_bootstrap(boot(s, d).select("arm", F.col("mean").alias("value")), ["arm"]), f"SELECT arm, count(*) AS draws, {_iv('mean')} FROM bm GROUP BY 1", BOOT, "mean low high")
add("paired_difference", lambda s, d: inf.paired_difference(boot(s, d), "length", "mixed"), f"SELECT count(*) AS draws, {_iv('v')} FROM (SELECT a.mean - b.mean AS v FROM bm a JOIN bm b ON b.draw = a.draw AND a.arm = 'length' AND b.arm = 'mixed')", BOOT, "mean low high")
add("ratio_bootstrap", lambda s, d: inf.ratio_bootstrap(boot(s, d, ("arm", "grp")), "length", "mixed", "grp", "src0"), f"SELECT grp, count(*) AS draws, {_iv('v')}, {_iv('v / nullif(r, 0)', 'double_')} FROM (SELECT a.grp, a.draw, a.mean / nullif(b.mean, 0) AS v FROM bg a JOIN bg b ON b.draw = a.draw AND b.grp = a.grp AND a.arm = 'length' AND b.arm = 'mixed') JOIN (SELECT a.draw, a.mean / nullif(b.mean, 0) AS r FROM bg a JOIN bg b ON b.draw = a.draw AND b.grp = a.grp AND a.arm = 'length' AND b.arm = 'mixed' WHERE a.grp = 'src0') USING (draw) GROUP BY 1", BOOT, "mean low high double_mean double_low double_high")
points = lambda s, d: preds(s, d).groupBy("arm", "grp").agg(F.avg("score").alias("point"))
add("bootstrap_bands", lambda s, d: ev.bootstrap_bands(boot(s, d, ("arm", "grp")), points(s, d), ["arm"], "grp"), """SELECT *, point - critical * se AS sim_low, point + critical * se AS sim_high FROM ow JOIN (SELECT arm, quantile_cont(m, 0.95) AS critical FROM (SELECT arm, draw, max(abs(mean - point) / se) AS m FROM bg JOIN ow USING (arm, grp) GROUP BY ALL) GROUP BY 1) USING (arm)""", BOOT + ", ow AS (SELECT arm, grp, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high, greatest(stddev_samp(mean), 1e-12) AS se, count(*) AS draws, point FROM bg JOIN (SELECT arm, grp, avg(score) AS point FROM predictions GROUP BY ALL) USING (arm, grp) GROUP BY arm, grp, point)\n", "low high se point critical sim_low sim_high")

# Fits of several factors
_rows = lambda s, d: inf.dummies(inf.dummies(people(s, d).join(vw.demographics(s, d).select("user_id", "salutation"), "user_id"), "grp", range(5), 0), "salutation", (10, 20, 30), 10)
_two = [*[f"grp_{i}" for i in range(1, 5)], "salutation_20", "salutation_30"]
_factors, _fit = fs.hc3("(SELECT * FROM pe JOIN demographics USING (user_id) WHERE salutation IS NOT NULL AND y IS NOT NULL)", {"intercept": "1", **{f"grp_{i}": f"(grp = {i})::INT" for i in range(1, 5)}, **{f"salutation_{v}": f"(salutation = {v})::INT" for v in (20, 30)}}, "y")
add("ancova_factors", lambda s, d: inf.ols_hc3(_rows(s, d), "y", _two)[0], _fit, OLS.rstrip() + f", {vw.DEMOGRAPHICS_SQL}, " + _factors, "estimate se")
GM = OLS + ", gm AS (SELECT grp, avg(y) AS m, var_pop(y) * count(*) / (1 - 1 / count(*)) ** 2 / count(*) ** 2 AS v FROM pe GROUP BY 1)\n"
_dn = [f"grp_{i}" for i in range(1, 5)]
add("wald_chunks", lambda s, d: inf.wald(*inf.ols_hc3(inf.dummies(people(s, d), "grp", range(5), 0), "y", _dn), {"grp_1": ["grp_1"], "grp_4": ["grp_4"], "grp": _dn}), "SELECT 'grp_' || grp AS chunk, (m - (SELECT m FROM gm WHERE grp = 0)) ** 2 / (v + (SELECT v FROM gm WHERE grp = 0)) AS wald, 1::BIGINT AS df FROM gm WHERE grp IN (1, 4) UNION ALL SELECT 'grp', sum(m ** 2 / v) - sum(m / v) ** 2 / sum(1 / v), 4::BIGINT FROM gm", GM, "wald")

# Masks
CLOCK = {"night": (0, 2), "day": (2, 6), "evening": (6, 8)}
TR = GRID + """, pm AS (SELECT user_id, day, bin // 2 AS bin, bool_or(hr IS NOT NULL) AS a FROM g GROUP BY ALL),
st AS (SELECT user_id, day, unnest(['all', CASE WHEN bin < 2 THEN 'night' WHEN bin < 6 THEN 'day' ELSE 'evening' END]) AS part, a, b FROM (SELECT user_id, day, bin, hr IS NOT NULL AS a, lead(hr IS NOT NULL) OVER (PARTITION BY user_id, day ORDER BY bin) AS b FROM g) WHERE b IS NOT NULL
  UNION ALL SELECT user_id, day, 'pooled', a, b FROM (SELECT user_id, day, a, lead(a) OVER (PARTITION BY user_id, day ORDER BY bin) AS b FROM pm) WHERE b IS NOT NULL),
dy AS (SELECT user_id, day, part, count(*) FILTER (a AND b) AS n11, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (NOT a AND b) AS n01, count(*) FILTER (NOT a AND NOT b) AS n00 FROM st GROUP BY ALL)
"""
add("transition_dynamics", lambda s, d: gaps.transition_dynamics(grid(s, d), CLOCK, 2), "SELECT * EXCLUDE (n), n11 / n AS f11, n10 / n AS f10, n01 / n AS f01, n00 / n AS f00, n10 / nullif(n10 + n11, 0) AS stop, n01 / nullif(n01 + n00, 0) AS start FROM (SELECT user_id, part, sum(n11)::BIGINT AS n11, sum(n10)::BIGINT AS n10, sum(n01)::BIGINT AS n01, sum(n00)::BIGINT AS n00, avg(n10) AS stops_a_day, coalesce(stddev_samp(n10), 0) AS stops_sd, sum(n11 + n10 + n01 + n00) AS n FROM dy GROUP BY ALL)", TR, "stops_a_day stops_sd f11 f10 f01 f00 stop start")
add("gap_run_profile", lambda s, d: gaps.gap_run_profile(gaps.bin_runs(grid(s, d))), "SELECT user_id, missing, (CASE WHEN length <= 1 THEN 0 WHEN length <= 3 THEN 1 WHEN length <= 6 THEN 2 ELSE 3 END)::BIGINT AS bucket, interior, count(*) AS n_runs, sum(length)::BIGINT AS bins FROM ru GROUP BY ALL", RUNS)
add("gap_clock_profile", lambda s, d: gaps.gap_clock_profile(gaps.bin_runs(grid(s, d)), CLOCK, (2, 4), 1), """SELECT user_id, "window", charging, micro, charging / days AS charging_a_day, micro / days AS micro_a_day FROM (SELECT user_id, CASE WHEN (start + "end") / 2 < 2 THEN 'night' WHEN (start + "end") / 2 < 6 THEN 'day' ELSE 'evening' END AS "window", count(*) FILTER (length BETWEEN 2 AND 4) AS charging, count(*) FILTER (length <= 1) AS micro FROM ru WHERE missing AND interior GROUP BY ALL) JOIN (SELECT user_id, count(DISTINCT day) AS days FROM ru GROUP BY 1) USING (user_id)""", RUNS, "charging_a_day micro_a_day")
add("daily_signals", lambda s, d: gaps.daily_signals(grid(s, d)), "SELECT *, night / nullif(day_mean, 0) AS dipping, night_occupancy >= 0.5 AS night_compliant FROM (SELECT user_id, day, quantile_cont(hr, 0.1) AS p10, avg(hr) FILTER (bin BETWEEN 0 AND 2) AS night, avg(hr) FILTER (bin BETWEEN 3 AND 7) AS day_mean, avg((hr IS NOT NULL)::INT) AS occupancy, avg((hr IS NOT NULL)::INT) FILTER (bin BETWEEN 0 AND 2) AS night_occupancy, count(*) FILTER (hr IS NOT NULL AND nxt IS NULL AND bin < 7) AS gap_episodes FROM (SELECT *, lead(hr) OVER (PARTITION BY user_id, day ORDER BY bin) AS nxt FROM g) GROUP BY ALL)", GRID, "p10 night day_mean occupancy night_occupancy dipping")

# Fills over hidden stretches: teams of users, whose days are dense
TIERS = {"short": (1, 1), "medium": (2, 3), "long": (4, 6)}


def team_grid(spark, sf_dir):
    b = events(spark, sf_dir).select((F.col("user_id") % 20).alias("user_id"), "day", fn.bin_of(F.col("local_ms"), 180).alias("bin"), "value").groupBy("user_id", "day", "bin").agg(F.avg("value").alias("hr"))
    return gaps.full_grid(b, 8)


def fill_error(spark, sf_dir):
    g = team_grid(spark, sf_dir)
    return gaps.fill_error(g, gaps.hide_stretches(g, TIERS, "hide", 3), 12, (0.5, 0.65), 60.0)


_h = lambda tag, cols="gap_tier || '|' || user_id || '|' || day || '|' || start": f"('0x' || substr(sha256('hide|{tag}|' || {cols}), 1, 8))::BIGINT"
_m = lambda a, b, ha, hb: f"CASE WHEN {a} * {b} > 0 THEN 3 * ({ha} + {hb}) / ((2 * {hb} + {ha}) / {a} + ({hb} + 2 * {ha}) / {b}) WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 0 END"
FE = E + f""", b AS (SELECT user_id % 20 AS user_id, day, (local_ms % 86400000) // 10800000 AS bin, avg(value) AS hr FROM e GROUP BY ALL),
g AS (SELECT user_id, day, bin, hr FROM (SELECT user_id, day, unnest(range(0, 8)) AS bin FROM (SELECT DISTINCT user_id, day FROM b)) LEFT JOIN b USING (user_id, day, bin)),
ru AS (SELECT user_id, day, min(bin) AS start, count(*) AS length FROM (SELECT *, bin - row_number() OVER (PARTITION BY user_id, day ORDER BY bin) AS i FROM b) GROUP BY user_id, day, i),
op AS (SELECT *, row_number() OVER (PARTITION BY user_id, gap_tier ORDER BY sha256('hide|' || gap_tier || '|' || user_id || '|' || day || '|' || start), day, start) AS r FROM ru, (VALUES ('short', 1, 1), ('medium', 2, 3), ('long', 4, 6)) t(gap_tier, least_k, most_k) WHERE length >= least_k + 2),
ch AS (SELECT *, least_k + {_h("length")} % (least(most_k, length - 2) - least_k + 1) AS k FROM op WHERE r <= 3),
hd AS (SELECT user_id, day, gap_tier, f AS "first", f + k - 1 AS "last" FROM (SELECT *, start + 1 + {_h("start")} % (length - 1 - k) AS f FROM ch)),
lf AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.user_id = g.user_id AND hd.day = g.day AND g.bin BETWEEN hd."first" AND hd."last")),
tp AS (SELECT bin, median(hr) AS template FROM lf GROUP BY 1),
cp AS (SELECT g.user_id, g.day, gap_tier, "first", "last", bin, bin BETWEEN "first" AND "last" AS inside, CASE WHEN bin BETWEEN "first" AND "last" THEN hr END AS truth, CASE WHEN NOT bin BETWEEN "first" AND "last" THEN hr END AS hr FROM g JOIN hd USING (user_id, day)),
nb AS (SELECT *, lag(bin) OVER w AS px, lag(hr) OVER w AS py, lead(bin) OVER w AS nx, lead(hr) OVER w AS ny FROM cp WHERE hr IS NOT NULL WINDOW w AS (PARTITION BY user_id, day, gap_tier, "first" ORDER BY bin)),
pr AS (SELECT c.*, l.px AS x0, l.py AS y0, l.bin AS x1, l.hr AS y1, r.bin AS x2, r.hr AS y2, r.nx AS x3, r.ny AS y3, coalesce(template, whole) AS clock, whole AS level FROM cp c JOIN nb l ON l.user_id = c.user_id AND l.day = c.day AND l.gap_tier = c.gap_tier AND l."first" = c."first" AND l.bin = c."first" - 1 JOIN nb r ON r.user_id = c.user_id AND r.day = c.day AND r.gap_tier = c.gap_tier AND r."first" = c."first" AND r.bin = c."last" + 1 LEFT JOIN tp ON tp.bin = c.bin, (SELECT median(hr) AS whole FROM lf) WHERE c.inside),
sl AS (SELECT *, y1 + (y2 - y1) * (bin - x1) / (x2 - x1) AS line, (bin - x1) / (x2 - x1) AS t, x2 - x1 AS h, {_m("((y1 - y0) / (x1 - x0))", "((y2 - y1) / (x2 - x1))", "(x1 - x0)", "(x2 - x1)")} AS m1, {_m("((y2 - y1) / (x2 - x1))", "((y3 - y2) / (x3 - x2))", "(x2 - x1)", "(x3 - x2)")} AS m2 FROM pr),
gu AS (SELECT *, coalesce((2 * t ** 3 - 3 * t ** 2 + 1) * y1 + (t ** 3 - 2 * t ** 2 + t) * h * m1 + (3 * t ** 2 - 2 * t ** 3) * y2 + (t ** 3 - t ** 2) * h * m2, line) AS cubic FROM sl),
er AS (SELECT user_id, day, gap_tier, "first", fill, avg(abs(guess - truth)) AS mae, sqrt(avg((guess - truth) ** 2)) AS rmse, max(abs(guess - y1)) FILTER (bin = "first") AS jump FROM (SELECT *, unnest(['clock', 'level', 'constant', 'linear', 'cubic']) AS fill, unnest([clock, level, 60, line, cubic]) AS guess FROM gu) GROUP BY ALL),
oc AS (SELECT user_id, CASE WHEN avg((hr IS NOT NULL)::INT) < 0.5 THEN 'low' WHEN avg((hr IS NOT NULL)::INT) < 0.65 THEN 'medium' ELSE 'high' END AS occupancy_tier FROM g GROUP BY 1)
"""
_sem = lambda c: f"avg({c}) AS {c}, coalesce(stddev_samp({c}) / sqrt(count(*)), 0) AS {c}_sem"
add("fill_error", fill_error, f"SELECT fill, CASE WHEN grouping(gap_tier) = 1 THEN 'ALL' ELSE gap_tier END AS gap_tier, CASE WHEN grouping(occupancy_tier) = 1 THEN 'ALL' ELSE occupancy_tier END AS occupancy_tier, count(*) AS n, {_sem('mae')}, {_sem('rmse')}, {_sem('jump')} FROM er JOIN oc USING (user_id) GROUP BY GROUPING SETS ((fill), (fill, gap_tier), (fill, occupancy_tier), (fill, gap_tier, occupancy_tier))", FE, "mae mae_sem rmse rmse_sem jump jump_sem")

# Cohorts, files and checks
SCV = E + """, m AS (SELECT *, max(end_ms) OVER (PARTITION BY user_id, source, channel, day ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start_ms > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, source, channel, day ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM m),
cv AS (SELECT user_id, source, channel, day, sum(ms) / 1000 AS cov_s FROM (SELECT user_id, source, channel, day, island, max(end_ms) - min(start_ms) AS ms FROM i GROUP BY ALL) GROUP BY ALL)
"""
add("coverage_semantics", lambda s, d: cohorts.coverage_semantics(ep.union_coverage(events(s, d), ("user_id", "source", "channel", "day"))), "SELECT source, channel, count(*) AS day_rows, count(*) FILTER (cov_s > 86400) AS over_24h, max(cov_s) AS most, arg_max(user_id, (cov_s, -user_id, -day)) AS user_id, arg_max(day, (cov_s, -user_id, -day)) AS day FROM cv GROUP BY ALL", SCV, "most")
add("sole_source", lambda s, d: cohorts.sole_source(events(s, d).where("channel = 3000").withColumn("user_id", F.col("user_id") * 100 + F.col("day") % 100)), "SELECT user_id * 100 + day % 100 AS user_id, min(source) AS source FROM e WHERE channel = 3000 GROUP BY 1 HAVING count(DISTINCT source) = 1", E)
add("age_support", lambda s, d: cohorts.age_support(vw.demographics(s, d), 2024, 5), "SELECT *, (count(*) FILTER (supported) OVER ()) >= 3 AS comparable FROM (SELECT (2024 - birth_year) // 5 * 5 AS band, count(*) FILTER (salutation = 10) AS n0, count(*) FILTER (salutation = 20) AS n1, count(*) FILTER (salutation = 10) >= 5 AND count(*) FILTER (salutation = 20) >= 5 AS supported FROM demographics GROUP BY 1)", DM)


def checks(spark, sf_dir):
    m = manifest(spark, sf_dir).join(cohorts.coverage_gate(days(spark, sf_dir), 3).select("user_id", "adequate_days"), "user_id", "left")
    return cohorts.cohort_checks(m, vw.epochs(spark, sf_dir), days(spark, sf_dir), splits.disjoint_kfold(vw.demographics(spark, sf_dir), "user_id", "age_group", "split"), (38,), 3, ("primary_source", "birth_year"))


add("cohort_checks", checks, """SELECT "check", violations, violations = 0 AS passed FROM (SELECT unnest(['labels_binary', 'users_unique', 'passed_were_seen', 'no_excluded_source', 'adequate_days_recomputed', 'gate_recomputed', 'forbidden_absent', 'split_covers_each_once', 'split_holds_no_other']) AS "check",
  unnest([count(*) FILTER (label NOT IN (0, 1)), count(*) - count(DISTINCT user_id), count(*) FILTER (passed AND raw_events IS NULL), (SELECT count(*) FROM epochs WHERE source IN (38)), 0, 0, 1, (SELECT count(*) FROM man x WHERE passed AND (SELECT count(*) FROM demographics y WHERE y.user_id = x.user_id) <> 1), count(*) FILTER (NOT passed)]) AS violations FROM man)""", MAN)
daily_top = lambda s, d, keys: events(s, d).groupBy(*keys).agg(F.count("*").alias("n"), F.max("value").alias("top"))
add("reconcile", lambda s, d: quality.reconcile(daily_top(s, d, ["user_id"]), daily_top(s, d, ["user_id", "day"]).where("n > 1").groupBy("user_id").agg(F.sum("n").alias("n"), F.max("top").alias("top")), ["user_id"], ["n", "top"]), "SELECT (SELECT count(*) FROM a ANTI JOIN b USING (user_id)) AS unmatched, unnest(['n', 'top']) AS item, unnest([max(abs(a.n - b.n)), max(abs(a.top - b.top))]::DOUBLE[]) AS largest FROM a JOIN b USING (user_id)", E + ", a AS (SELECT user_id, count(*) AS n, max(value) AS top FROM e GROUP BY 1), b AS (SELECT user_id, sum(n)::BIGINT AS n, max(top) AS top FROM (SELECT user_id, day, count(*) AS n, max(value) AS top FROM e GROUP BY ALL HAVING count(*) > 1) GROUP BY 1)\n", "largest")


def inventory(spark, sf_dir):
    """The event files, with files of no bytes for users whose number ends in 7 and who have no events."""
    path = event_files(spark, sf_dir, empty=True)
    return files.file_inventory(spark, path, vw.demographics(spark, sf_dir), OWNER).select("user_id", "state")


add("file_inventory", inventory, f", {vw.DEMOGRAPHICS_SQL} SELECT user_id, CASE WHEN user_id IN (SELECT user_id FROM epochs) THEN 'nonempty' WHEN user_id % 10 = 7 THEN 'zero_byte' ELSE 'missing' END AS state FROM demographics", E)


def folds(spark, sf_dir: str):
    """What sink_folds wrote: balance rows, and each fold's users from the folders and from the assignments."""
    path = files.scratch(spark, "folds")
    people = vw.demographics(spark, sf_dir)
    files.sink_folds(splits.disjoint_kfold(people, "user_id", "age_group", "split").join(people.select("user_id", "bmi_grp"), "user_id"), path, ["age_group", "bmi_grp"])
    out = spark.read.parquet(f"{path}/balance").select("variable", "level", F.col("fold").cast("long").alias("fold"), "n", "share")
    for name in ("folds", "assignments"):
        users = spark.read.parquet(f"{path}/{name}").groupBy(F.col("fold").cast("long").alias("fold")).agg(F.countDistinct("user_id").alias("n"), F.sum("user_id").cast("double").alias("share"))
        out = out.unionByName(users.select(F.lit(name).alias("variable"), F.lit("").alias("level"), "fold", "n", "share"))
    return out


add("sink_folds", folds, "SELECT variable, level, fold, count(*) AS n, count(*) / max(t.total) AS share FROM (SELECT fold, unnest(['age_group', 'bmi_grp']) AS variable, unnest([age_group::VARCHAR, bmi_grp]) AS level FROM f) JOIN (SELECT fold, count(*) AS total FROM f GROUP BY 1) t USING (fold) GROUP BY ALL UNION ALL SELECT unnest(['folds', 'assignments']), '', fold, count(*), sum(user_id) FROM f GROUP BY fold", DM + ", f AS (SELECT user_id, age_group, bmi_grp, (row_number() OVER (PARTITION BY age_group ORDER BY sha256('split|' || user_id), user_id) - 1) % 5 AS fold FROM demographics)\n", "share")

# Scalar functions
_v = "list_transform(embedding, lambda x: x::DOUBLE)"
pool3 = lambda c: F.transform(F.sequence(F.lit(0), F.floor(F.size(c) / 3).cast("int") - 1), lambda i: F.array_max(F.slice(c, i * 3 + 1, F.lit(3))))
total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def arrays(spark, sf_dir):
    """Size, extremes and norm; differences of neighbours, maxima of threes, rows of a reshaped matrix, and what is concatenated."""
    t = vw.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    t = t.withColumn("d", F.zip_with(F.slice("v", F.lit(2), F.size("v") - 1), F.slice("v", F.lit(1), F.size("v") - 1), lambda a, b: a - b)).withColumn("p", pool3(F.col("v")))
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 4).cast("int") - 1), lambda i: F.slice("v", i * 4 + 1, F.lit(4)))
    norm = lambda c: total(F.transform(c, lambda x: x * x))
    return t.select("vec_id", F.size("v").cast("long").alias("n"), F.array_max("v").alias("top"), norm("v").alias("norm2"), norm("d").alias("difference2"), F.size("p").cast("long").alias("pools"), total("p").alias("pooled"), F.size(rows).cast("long").alias("rows"), total(F.transform(rows, lambda r: F.get(r, F.lit(0)))).alias("first_column"), F.size(F.concat("d", "p")).cast("long").alias("joined"))


add("scalar_array", arrays, f"SELECT vec_id, len(v) AS n, list_max(v) AS top, list_sum(list_transform(v, lambda x: x * x)) AS norm2, list_sum(list_transform(range(1, len(v)), lambda i: (v[i + 1] - v[i]) ** 2)) AS difference2, len(v) // 3 AS pools, list_sum(list_transform(range(0, len(v) // 3), lambda i: list_max(v[i * 3 + 1 : i * 3 + 3]))) AS pooled, len(v) // 4 AS rows, list_sum(list_transform(range(0, len(v) // 4), lambda i: v[i * 4 + 1])) AS first_column, len(v) - 1 + len(v) // 3 AS joined FROM (SELECT vec_id, {_v} AS v FROM embeddings)", "", "top norm2 difference2 pooled first_column")
_nan = lambda: F.when(F.col("user_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("weight"))
add("scalar_null", lambda s, d: vw.demographics(s, d).select("user_id", F.coalesce("weight", "height", F.lit(0.0)).alias("first_known"), F.nanvl(_nan(), F.lit(None)).alias("number"), F.nullif(F.col("birth_year"), F.lit(1980)).alias("year"), F.col("weight").isNull().alias("no_weight"), F.col("weight").eqNullSafe(F.col("height")).alias("same"), F.coalesce(F.col("salutation").cast("string"), F.lit(fn.MISSING)).alias("cell"), (F.when(F.col("weight").isNotNull(), 1).otherwise(0) + F.when(F.col("height").isNotNull(), 1).otherwise(0)).cast("long").alias("known")), "SELECT user_id, coalesce(weight, height, 0) AS first_known, CASE WHEN user_id % 7 = 0 THEN NULL ELSE weight END AS number, nullif(birth_year, 1980) AS year, weight IS NULL AS no_weight, weight IS NOT DISTINCT FROM height AS same, coalesce(salutation::VARCHAR, '<MISSING>') AS cell, ((weight IS NOT NULL)::INT + (height IS NOT NULL)::INT)::BIGINT AS known FROM demographics", DM, "first_known number")
