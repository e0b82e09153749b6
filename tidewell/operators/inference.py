"""Comparisons of arms, groups and repeats, and least squares with robust errors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators.evaluation import auroc
from tidewell.operators.ranks import hash_rank, quantiles
from tidewell.operators.windows import average_rank


def subgroup_metrics(preds: DataFrame, group: str, arm_a: str, arm_b: str) -> DataFrame:
    """AUROC of two arms in each subgroup, their difference, and the rank correlation of their scores."""
    area = auroc(preds, (group, "arm")).groupBy(group).agg(F.max(F.when(F.col("arm") == arm_a, F.col("auroc"))).alias("auroc_a"), F.max(F.when(F.col("arm") == arm_b, F.col("auroc"))).alias("auroc_b"))
    ranked = average_rank(preds.where(F.col("arm").isin(arm_a, arm_b)), "score", (group, "arm"))
    wide = ranked.groupBy(group, "user_id").agg(F.max(F.when(F.col("arm") == arm_a, F.col("rank"))).alias("_a"), F.max(F.when(F.col("arm") == arm_b, F.col("rank"))).alias("_b"))
    rho = wide.groupBy(group).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("spearman"))
    return area.join(rho, group).withColumn("delta", F.col("auroc_a") - F.col("auroc_b"))


def repeat_summary(deltas: DataFrame, keys, value: str = "delta") -> DataFrame:
    """Paired differences over repeats: moments, t interval, quartiles, share above 0 and whether most agree in sign."""
    # 97.5% points of Student's t for 1 to 30 degrees of freedom: fixed values.
    t975 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]
    s = deltas.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.median(value).alias("median"), (F.percentile(value, F.lit(0.75)) - F.percentile(value, F.lit(0.25))).alias("iqr"), F.avg((F.col(value) > 0).cast("double")).alias("share_above"))
    t = F.coalesce(F.get(F.array(*map(F.lit, t975)), (F.col("n") - 2).cast("int")), F.lit(1.96))
    half = F.when(F.col("n") > 1, t * F.col("sd") / F.sqrt("n"))
    return s.withColumn("low", F.col("mean") - half).withColumn("high", F.col("mean") + half).withColumn("agreement", F.greatest(F.col("share_above"), 1 - F.col("share_above")))


def abstention_profile(preds: DataFrame, low: float, high: float, stats: DataFrame, columns) -> DataFrame:
    """Mean of recording statistics of users whose score decides (at most low, or high at least) and of those between."""
    state = F.when((F.col("score") <= low) | (F.col("score") >= high), "labelled").otherwise("abstained")
    return preds.withColumn("state", state).join(stats, "user_id").groupBy("arm", "state").agg(F.count("*").alias("n"), F.avg("y").alias("rate"), *[F.avg(c).alias(c) for c in columns])


def outcome_groups(preds: DataFrame, before: str, after: str) -> DataFrame:
    """Users by whether two arms, each cut at its median score, are right: both_right, rescued, degraded, both_wrong."""
    cut = quantiles(preds, ["arm"], "score", {"_m": 0.5}, few=True)
    right = preds.join(F.broadcast(cut), "arm").withColumn("_ok", (F.col("score") >= F.col("_m")).cast("long") == F.col("y"))
    w = right.groupBy("user_id").agg(F.max(F.when(F.col("arm") == before, F.col("_ok"))).alias("a"), F.max(F.when(F.col("arm") == after, F.col("_ok"))).alias("b"))
    name = F.when(F.col("a") & F.col("b"), "both_right").when(~F.col("a") & F.col("b"), "rescued").when(F.col("a") & ~F.col("b"), "degraded").when(~F.col("a") & ~F.col("b"), "both_wrong")
    return w.select("user_id", name.alias("outcome")).where("outcome IS NOT NULL")


def user_mean_prediction(rows: DataFrame) -> DataFrame:
    """Rows' scores averaged to one for each user, with the weight 1 / rows that each row has in training."""
    return rows.groupBy("user_id", "y").agg(F.avg("score").alias("score"), F.count("*").alias("rows"), (F.lit(1.0) / F.count("*")).alias("weight"))


def orthogonal(preds: DataFrame, arm: str, other: str) -> DataFrame:
    """Scores of an arm less their linear part in another arm's; the moments are one row."""
    w = preds.groupBy("user_id", "y").agg(F.max(F.when(F.col("arm") == arm, F.col("score"))).alias("a"), F.max(F.when(F.col("arm") == other, F.col("score"))).alias("b"))
    fit = w.agg(F.coalesce(F.regr_slope("a", "b"), F.lit(0.0)).alias("_s"), F.avg("a").alias("_ma"), F.avg("b").alias("_mb"))
    return w.crossJoin(F.broadcast(fit)).select("user_id", "y", F.lit(f"{arm}|{other}").alias("arm"), F.round(F.col("a") - F.col("_ma") - F.col("_s") * (F.col("b") - F.col("_mb")), 9).alias("score"))


def group_means_bootstrap(draws: DataFrame, keys=(), level: float = 0.95) -> DataFrame:
    a = (1 - level) / 2
    q = lambda p: F.percentile(fn.steady(F.col("value")), F.lit(p))
    return draws.groupBy(*keys).agg(F.count("*").alias("draws"), F.avg("value").alias("mean"), q(a).alias("low"), q(1 - a).alias("high"))


def paired_difference(draws: DataFrame, a: str, b: str, keys=(), ratio: bool = False) -> DataFrame:
    """Interval of the difference, or ratio, of two arms' means over the same draws (keys, arm, draw, mean)."""
    of = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("mean")))
    both = draws.groupBy(*keys, "draw").agg(of(a).alias("_a"), of(b).alias("_b"))
    return group_means_bootstrap(both.select(*keys, (F.try_divide("_a", "_b") if ratio else F.col("_a") - F.col("_b")).alias("value")), keys)


def ratio_bootstrap(draws: DataFrame, a: str, b: str, key: str, reference: str) -> DataFrame:
    """For each key the interval of the ratio of two arms' means, and of that ratio over the reference key's in the same draw."""
    of = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("mean")))
    ratios = draws.groupBy(key, "draw").agg(F.try_divide(of(a), of(b)).alias("value"))
    base = ratios.where(F.col(key) == reference).select("draw", F.col("value").alias("_r"))  # a row for each draw
    double = ratios.join(F.broadcast(base), "draw").select(key, F.try_divide("value", "_r").alias("value"))
    own = group_means_bootstrap(ratios, [key])
    return own.join(group_means_bootstrap(double, [key]).select(key, F.col("mean").alias("double_mean"), F.col("low").alias("double_low"), F.col("high").alias("double_high")), key)


def ols_hc3(rows: DataFrame, y: str, features, intercept: bool = True) -> tuple[DataFrame, np.ndarray]:
    """Least squares with HC3 covariance: a row for each term, and the covariance.

    Two passes of sums over the rows; only p x p matrices come to the driver. Rows with a null are left out. Terms that
    depend on others get the least-norm solution.
    """
    names = (["intercept"] if intercept else []) + list(features)
    x = ([F.lit(1.0)] if intercept else []) + [F.col(f).cast("double") for f in features]
    p = len(x)
    clean = rows.dropna(subset=[y, *features])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    got = clean.agg(F.count("*").alias("n"), *[F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(x[i] * F.col(y)).alias(f"m{i}") for i in range(p)]).first()
    spark = rows.sparkSession
    schema = "term string, estimate double, se double, n long"
    if not got.n:
        return spark.createDataFrame([], schema), np.zeros((p, p))
    gram = np.zeros((p, p))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = got[f"g{i}_{j}"]
    inv = np.linalg.pinv(gram, rcond=1e-12)
    beta = inv @ np.array([got[f"m{i}"] for i in range(p)])
    hat = sum((x[i] * x[j] * float(inv[i, j]) * (1 if i == j else 2) for i, j in pairs[1:]), x[0] * x[0] * float(inv[0, 0]))
    fit = sum((x[i] * float(beta[i]) for i in range(1, p)), x[0] * float(beta[0]))
    scaled = clean.withColumn("_w", F.pow((F.col(y) - fit) / F.greatest(1 - hat, F.lit(1e-12)), F.lit(2)))
    row = scaled.agg(*[F.sum(x[i] * x[j] * F.col("_w")).alias(f"g{i}_{j}") for i, j in pairs]).first()
    meat = np.zeros((p, p))
    for i, j in pairs:
        meat[i, j] = meat[j, i] = row[f"g{i}_{j}"]
    cov = inv @ meat @ inv
    return spark.createDataFrame([(names[i], float(beta[i]), float(np.sqrt(max(cov[i, i], 0.0))), got.n) for i in range(p)], schema), cov


def wald(terms: DataFrame, cov: np.ndarray, chunks: dict[str, list[str]]) -> DataFrame:
    """Wald statistic and degrees of freedom of each named group of terms; the terms are p rows."""
    rows = [(r.term, r.estimate) for r in terms.collect()]
    place = {t: i for i, (t, _) in enumerate(rows)}
    b = np.array([e for _, e in rows])
    out = []
    for name, members in chunks.items():
        at = [place[m] for m in members]
        sub = cov[np.ix_(at, at)]
        out.append((name, float(b[at] @ np.linalg.pinv(sub) @ b[at]), int(np.linalg.matrix_rank(sub))))
    return terms.sparkSession.createDataFrame(out, "chunk string, wald double, df long")


def dummies(rows: DataFrame, column: str, levels, base) -> DataFrame:
    """0/1 columns <column>_<level> of the listed levels but the base; a null level gives nulls."""
    return rows.withColumns({f"{column}_{v}": F.when(F.col(column).isNotNull(), (F.col(column) == v).cast("double")) for v in levels if v != base})


def rcs(rows: DataFrame, column: str, knots) -> DataFrame:
    """Restricted cubic spline columns rcs_1 .. rcs_(k-1), linear beyond the outer knots, and their derivatives d_rcs_i."""
    x, k = F.col(column).cast("double"), list(knots)
    span, last, prev = (k[-1] - k[0]) ** 2, k[-1], k[-2]
    up = lambda t, n: F.pow(F.greatest(x - t, F.lit(0.0)), F.lit(n))
    term = lambda t, n: up(t, n) - up(prev, n) * ((last - t) / (last - prev)) + up(last, n) * ((prev - t) / (last - prev))
    cols = {"rcs_1": x, "d_rcs_1": F.when(x.isNotNull(), 1.0)}
    for i, t in enumerate(k[:-2], start=2):
        cols |= {f"rcs_{i}": term(t, 3) / span, f"d_rcs_{i}": 3 * term(t, 2) / span}
    return rows.withColumns(cols)


def transitions(curve: DataFrame, keys, x: str, value: str) -> DataFrame:
    """Where a curve is least (null at an edge) and where it first falls through 0, on the line between neighbours."""
    w = Window.partitionBy(*keys).orderBy(x)
    all_ = Window.partitionBy(*keys)
    step = curve.withColumns({"_px": F.lag(x).over(w), "_pv": F.lag(value).over(w), "_a": F.min(x).over(all_), "_z": F.max(x).over(all_)})
    cross = F.when((F.col("_pv") > 0) & (F.col(value) <= 0), F.col("_px") + (F.col(x) - F.col("_px")) * F.col("_pv") / (F.col("_pv") - F.col(value)))
    low = F.min_by(F.struct(x, value, "_a", "_z"), F.struct(value, x))
    out = step.withColumn("_c", cross).groupBy(*keys).agg(low.alias("_l"), F.min("_c").alias("crossing"))
    at = F.col(f"_l.{x}")
    inside = (at > F.col("_l._a")) & (at < F.col("_l._z"))
    return out.select(*keys, F.when(inside, at).alias("lowest_at"), F.when(inside, F.col(f"_l.{value}")).alias("lowest"), "crossing")


def forecast_correlation(metrics: DataFrame, series: DataFrame, keys=("user_id",), origin: int = 0) -> DataFrame:
    """How a harmonic fitted on window 1 (period, amplitude, phase) does on the days of window 2: correlation and R2 of each key.

    metrics (keys, window_index, period, amplitude, phase), series (keys, window_index, day, residual).
    """
    keys = list(keys)
    fit = metrics.where("window_index = 1").select(*keys, "period", "amplitude", "phase")
    x = series.where("window_index = 2").join(fit, keys)
    guess = F.col("amplitude") * F.cos(2 * np.pi * (F.col("day") - origin) / F.col("period") - F.col("phase"))
    x = x.select(*keys, F.col("residual").alias("_y"), guess.alias("_g"))
    return x.groupBy(*keys).agg(F.count("*").alias("days"), F.corr("_y", "_g").alias("forecast_r"), (1 - F.try_divide(F.sum((F.col("_y") - F.col("_g")) ** 2), F.count("*") * F.var_pop("_y"))).alias("forecast_r2"))


def period_persistence(peaks: DataFrame, forecasts: DataFrame | None = None, near: float = 1.5, tag: str = "perm") -> DataFrame:
    """Share of users whose peak period of window 1 comes back within `near` days in window 2, and the same for permuted pairs.

    Permuted pairs: each user takes the period of the next one in hash order, the last the first's; ranks come from
    buckets, so no task orders all users. With forecasts, their mean R2 and correlation too.
    """
    a = peaks.where("window_index = 1").select("user_id", F.col("period").alias("p1"))
    b = peaks.where("window_index = 2").select("user_id", F.col("period").alias("p2"))
    j = hash_rank(a.join(b, "user_id").withColumn("_all", F.lit(0)), ["_all"], fn.hash_rank_key(tag, F.col("user_id")), "user_id", "_r", few=True)
    mixed = j.join(j.select((F.when(F.col("_r") == 1, F.col("_r_of")).otherwise(F.col("_r") - 1)).alias("_r"), F.col("p2").alias("_o")), "_r")
    close = lambda c: F.avg((F.abs(F.col("p1") - F.col(c)) <= near).cast("double"))
    out = mixed.agg(F.count("*").alias("users"), close("p2").alias("share"), close("_o").alias("share_permuted"))
    return out if forecasts is None else out.crossJoin(F.broadcast(forecasts.agg(F.avg("forecast_r2").alias("mean_r2"), F.avg("forecast_r").alias("mean_r"))))  # one row each
