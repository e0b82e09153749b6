"""Scores of predictions and tests between groups, as aggregates and windows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators import resampling
from tidewell.operators.ranks import hash_rank, join_nulls, quantiles, running_totals
from tidewell.operators.windows import average_rank


def classification_metrics(preds: DataFrame, keys=("arm",), cut: float = 0.5) -> DataFrame:
    """Confusion counts, accuracies, and precision, recall and F1 of either class; null where nothing divides."""
    hat = (F.col("score") >= cut).cast("int")
    c = lambda y, p: F.count_if((F.col("y") == y) & (hat == p))
    m = preds.groupBy(*keys).agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))
    d = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn_, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    both = [x for tag, a, b, c in (("", tp, fp, fn_), ("_0", tn, fn_, fp)) for x in (d(a, a + b).alias(f"precision{tag}"), d(a, a + c).alias(f"recall{tag}"), d(2 * a, 2 * a + b + c).alias(f"f1{tag}"))]
    return m.select("*", d(tp + tn, tp + tn + fp + fn_).alias("accuracy"), ((d(tp, tp + fn_) + d(tn, tn + fp)) / 2).alias("balanced_accuracy"), *both)


def tie_counts(preds: DataFrame, keys=("arm",)) -> DataFrame:
    """Positives and negatives of each distinct score: what rank measures need, summed before any sort."""
    return preds.groupBy(*keys, "score").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))


def cumulative(preds: DataFrame, keys=("arm",), few: bool = True) -> DataFrame:
    """Tie counts with the sums below each score and, as tp and fp, from it upwards."""
    t = running_totals(tie_counts(preds, keys), keys, "score", ("pos", "neg"), few=few)
    return t.withColumn("tp", F.col("pos_total") - F.col("pos_before")).withColumn("fp", F.col("neg_total") - F.col("neg_before"))


def auroc(preds: DataFrame, keys=("arm",)) -> DataFrame:
    """Area under ROC with ties counted half; null with one class."""
    t = cumulative(preds, keys).withColumn("_u", F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return t.groupBy(*keys).agg((F.sum("_u") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auroc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))


def delong(preds: DataFrame, keys=("arm",), z: float = 1.96) -> DataFrame:
    """AUROC, its standard error from the placement values of either class, and the interval cut to [0, 1]; errors need two of each."""
    t = cumulative(preds, keys)
    up = F.try_divide(F.col("neg_before") + F.col("neg") / 2, "neg_total")
    down = F.try_divide(F.col("pos_total") - F.col("pos_before") - F.col("pos") / 2, "pos_total")
    t = t.withColumn("_a", up).withColumn("_b", down)
    m = t.groupBy(*keys).agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.try_divide(F.sum(F.col("pos") * F.col("_a")), F.sum("pos")).alias("auroc"),
        F.sum(F.col("pos") * F.col("_a") * F.col("_a")).alias("_qa"), F.sum(F.col("neg") * F.col("_b") * F.col("_b")).alias("_qb"), F.try_divide(F.sum(F.col("neg") * F.col("_b")), F.sum("neg")).alias("_mb"),
    )
    var = lambda q, n, mean: F.try_divide(F.col(q) - F.col(n) * F.col(mean) ** 2, (F.col(n) - 1) * F.col(n))
    out = m.withColumn("se", F.sqrt(F.when(F.least("_p", "_n") > 1, F.greatest(var("_qa", "_p", "auroc") + var("_qb", "_n", "_mb"), F.lit(0.0)))))
    return out.select(*keys, "auroc", "se", F.when(F.col("se").isNotNull(), F.greatest(F.lit(0.0), F.col("auroc") - z * F.col("se"))).alias("low"), F.when(F.col("se").isNotNull(), F.least(F.lit(1.0), F.col("auroc") + z * F.col("se"))).alias("high"))


def average_precision(preds: DataFrame, keys=("arm",)) -> DataFrame:
    t = cumulative(preds, keys)
    return t.groupBy(*keys).agg(F.try_divide(F.sum(F.try_divide(F.col("pos") * F.col("tp"), F.col("tp") + F.col("fp"))), F.sum("pos")).alias("average_precision"))


def threshold_curves(preds: DataFrame, keys=("arm",), split: str = "split") -> DataFrame:
    """Precision and coverage on val and test rows of what each distinct score of val selects.

    side 1 is score >= tau, judged by y = 1; side 0 is score <= tau, judged by y = 0. Tied scores are selected together. One
    pass of running sums over both splits gives all, so taus aren't joined to rows.
    """
    names = [f"{c}_{w}" for w in ("val", "test") for c in ("pos", "neg")]
    tied = preds.groupBy(*keys, "score").agg(*[F.count_if((F.col(split) == w) & (F.col("y") == y)).alias(f"{c}_{w}") for w in ("val", "test") for c, y in (("pos", 1), ("neg", 0))])
    at = running_totals(tied, keys, "score", names, few=True).where("pos_val + neg_val > 0")

    def side(k, right, wrong):
        held = {n: F.col(f"{n}_total") - F.col(f"{n}_before") if k else F.col(f"{n}_before") + F.col(n) for n in names}
        n = {w: held[f"{right}_{w}"] + held[f"{wrong}_{w}"] for w in ("val", "test")}
        share = lambda w: F.try_divide(held[f"{right}_{w}"], n[w])
        return F.struct(
            F.lit(k).cast("long").alias("side"), F.col("score").alias("tau"), n["val"].alias("n_val"), held[f"{right}_val"].alias("right_val"), share("val").alias("precision_val"), n["test"].alias("n_test"), held[f"{right}_test"].alias("right_test"),
            share("test").alias("precision_test"), F.try_divide(n["test"], F.col("pos_test_total") + F.col("neg_test_total")).alias("coverage_test"), F.try_divide(held[f"{right}_test"], F.col(f"{right}_test_total")).alias("recall_test"),
        )

    return at.select(*keys, F.explode(F.array(side(1, "pos", "neg"), side(0, "neg", "pos"))).alias("s")).select(*keys, "s.*")


def binomial_tail(right: Column, n: Column, share: float) -> Column:
    """Probability of `right` or more of n at a share: the regularised incomplete beta function, by its continued fraction in numpy."""

    @F.pandas_udf("double")
    def tail(a: pd.Series, n: pd.Series) -> pd.Series:
        a, b = a.to_numpy(float), (n - a + 1).to_numpy(float)
        none = a <= 0
        a = np.where(none, 1.0, a)
        swap = share > (a + 1) / (a + b + 2)
        x, p, q = np.where(swap, 1 - share, share), np.where(swap, b, a), np.where(swap, a, b)
        gamma = np.frompyfunc(math.lgamma, 1, 1)
        front = np.exp((gamma(p + q) - gamma(p) - gamma(q)).astype(float) + p * np.log(x) + q * np.log1p(-x)) / p
        c, d = np.ones_like(x), 1 / (1 - (p + q) * x / (p + 1))
        h = d.copy()
        for m in range(1, 2000):
            for num in (m * (q - m) * x / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * x / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 / (1 + num * d), 1 + num / c
                h *= d * c
            if (np.abs(d * c - 1) < 1e-13).all():
                break
        return pd.Series(np.where(none, 1.0, np.where(swap, 1 - front * h, front * h)))

    return tail(right, n)


def select_thresholds(preds: DataFrame, target: float, keys=("arm",), bound: str = "raw", delta: float = 0.05, z: float = 1.96) -> DataFrame:
    """The threshold of either side that selects most of val at a target precision, and what it does on test.

    side 1 takes the smallest tau, side 0 the largest. `raw` compares the precision itself, `cp` its Clopper-Pearson lower
    bound at 1 - delta, which reaches the target just where a binomial of that share shows as many right ones with a
    probability of delta at most. Where no tau does, tau is null and nothing is selected. low and high are Wilson's on test.
    """
    curves = threshold_curves(preds, keys)
    meets = F.col("precision_val") >= target if bound == "raw" else binomial_tail(F.col("right_val"), F.col("n_val"), target) <= delta
    row = F.when(F.col("_ok"), F.struct((F.when(F.col("side") == 1, F.col("tau")).otherwise(-F.col("tau"))).alias("_o"), "tau", "n_val", "precision_val", "n_test", "right_test", "precision_test", "coverage_test", "recall_test"))
    best = curves.withColumn("_ok", meets).groupBy(*keys, "side").agg(F.min(row).alias("b")).select(*keys, "side", "b.*").drop("_o")
    n, p = F.nullif(F.col("n_test"), F.lit(0)), F.col("precision_test")
    mid, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return best.withColumn("low", mid - half).withColumn("high", mid + half)


def best_threshold(preds: DataFrame, keys=("arm",)) -> DataFrame:
    """Threshold of the largest balanced accuracy, ties to the larger."""
    ba = F.round((F.try_divide("tp", "pos_total") + 1 - F.try_divide("fp", "neg_total")) / 2, 12)
    t = cumulative(preds, keys).withColumn("_b", ba)
    return t.groupBy(*keys).agg(F.max(F.struct("_b", "score")).alias("m")).select(*keys, F.col("m.score").alias("threshold"), F.col("m._b").alias("balanced_accuracy"))


def proper_scores(preds: DataFrame, keys=("arm",), eps: float = 1e-6) -> DataFrame:
    """Brier score, its skill over the base rate, log loss, and the deviance it saves against the base rate."""
    p = F.greatest(F.least(F.col("score"), F.lit(1 - eps)), F.lit(eps))
    out = preds.groupBy(*keys).agg(F.count("*").alias("n"), F.avg((F.col("score") - F.col("y")) * (F.col("score") - F.col("y"))).alias("brier"), F.avg("y").alias("base"), F.avg(-F.when(F.col("y") == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))
    null = -(F.when(F.col("base") > 0, F.col("base") * F.log("base")).otherwise(0.0) + F.when(F.col("base") < 1, (1 - F.col("base")) * F.log(1 - F.col("base"))).otherwise(0.0))
    return out.withColumn("skill", 1 - F.try_divide("brier", F.col("base") * (1 - F.col("base")))).withColumn("deviance_reduction", 2 * F.col("n") * (null - F.col("log_loss")))


def ece(preds: DataFrame, keys=("arm",), bins: int = 10, tag: str = "ece") -> DataFrame:
    """Calibration gap over bins of equal counts; rows of one score are ordered by a hash of the user, in buckets."""
    tied = running_totals(preds.groupBy(*keys, "score").agg(F.count("*").alias("_c")), keys, "score", ("_c",), few=True).drop("_c")
    ranked = hash_rank(preds, [*keys, "score"], fn.hash_rank_key(tag, F.col("user_id")), "user_id", "_r")
    place = F.col("_c_before") + F.col("_r") - 1
    b = join_nulls(ranked, tied, [*keys, "score"]).withColumn("_b", F.floor(place * bins / F.col("_c_total"))).groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.abs(F.avg("score") - F.avg("y")).alias("_g"))
    return b.groupBy(*keys).agg((F.sum(F.col("_n") * F.col("_g")) / F.sum("_n")).alias("ece"))


QUARTILES = {"p25": 0.25, "p50": 0.5, "p75": 0.75}


def smd(rows: DataFrame, group: str, base: str, value: str) -> DataFrame:
    """Count, moments and quartiles of each group, and its standardised mean difference against the base group."""
    s = rows.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    b = s.where(F.col(group) == base).select(F.col("mean").alias("_m"), F.col("sd").alias("_s"))
    out = s.crossJoin(F.broadcast(b)).select(group, "n", "mean", "sd", F.try_divide(F.col("mean") - F.col("_m"), F.sqrt((F.col("sd") ** 2 + F.col("_s") ** 2) / 2)).alias("smd"))  # b is one row
    return out.join(quantiles(rows, [group], value, QUARTILES), group, "left")


def group_summary(rows: DataFrame, group: str, value: str, p: str | None = None, alpha: float = 0.05) -> DataFrame:
    """Count, moments and quartiles for each group and for ALL; with p, the share of p below alpha and its standard error."""
    both = rows.withColumn(group, F.explode(F.array(F.col(group), F.lit("ALL"))))
    below = (F.col(p) < alpha).cast("double") if p else None
    out = both.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), *([F.avg(below).alias("share_below"), F.sqrt(F.avg(below) * (1 - F.avg(below)) / F.count(p)).alias("share_se")] if p else []))
    return out.join(quantiles(both, [group], value, QUARTILES), group, "left")


def welch(rows: DataFrame, keys, label: str, value: str) -> DataFrame:
    """Difference of means of label 1 less 0 with its 95% interval, t, Satterthwaite degrees of freedom and Cohen's d."""
    f = lambda y, agg: agg(F.when(F.col(label) == y, F.col(value)))
    s = rows.groupBy(*keys).agg(*[f(y, a).alias(f"{n}{y}") for y in (0, 1) for n, a in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    a, b = F.try_divide("v1", "n1"), F.try_divide("v0", "n0")
    pooled = F.sqrt(F.try_divide((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0"), F.col("n1") + F.col("n0") - 2))
    out = s.select(*keys, "n0", "n1", F.sqrt(a + b).alias("_se"), (F.col("m1") - F.col("m0")).alias("diff"), F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(a + b)).alias("t"), F.try_divide((a + b) ** 2, F.try_divide(a**2, F.col("n1") - 1) + F.try_divide(b**2, F.col("n0") - 1)).alias("df"), F.try_divide(F.col("m1") - F.col("m0"), pooled).alias("d"))
    half = fn.student_quantile(F.col("df")) * F.col("_se")
    return out.withColumn("low", F.col("diff") - half).withColumn("high", F.col("diff") + half).drop("_se")


def mann_whitney(preds: DataFrame, keys=("arm",)) -> DataFrame:
    """U of the positives, z with tie-corrected variance and continuity, and its two-sided p."""
    t = cumulative(preds, keys).withColumn("_t", F.col("pos") + F.col("neg")).withColumn("_u", F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    s = t.groupBy(*keys).agg(F.sum("_u").alias("u"), F.sum("pos").cast("double").alias("_p"), F.sum("neg").cast("double").alias("_n"), F.sum(F.col("_t").cast("double") ** 3 - F.col("_t")).alias("_c"))
    n = F.col("_p") + F.col("_n")
    var = F.col("_p") * F.col("_n") / 12 * ((n + 1) - F.try_divide("_c", n * (n - 1)))
    gap = F.col("u") - F.col("_p") * F.col("_n") / 2
    return s.select(*keys, "u", F.try_divide(F.signum(gap) * F.greatest(F.abs(gap) - 0.5, F.lit(0.0)), F.sqrt(var)).alias("z")).withColumn("p", fn.normal_p(F.col("z")))


def kruskal_wallis(rows: DataFrame, keys, group: str, value: str) -> DataFrame:
    """H over the groups with ties."""
    ranked = average_rank(rows.select(*keys, group, F.col(value).alias("_v")), "_v", keys)
    ties = rows.groupBy(*keys, value).agg(F.count("*").cast("double").alias("_t")).groupBy(*keys).agg(F.sum(F.col("_t") ** 3 - F.col("_t")).alias("_c"))
    g = ranked.groupBy(*keys, group).agg(F.sum("rank").alias("_r"), F.count("*").cast("double").alias("_n")).groupBy(*keys).agg(F.sum(F.col("_r") ** 2 / F.col("_n")).alias("_s"), F.sum("_n").alias("_n"), F.count("*").alias("groups"))
    n = F.col("_n")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("_s") - 3 * (n + 1), 1 - F.try_divide("_c", n**3 - n))
    return g.join(ties, list(keys)).select(*keys, "groups", h.alias("h"))


def rayleigh(angles: DataFrame, keys, angle: str = "angle") -> DataFrame:
    """Mean resultant length, mean angle, variance, Z and p of angles: of up to 50 by the small-sample form, else by the expansion in 1 / n."""
    s = angles.groupBy(*keys).agg(F.count(angle).alias("n"), F.avg(F.cos(angle)).alias("_c"), F.avg(F.sin(angle)).alias("_s"))
    out = s.select(*keys, "n", F.hypot("_c", "_s").alias("length"), F.atan2("_s", "_c").alias("mean_angle"), (1 - F.hypot("_c", "_s")).alias("variance"), (F.col("n") * (F.col("_c") ** 2 + F.col("_s") ** 2)).alias("z"))
    n, z = F.col("n").cast("double"), F.col("z")
    small = F.exp(F.sqrt(F.greatest(1 + 4 * n + 4 * (n * n - n * z), F.lit(0.0))) - (1 + 2 * n))
    large = F.exp(-z) * (1 + (2 * z - z**2) / (4 * n) - (24 * z - 132 * z**2 + 76 * z**3 - 9 * z**4) / (288 * n * n))
    return out.withColumn("p", F.least(F.greatest(F.when(n <= 50, small).when(z > 50, 0.0).otherwise(large), F.lit(0.0)), F.lit(1.0)))


def phase_histogram(angles: DataFrame, keys, bins: int = 24, angle: str = "angle") -> DataFrame:
    width = 2 * math.pi / bins
    n = angles.groupBy(*keys, F.least(F.floor((F.col(angle) + math.pi) / width), F.lit(bins - 1)).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("density", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)) / width)


def phase_uniformity(angles: DataFrame, keys, bins: int = 24, angle: str = "angle") -> DataFrame:
    """Rayleigh's test of each group beside its fullest bin, the first of equal ones, and chi-square of the bins against equal counts."""
    h = phase_histogram(angles, keys, bins, angle).groupBy(*keys).agg(F.max_by("bin", F.struct(F.col("n"), -F.col("bin"))).alias("mode_bin"), (F.sum(F.col("n") ** 2) * bins / F.sum("n") - F.sum("n")).alias("chi_square"))
    return rayleigh(angles, keys, angle).join(h, list(keys))


def holm(tests: DataFrame, keys, p: str = "p") -> DataFrame:
    """Step-down adjusted p-values within a family."""
    w = Window.partitionBy(*keys).orderBy(p, "test")
    m = F.count("*").over(Window.partitionBy(*keys))
    raw = (m - F.row_number().over(w) + 1) * F.col(p)
    return tests.withColumn("_a", raw).withColumn("adjusted", F.least(F.lit(1.0), F.max("_a").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_a")


def balance_report(rows: DataFrame, split: str, variables, label: str | None = None) -> DataFrame:
    """Share of each level in each split, and the largest difference between splits in percentage points.

    With a label its own levels are reported too, and every variable again beside the label (as `label x variable`, levels joined by |).
    """
    cell = lambda *c: F.concat_ws("|", *[F.coalesce(F.col(x).cast("string"), F.lit("<MISSING>")) for x in c])
    named = [*[(v, (v,)) for v in variables], *([(label, (label,)), *[(f"{label} x {v}", (label, v)) for v in variables]] if label else [])]
    long = rows.select(split, F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), cell(*c).alias("level")) for n, c in named])).alias("x")).select(split, "x.*")
    totals = rows.groupBy(split).agg(F.count("*").alias("_t"))
    cells = long.groupBy("variable", "level", split).agg(F.count("*").alias("n"))
    levels = cells.select("variable", "level").distinct().crossJoin(F.broadcast(totals))  # one row for each split
    shares = levels.join(cells, ["variable", "level", split], "left").withColumn("_s", 100 * F.coalesce("n", F.lit(0)) / F.col("_t"))
    return shares.groupBy("variable", "level").agg((F.max("_s") - F.min("_s")).alias("max_pp"))


def joint_strata(rows: DataFrame, split: str, variables, least: int = 10) -> DataFrame:
    """For each split: strata of all variables together, those of `least` rows or more, and how many of either it has no row of."""
    key = F.concat_ws("|", *[F.coalesce(F.col(v).cast("string"), F.lit("<MISSING>")) for v in variables])
    cells = rows.groupBy(key.alias("stratum"), F.col(split)).agg(F.count("*").alias("n"))
    whole = cells.groupBy("stratum").agg(F.sum("n").alias("_n")).agg(F.count("*").alias("strata"), F.count_if(F.col("_n") >= least).alias("large"))
    size = cells.groupBy("stratum").agg(F.sum("n").alias("_n"))
    own = cells.join(size, "stratum").groupBy(split).agg(F.count("*").alias("_a"), F.count_if(F.col("_n") >= least).alias("_l"))
    return own.crossJoin(F.broadcast(whole)).select(split, "strata", "large", (F.col("strata") - F.col("_a")).alias("zero_cells"), (F.col("large") - F.col("_l")).alias("zero_large"))  # whole is one row


def worst_balance(report: DataFrame, k: int) -> DataFrame:
    return report.orderBy(F.desc("max_pp"), "variable", "level").limit(k)


def bootstrap_means(rows: DataFrame, strata: str, id_col: str, value: str, draws: int, tag: str, keys=()) -> DataFrame:
    """(keys, draw, mean, n): the mean of each of `draws` resamples that hold each stratum's number of ids.

    A draw takes as many ids from a stratum, with replacement, as it has; all rows of an id are taken as often as the id, so arms of
    the same ids share their draws. How often is found in resampling.hits, by halving ranks: ids are ranked by hash in
    buckets, and CHUNK neighbouring ranks are one group. Rows of one id and key are summed up first;
    sums of each draw are combined by Spark, so draws x keys sums of a group are shuffled and no draw is joined to rows. Null values
    don't count. mean is null where a draw has no value of a key.
    """
    keys = list(keys)
    own = rows.groupBy(strata, id_col, *keys).agg(F.sum(value).alias("_s"), F.count(value).alias("_c"))
    ranked = hash_rank(own.select(strata, id_col).distinct(), [strata], fn.hash_rank_key(tag, F.col(id_col)), id_col)
    key = F.to_json(F.struct(F.lit(0).alias("_"), *keys))
    placed = join_nulls(own, ranked, [strata, id_col]).select(F.coalesce(F.col(strata).cast("string"), F.lit("\0")).alias("_stratum"), (F.col("rank") - 1).alias("_at"), F.col("rank_of").alias("_n"), key.alias("_j"), F.coalesce(F.col("_s").cast("double"), F.lit(0.0)).alias("_s"), "_c")
    drawn = resampling.sums(placed, draws, tag).select("_j", "draw", F.try_divide("_s", "n").alias("mean"), "n")
    named = own.select(*keys).distinct().withColumn("_j", key)
    return drawn.join(named, "_j").select(*keys, "draw", "mean", "n")


def bootstrap_bands(draws: DataFrame, points: DataFrame, keys, at: str, level: float = 0.95) -> DataFrame:
    """Bands of curves: pointwise percentiles, standard error, and the studentised simultaneous band.

    draws (keys, at, draw, mean), points (keys, at, point). A draw's largest |mean - point| / SE over a curve is taken,
    and the critical value is the `level` quantile of those maxima.
    """
    keys, tail = list(keys), (1 - level) / 2
    q = lambda p: F.percentile(fn.steady(F.col("mean")), F.lit(p))
    own = draws.groupBy(*keys, at).agg(q(tail).alias("low"), q(1 - tail).alias("high"), F.greatest(F.stddev_samp("mean"), F.lit(1e-12)).alias("se"), F.count("*").alias("draws")).join(points, [*keys, at])
    most = draws.join(own, [*keys, at]).groupBy(*keys, "draw").agg(F.max(F.abs(F.col("mean") - F.col("point")) / F.col("se")).alias("_m")).groupBy(*keys).agg(F.percentile("_m", F.lit(level)).alias("critical"))
    return (own.join(most, keys) if keys else own.crossJoin(F.broadcast(most))).withColumn("sim_low", F.col("point") - F.col("critical") * F.col("se")).withColumn("sim_high", F.col("point") + F.col("critical") * F.col("se"))  # most is one row for a curve
