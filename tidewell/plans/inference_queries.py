"""Registered queries of comparisons, robust fits, checks and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators import cohorts, evaluation as ev, inference as inf, quality, rhythms, splits
from tidewell.plans import fits_sql as fs, views as vw
from tidewell.plans.queries import COV, CUM, D, DM, DW, E, P, PERIODS, WM, add, days, events, wins, wmeans

preds = vw.predictions
add("delong_ci", lambda s, d: ev.delong(preds(s, d)), "SELECT arm, a AS auroc, sqrt(va / p + vb / n) AS se, greatest(0, a - 1.96 * sqrt(va / p + vb / n)) AS low, least(1, a + 1.96 * sqrt(va / p + vb / n)) AS high FROM (SELECT arm, avg(v) FILTER (y = 1) AS a, var_samp(v) FILTER (y = 1) AS va, var_samp(v) FILTER (y = 0) AS vb, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS n FROM pl GROUP BY 1)", CUM + ", pl AS (SELECT p.arm, p.y, CASE WHEN p.y = 1 THEN (c.below + c.neg / 2) / c.nn ELSE (c.tp - c.pos / 2) / c.np END AS v FROM predictions p JOIN c ON c.arm = p.arm AND c.score = p.score)\n", "auroc se low high")
AU = lambda keys: f"WITH {vw.PREDICTIONS_SQL}, tk AS (SELECT {keys}, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM predictions GROUP BY ALL), au AS (SELECT {keys}, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auroc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM tk) GROUP BY ALL)\n"
add("subgroup_metrics", lambda s, d: inf.subgroup_metrics(preds(s, d), "grp", "length", "mixed"), "SELECT *, auroc_a - auroc_b AS delta FROM (SELECT grp, max(auroc) FILTER (arm = 'length') AS auroc_a, max(auroc) FILTER (arm = 'mixed') AS auroc_b FROM au GROUP BY 1) JOIN (SELECT grp, count(*) AS n, corr(a, b) AS spearman FROM (SELECT grp, user_id, max(r) FILTER (arm = 'length') AS a, max(r) FILTER (arm = 'mixed') AS b FROM (SELECT *, rank() OVER (PARTITION BY grp, arm ORDER BY score) + (count(*) OVER (PARTITION BY grp, arm, score) - 1) / 2 AS r FROM predictions) GROUP BY ALL) GROUP BY 1) USING (grp)", AU("grp, arm"), "auroc_a auroc_b spearman delta")
deltas = lambda s, d: inf.subgroup_metrics(preds(s, d).withColumn("fold", F.col("user_id") % 7), "fold", "length", "mixed")
add("repeat_summary", lambda s, d: inf.repeat_summary(deltas(s, d), []), "SELECT count(x) AS n, avg(x) AS mean, stddev_samp(x) AS sd, median(x) AS median, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr, avg((x > 0)::INT) AS share_above, avg(x) - ([12.706, 4.303, 3.182, 2.776, 2.571, 2.447])[count(x) - 1] * stddev_samp(x) / sqrt(count(x)) AS low, avg(x) + ([12.706, 4.303, 3.182, 2.776, 2.571, 2.447])[count(x) - 1] * stddev_samp(x) / sqrt(count(x)) AS high, greatest(avg((x > 0)::INT), 1 - avg((x > 0)::INT)) AS agreement FROM (SELECT max(auroc) FILTER (arm = 'length') - max(auroc) FILTER (arm = 'mixed') AS x FROM au GROUP BY fold)", AU("fold, arm").replace("FROM predictions GROUP BY ALL", "FROM (SELECT *, user_id % 7 AS fold FROM predictions) GROUP BY ALL"), "mean sd median iqr share_above low high agreement")
lengths = lambda s, d: vw.table(s, d, "documents").select(F.col("doc_id").alias("user_id"), "n_chars")
add("abstention_profile", lambda s, d: inf.abstention_profile(preds(s, d), 0.3, 0.7, lengths(s, d), ["n_chars"]), "SELECT arm, CASE WHEN score <= 0.3 OR score >= 0.7 THEN 'labelled' ELSE 'abstained' END AS state, count(*) AS n, avg(y) AS rate, avg(n_chars) AS n_chars FROM predictions JOIN (SELECT doc_id AS user_id, n_chars FROM documents) USING (user_id) GROUP BY ALL", P, "rate n_chars")
add("outcome_groups", lambda s, d: inf.outcome_groups(preds(s, d), "length", "mixed").groupBy("outcome").agg(F.count("*").alias("n")), "SELECT CASE WHEN a AND b THEN 'both_right' WHEN b THEN 'rescued' WHEN a THEN 'degraded' ELSE 'both_wrong' END AS outcome, count(*) AS n FROM (SELECT user_id, bool_or(ok) FILTER (arm = 'length') AS a, bool_or(ok) FILTER (arm = 'mixed') AS b FROM (SELECT user_id, arm, (score >= median(score) OVER (PARTITION BY arm))::INT = y AS ok FROM predictions) GROUP BY 1) GROUP BY 1", P)
add("user_mean_prediction", lambda s, d: inf.user_mean_prediction(preds(s, d)), "SELECT user_id, y, avg(score) AS score, count(*) AS rows, 1 / count(*) AS weight FROM predictions GROUP BY ALL", P, "score weight")
add("cohen_d", lambda s, d: ev.welch(preds(s, d), ["arm", "grp"], "y", "score").select("arm", "grp", "diff", "d", "df"), "SELECT arm, grp, m1 - m0 AS diff, (m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS d, (v1 / n1 + v0 / n0) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v0 / n0) ** 2 / (n0 - 1)) AS df FROM (SELECT arm, grp, count(*) FILTER (y = 0) AS n0, count(*) FILTER (y = 1) AS n1, avg(score) FILTER (y = 0) AS m0, avg(score) FILTER (y = 1) AS m1, var_samp(score) FILTER (y = 0) AS v0, var_samp(score) FILTER (y = 1) AS v1 FROM predictions GROUP BY ALL)", P, "diff d df")
add("orthogonal_auroc", lambda s, d: ev.auroc(inf.orthogonal(preds(s, d), "mixed", "length")), "SELECT arm, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auroc, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT 'mixed|length' AS arm, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM ort GROUP BY ALL)) GROUP BY 1", P + ", wp AS (SELECT user_id, y, max(score) FILTER (arm = 'mixed') AS a, max(score) FILTER (arm = 'length') AS b FROM predictions GROUP BY ALL), ort AS (SELECT user_id, y, round(a - ma - sl * (b - mb), 9) AS score FROM wp, (SELECT regr_slope(a, b) AS sl, avg(a) AS ma, avg(b) AS mb FROM wp))\n", "auroc")
people = lambda s, d: vw.table(s, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").cast("double").alias("y"), (F.col("c_nationkey") % 5).cast("long").alias("grp"), F.col("c_nationkey").cast("double").alias("x"))
OLS = "WITH pe AS (SELECT c_custkey AS user_id, c_acctbal::DOUBLE AS y, (c_nationkey % 5)::BIGINT AS grp, c_nationkey::DOUBLE AS x FROM customer)\n"
add("ols_hc3", lambda s, d: inf.ols_hc3(people(s, d), "y", ["x"])[0], "SELECT unnest(['intercept', 'x']) AS term, unnest([max(a), max(b)]) AS estimate, unnest([sqrt(sum((1 / n - mx * (x - mx) / sxx) ** 2 * w)), sqrt(sum((x - mx) ** 2 * w) / max(sxx) ** 2)]) AS se, unnest([max(n), max(n)]) AS n FROM (SELECT x, n, mx, sxx, a, b, ((y - a - b * x) / (1 - 1 / n - (x - mx) ** 2 / sxx)) ** 2 AS w FROM pe, (SELECT count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM pe))", OLS, "estimate se")
_dm = lambda s, d: inf.dummies(people(s, d), "grp", range(5), 0)
_dn = [f"grp_{i}" for i in range(1, 5)]
add("ancova", lambda s, d: inf.ols_hc3(_dm(s, d), "y", _dn)[0], "SELECT CASE grp WHEN 0 THEN 'intercept' ELSE 'grp_' || grp END AS term, CASE grp WHEN 0 THEN m ELSE m - (SELECT m FROM gm WHERE grp = 0) END AS estimate, sqrt(CASE grp WHEN 0 THEN v ELSE v + (SELECT v FROM gm WHERE grp = 0) END) AS se, (SELECT count(*) FROM pe) AS n FROM gm", OLS + ", gm AS (SELECT grp, avg(y) AS m, var_pop(y) * count(*) / (1 - 1 / count(*)) ** 2 / count(*) ** 2 AS v FROM pe GROUP BY 1)\n", "estimate se")
_k = (2.0, 8.0, 15.0, 22.0)
_t = lambda t, n: f"(greatest(x - {t}, 0) ** {n} - greatest(x - 15, 0) ** {n} * {(22.0 - t) / 7} + greatest(x - 22, 0) ** {n} * {(15.0 - t) / 7})"
add("rcs_design", lambda s, d: inf.rcs(people(s, d).select("user_id", "x"), "x", _k), f"SELECT user_id, x, x AS rcs_1, 1.0::DOUBLE AS d_rcs_1, {_t(2, 3)} / 400 AS rcs_2, 3 * {_t(2, 2)} / 400 AS d_rcs_2, {_t(8, 3)} / 400 AS rcs_3, 3 * {_t(8, 2)} / 400 AS d_rcs_3 FROM pe", OLS, "rcs_2 d_rcs_2 rcs_3 d_rcs_3")
curve = lambda s, d: events(s, d).groupBy("user_id", "hour").agg((F.avg("value") - 60).alias("v"))
add("transition_metrics", lambda s, d: inf.transitions(curve(s, d), ["user_id"], "hour", "v"), "SELECT user_id, CASE WHEN loc > a AND loc < z THEN loc END AS lowest_at, CASE WHEN loc > a AND loc < z THEN lowest END AS lowest, crossing FROM (SELECT user_id, arg_min(hour, (v, hour)) AS loc, min(v) AS lowest, min(hour) AS a, max(hour) AS z, min(CASE WHEN pv > 0 AND v <= 0 THEN ph + (hour - ph) * pv / (pv - v) END) AS crossing FROM (SELECT *, lag(hour) OVER w AS ph, lag(v) OVER w AS pv FROM cv WINDOW w AS (PARTITION BY user_id ORDER BY hour)) GROUP BY 1)", E + ", cv AS (SELECT user_id, hour, avg(value) - 60 AS v FROM e GROUP BY ALL)\n", "lowest crossing")


def age_curves(s, d):
    """Spline fit of the balance on the nation's number, predicted on a grid inside the knots."""
    terms, _ = inf.ols_hc3(inf.rcs(people(s, d), "x", _k), "y", ["rcs_1", "rcs_2", "rcs_3"])
    coef = terms.groupBy().agg(*[F.max(F.when(F.col("term") == t, F.col("estimate"))).alias(f"_{t}") for t in ("intercept", "rcs_1", "rcs_2", "rcs_3")])
    grid = inf.rcs(people(s, d).select("x").distinct().where(F.col("x").between(_k[0], _k[-1])), "x", _k)
    fit = sum((F.col(f"_rcs_{i}") * F.col(f"rcs_{i}") for i in (1, 2, 3)), F.col("_intercept"))
    return grid.crossJoin(F.broadcast(coef)).select("x", fit.alias("fit"), sum((F.col(f"_rcs_{i}") * F.col(f"d_rcs_{i}") for i in (2, 3)), F.col("_rcs_1")).alias("slope"))


AGES = OLS.rstrip() + f", sp AS (SELECT y, x, {_t(2, 3)} / 400 AS r2, 3 * {_t(2, 2)} / 400 AS d2, {_t(8, 3)} / 400 AS r3, 3 * {_t(8, 2)} / 400 AS d3 FROM pe), " + fs.solved("sp", "", ["1.0", "x", "r2", "r3"], "y")
add("age_curves", age_curves, "SELECT DISTINCT x, b[1] + b[2] * x + b[3] * r2 + b[4] * r3 AS fit, b[2] + b[3] * d2 + b[4] * d3 AS slope FROM sp, lq WHERE x BETWEEN 2 AND 22", AGES, "fit slope")
rayleigh_p = lambda s, d: ev.rayleigh(events(s, d).select("user_id", "channel", (2 * F.pi() * F.pmod("local_ms", F.lit(fn.DAY_MS)) / fn.DAY_MS).alias("angle")), ["user_id", "channel"]).select("user_id", F.col("channel").cast("string").alias("test"), F.exp(-F.col("z")).alias("p"))
add("holm_adjust", lambda s, d: ev.holm(rayleigh_p(s, d), ["user_id"]), "SELECT user_id, test, p, least(1, max((m - i + 1) * p) OVER (PARTITION BY user_id ORDER BY p, test ROWS UNBOUNDED PRECEDING)) AS adjusted FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS m, row_number() OVER (PARTITION BY user_id ORDER BY p, test) AS i FROM rp)", E + ", rp AS (SELECT user_id, channel::VARCHAR AS test, exp(-count(*) * (avg(cos(t)) ** 2 + avg(sin(t)) ** 2)) AS p FROM (SELECT user_id, channel, 2 * pi() * (local_ms % 86400000) / 86400000 AS t FROM e) GROUP BY ALL)\n", "p adjusted")
add("eligibility_summary", lambda s, d: vw.demographics(s, d).groupBy("bmi_grp").agg(F.count("*").alias("candidates"), F.count_if(F.col("salutation").isin(10, 20)).alias("eligible"), F.count_if(F.col("salutation") == 10).alias("n0"), F.count_if(F.col("salutation") == 20).alias("n1"), F.median(F.when(F.col("salutation").isin(10, 20), 2024 - F.col("birth_year"))).alias("median_age")), "SELECT bmi_grp, count(*) AS candidates, count(*) FILTER (salutation IN (10, 20)) AS eligible, count(*) FILTER (salutation = 10) AS n0, count(*) FILTER (salutation = 20) AS n1, median(2024 - birth_year) FILTER (salutation IN (10, 20)) AS median_age FROM demographics GROUP BY 1", DM, "median_age")

# Splits and limits
add("balanced_folds", lambda s, d: splits.balanced_folds(vw.demographics(s, d), "user_id", ["age_group", "bmi_grp"], "bal"), "SELECT user_id, age_group, bmi_grp, (row_number() OVER (ORDER BY age_group, bmi_grp, sha256('bal|' || user_id), user_id) - 1) % 5 AS fold FROM demographics", DM)
add("customer_split", lambda s, d: splits.customer_split(preds(s, d).select("user_id", "arm", "y"), "user_id", "y", "cs"), "SELECT user_id, arm, y, CASE WHEN r <= round(n * 0.15) THEN 'test' WHEN r <= round(n * 0.15) + round(n * 0.15) THEN 'val' ELSE 'train' END AS split FROM predictions JOIN (SELECT user_id, row_number() OVER (PARTITION BY y ORDER BY sha256('cs|' || user_id), user_id) AS r, count(*) OVER (PARTITION BY y) AS n FROM (SELECT DISTINCT user_id, y FROM predictions)) USING (user_id)", P)
orders = lambda s, d: vw.table(s, d, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 50 != 0, (F.col("o_custkey") % 2).cast("long")).alias("y")).unionByName(vw.table(s, d, "orders").where("o_orderkey % 97 = 0").select("o_custkey", F.lit(1).cast("long").alias("y")))
dealt = lambda s, d: vw.table(s, d, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("o_custkey"), F.expr("CASE WHEN c_custkey % 7 < 5 THEN 'train' WHEN c_custkey % 7 = 5 THEN 'val' WHEN c_custkey % 2 = 1 THEN 'test' END").alias("split"))
SPLIT_CHECKS = """WITH r AS (SELECT o_custkey AS k, CASE WHEN o_orderkey % 50 <> 0 THEN (o_custkey % 2)::BIGINT END AS y FROM orders UNION ALL SELECT o_custkey, 1 FROM orders WHERE o_orderkey % 97 = 0),
o AS (SELECT k, min(y) AS a, max(y) AS b FROM r GROUP BY 1), a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 < 5 THEN 'train' WHEN c_custkey % 7 = 5 THEN 'val' WHEN c_custkey % 2 = 1 THEN 'test' END AS split FROM customer WHERE c_custkey % 10 <> 3),
p AS (SELECT s.split, count(DISTINCT o.a) AS n FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN (a JOIN o ON a.k = o.k AND o.a = o.b) ON a.split = s.split GROUP BY 1)
"""
add("split_checks", lambda s, d: splits.split_checks(orders(s, d), "o_custkey", "y", dealt(s, d)), """SELECT "check", violations, violations = 0 AS passed FROM (SELECT unnest(['missing_entity', 'missing_label', 'conflicting_label', 'other_label', 'unassigned', 'unknown_entity', 'assigned_twice', 'unknown_split', 'single_class']) AS "check", unnest([(SELECT count(*) FROM r WHERE k IS NULL), (SELECT count(*) FROM r WHERE y IS NULL), (SELECT count(*) FROM o WHERE a <> b), 0, (SELECT count(*) FROM o ANTI JOIN a USING (k)), (SELECT count(*) FROM a ANTI JOIN o USING (k)), 0, (SELECT count(*) FROM a WHERE split IS NULL), (SELECT count(*) FROM p WHERE n < 2)]) AS violations)""", SPLIT_CHECKS)
add("limit_users", lambda s, d: events(s, d).join(vw.demographics(s, d).select("user_id").orderBy("user_id").limit(10), "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n")), f", {vw.DEMOGRAPHICS_SQL} SELECT user_id, count(*) AS n FROM e WHERE user_id IN (SELECT user_id FROM demographics ORDER BY user_id LIMIT 10) GROUP BY 1", E)

# Checks
counts = lambda s, d: events(s, d).groupBy(F.col("source").cast("string").alias("name")).agg(F.count("*").alias("n"))
frozen = lambda s, d: vw.epochs(s, d).groupBy(F.col("source").cast("string").alias("name")).agg(F.count("*").alias("n"))
add("anchor_counts", lambda s, d: quality.anchor_counts(counts(s, d), frozen(s, d)), "SELECT name, actual, expected FROM (SELECT source::VARCHAR AS name, count(*) AS actual FROM e GROUP BY 1) FULL JOIN (SELECT source::VARCHAR AS name, count(*) AS expected FROM epochs GROUP BY 1) USING (name) WHERE actual IS DISTINCT FROM expected", E)
add("feature_checks", lambda s, d: quality.feature_checks(days(s, d)), "SELECT item, violations, violations = 0 AS passed FROM (SELECT unnest(['hours_in_range', 'mean_between_extremes', 'sd_not_negative', 'events_cover_hours', 'coverage_not_negative', 'keys_unique']) AS item, unnest([count(*) FILTER (hours NOT BETWEEN 1 AND 24), count(*) FILTER (NOT mean BETWEEN vmin - 1e-9 AND vmax + 1e-9), count(*) FILTER (sd < 0), count(*) FILTER (n < hours), count(*) FILTER (cov_s < 0), count(*) - count(DISTINCT (user_id, channel, day))]) AS violations FROM days)", COV)
add("pair_checks", lambda s, d: quality.pair_checks(wins(s, d)), "SELECT user_id, max(start_day) FILTER (window_index = 2) - max(start_day) FILTER (window_index = 1) < 180 AS overlap, count(*) FILTER (window_index = 1) = 0 AS no_first, count(*) FILTER (window_index = 2) = 0 AS no_second FROM win GROUP BY 1", DW)

# Scalar functions
add("scalar_string", lambda s, d: vw.demographics(s, d).select("user_id", F.concat_ws("|", F.lower(F.trim("bmi_grp")), F.coalesce(F.col("salutation").cast("string"), F.lit(fn.MISSING))).alias("cell"), F.regexp_extract(F.col("birth_year").cast("string"), "([0-9]{4})", 1).alias("year"), F.format_string("%02d:%02d", F.floor(F.col("user_id") % 288 / 12), F.col("user_id") % 12 * 5).alias("clock")), "SELECT user_id, lower(trim(bmi_grp)) || '|' || coalesce(salutation::VARCHAR, '<MISSING>') AS cell, birth_year::VARCHAR AS year, printf('%02d:%02d', user_id % 288 // 12, user_id % 12 * 5) AS clock FROM demographics", DM)
add("scalar_hash", lambda s, d: vw.demographics(s, d).select("user_id", F.conv(F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 12), 16, 10).cast("long").alias("seed")), "SELECT user_id, ('0x' || substr(sha256(user_id::VARCHAR), 1, 12))::BIGINT AS seed FROM demographics", DM)
_date = lambda: F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))
add("scalar_date", lambda s, d: vw.daily_values(s, d).select("user_id", "day", F.date_format(_date(), "yyyy-MM-dd").alias("date"), fn.week_start(F.col("day")).alias("monday"), F.year(_date()).cast("long").alias("year"), F.month(_date()).cast("long").alias("month")), "SELECT user_id, day, strftime(DATE '1970-01-01' + day::INT, '%Y-%m-%d') AS date, day - (day + 3) % 7 AS monday, year(DATE '1970-01-01' + day::INT) AS year, month(DATE '1970-01-01' + day::INT) AS month FROM daily_values", D)
add("scalar_math", lambda s, d: vw.daily_values(s, d).select("user_id", "day", F.hypot(F.col("value"), F.lit(3.0)).alias("h"), fn.wrap_phase(2 * F.pi() * F.col("day") / 29.530588).alias("moon"), F.greatest(F.lit(10.0), F.least(F.lit(40.0), F.col("value"))).alias("clipped"), (-F.col("value") / 100 * F.log(F.col("value") / 100)).alias("entropy")), "SELECT user_id, day, sqrt(value ** 2 + 9) AS h, atan2(sin(2 * pi() * day / 29.530588), cos(2 * pi() * day / 29.530588)) AS moon, greatest(10, least(40, value)) AS clipped, -value / 100 * ln(value / 100) AS entropy FROM daily_values", D, "h moon clipped entropy")
add("scalar_json", lambda s, d: vw.demographics(s, d).select("user_id", F.to_json(F.struct("age_group", "bmi_grp")).alias("cell")), "SELECT user_id, '{\"age_group\":' || age_group || ',\"bmi_grp\":\"' || bmi_grp || '\"}' AS cell FROM demographics", DM)
