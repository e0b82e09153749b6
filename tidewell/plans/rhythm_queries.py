"""Registered queries of periods: spectra, cosinor fits, coherence, drift, persistence and autocorrelation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import cohorts, inference as inf, rhythms
from tidewell.plans import views as vw
from tidewell.plans.queries import D, DET, DW, SPEC, WM, add, spec, wins, wmeans

add("lomb_scargle", spec, "SELECT * FROM sp", SPEC, "power amplitude phase")
FLANK = "median(power) FILTER (period BETWEEN 14 AND 22 OR period BETWEEN 38 AND 56)"
_top = lambda c: f"arg_max({c}, (round(power, 9), -period)) AS {c}"
add("spectral_peak", lambda s, d: rhythms.peak(spec(s, d)).drop("phase"), f"SELECT user_id, {_top('period')}, {_top('power')}, {_top('amplitude')}, {FLANK} AS noise_floor, max(power) / nullif({FLANK}, 0) AS snr FROM sp WHERE power IS NOT NULL GROUP BY 1", SPEC, "power amplitude noise_floor snr")
PARTIAL = lambda p, q: f"({p}{q} - coalesce({p}t * {q}t / nullif(tt, 0), 0))"
_cc, _ss, _cs, _cy, _sy, _yy = (PARTIAL(*x) for x in ("cc", "ss", "cs", "cy", "sy", "yy"))
CG = D + f""", x AS (SELECT user_id, period, (day - d0)::DOUBLE AS t, value AS y, cos(2 * pi() * day / period) AS c, sin(2 * pi() * day / period) AS s FROM daily_values JOIN (SELECT user_id, min(day) AS d0 FROM daily_values GROUP BY 1) USING (user_id), (SELECT unnest(range(28, 113)) / 2 AS period)),
mm AS (SELECT user_id, period, count(*) AS n, covar_pop(c, c) AS cc, covar_pop(s, s) AS ss, covar_pop(c, s) AS cs, covar_pop(c, y) AS cy, covar_pop(s, y) AS sy, covar_pop(y, y) AS yy, covar_pop(c, t) AS ct, covar_pop(s, t) AS st, covar_pop(y, t) AS yt, covar_pop(t, t) AS tt FROM x GROUP BY ALL HAVING count(*) > 4),
fi AS (SELECT user_id, period, n, yy, {_yy} AS null_ss, CASE WHEN {_cc} * {_ss} - {_cs} ** 2 > 1e-9 THEN ({_cy} * {_ss} - {_sy} * {_cs}) / ({_cc} * {_ss} - {_cs} ** 2) END AS b, CASE WHEN {_cc} * {_ss} - {_cs} ** 2 > 1e-9 THEN ({_sy} * {_cc} - {_cy} * {_cs}) / ({_cc} * {_ss} - {_cs} ** 2) END AS g, {_cy} AS cy, {_sy} AS sy FROM mm)
"""
add("cosinor_grid", lambda s, d: rhythms.cosinor_grid(vw.daily_values(s, d)), "SELECT *, (1 + 2 * f / (n - 4)) ** (-(n - 4) / 2) AS p FROM (SELECT user_id, period, n, gain / nullif(yy, 0) AS delta_r2, 1 - null_ss / nullif(yy, 0) AS r2_null, sqrt(b ** 2 + g ** 2) AS amplitude, atan2(g, b) AS acrophase, CASE WHEN null_ss - gain > 1e-12 THEN gain / 2 / ((null_ss - gain) / (n - 4)) END AS f FROM (SELECT *, b * cy + g * sy AS gain FROM fi))", CG, "delta_r2 r2_null amplitude acrophase f p")
teams = lambda s, d: spec(s, d).withColumn("team", F.col("user_id") % 3)
add("phase_coherence", lambda s, d: rhythms.phase_coherence(teams(s, d), "team"), "SELECT r.*, exceed_share, coherence_near, period_at_max FROM r JOIN (SELECT team, avg((coherence > null95)::INT) AS exceed_share, arg_min(coherence, (abs(period - 29.530589), period)) AS coherence_near, arg_max(period, (round(coherence, 9), -period)) AS period_at_max FROM r GROUP BY 1) USING (team)", SPEC + ", r AS (SELECT *, sqrt(-ln(0.05) / n) AS null95 FROM (SELECT user_id % 3 AS team, period, count(*) AS n, sqrt(avg(cos(phase)) ** 2 + avg(sin(phase)) ** 2) AS coherence FROM sp WHERE phase IS NOT NULL GROUP BY ALL))\n", "coherence null95 exceed_share coherence_near")


def spectra_sql(rows: str, keys: str) -> str:
    """CTEs from `rows` (keys, day, value) to pk, the peak of each key's detrended series."""
    on = keys.replace(" ", "")
    return f""", ft AS (SELECT {keys}, coalesce(regr_slope(value, day), 0) AS b, avg(value) AS m, avg(day) AS t FROM {rows} GROUP BY ALL), rs AS (SELECT {keys}, day, value - m - b * (day - t) AS y FROM {rows} JOIN ft USING ({on})),
xp AS (SELECT {keys}, period, y, cos(2 * pi() * day / period) AS c, sin(2 * pi() * day / period) AS s FROM rs, (SELECT unnest(range(28, 113)) / 2 AS period)), mm AS (SELECT {keys}, period, avg(c * c) AS cc, avg(s * s) AS ss, avg(c * s) AS cs, avg(c * y) AS cy, avg(s * y) AS sy, avg(y * y) AS yy FROM xp GROUP BY ALL),
sp AS (SELECT {keys}, period, (b * cy + g * sy) / yy AS power, sqrt(b ** 2 + g ** 2) AS amplitude, atan2(g, b) AS phase FROM (SELECT *, (cy * ss - sy * cs) / (cc * ss - cs ** 2) AS b, (sy * cc - cy * cs) / (cc * ss - cs ** 2) AS g FROM mm WHERE cc * ss - cs ** 2 > 1e-9 AND yy > 1e-12)),
pk AS (SELECT {keys}, {_top("period")}, {_top("power")}, {_top("amplitude")}, {_top("phase")} FROM sp GROUP BY ALL)
"""


# The test series have some 20 days in 90, so 15 days of a window are enough here.
slid = lambda s, d: rhythms.sliding_spectrum(vw.daily_values(s, d), min_days=15)
SLIDE = D + """, en AS (SELECT user_id, min(day) AS a, max(day) AS z FROM daily_values GROUP BY 1), ws AS (SELECT user_id, unnest(range(a, z - 89, 15)) AS start_day FROM en),
wr AS (SELECT user_id, start_day, day, value FROM (SELECT ws.user_id, start_day, day, value, count(*) OVER (PARTITION BY ws.user_id, start_day) AS n FROM ws JOIN daily_values v ON v.user_id = ws.user_id AND v.day >= start_day AND v.day < start_day + 90) WHERE n >= 15)
""" + spectra_sql("wr", "user_id, start_day")
add("sliding_spectrum", lambda s, d: slid(s, d).select("user_id", "start_day", "period", "power", "amplitude"), "SELECT user_id, start_day, period, power, amplitude FROM pk", SLIDE, "power amplitude")
add("period_drift", lambda s, d: rhythms.period_drift(slid(s, d)), "SELECT user_id, count(*) AS windows, quantile_cont(period, 0.75) - quantile_cont(period, 0.25) AS drift, avg((period BETWEEN 25 AND 35)::INT) AS share_in_band FROM pk GROUP BY 1", SLIDE, "drift share_in_band")
PHI = "[" + ", ".join(map(str, rhythms.PHIS)) + "]::DOUBLE[]"
AR = DET + f""", lg AS (SELECT user_id, residual AS y, coalesce(lag(residual) OVER w, 0) AS p, day - lag(day) OVER w AS gap FROM dt WINDOW w AS (PARTITION BY user_id ORDER BY day)), ph AS (SELECT user_id, phi, y, p, CASE WHEN gap IS NULL THEN 0 ELSE phi ** gap END AS a FROM lg, (SELECT unnest({PHI}) AS phi)),
lk AS (SELECT user_id, phi, count(*) AS days, greatest(sum((y - a * p) ** 2 / greatest(1 - a * a, 1e-12)) / count(*), 1e-12) AS variance, sum(ln(greatest(1 - a * a, 1e-12))) AS d FROM ph GROUP BY ALL HAVING count(*) >= 3)
"""
add("ar1_profile", lambda s, d: rhythms.ar1(rhythms.detrend(vw.daily_values(s, d))), "SELECT user_id, max(days) AS days, arg_min(phi, (round(days * ln(variance) + d, 6), phi)) AS phi, arg_min(variance, (round(days * ln(variance) + d, 6), phi)) AS variance FROM lk GROUP BY 1", AR, "phi variance")

KEYS = ("user_id", "window_index")
inside = lambda s, d: cohorts.window_range_join(vw.daily_values(s, d), wins(s, d)).select(*KEYS, "day", "value")
windowed = lambda s, d: rhythms.detrend(inside(s, d), KEYS)
peaks = lambda s, d: rhythms.series_peaks(inside(s, d), keys=KEYS)
carried = lambda s, d: inf.forecast_correlation(peaks(s, d), windowed(s, d))
PER = DW + ", sr AS (SELECT user_id, window_index, day, value FROM daily_values JOIN win USING (user_id) WHERE day BETWEEN start_day AND end_day)\n" + spectra_sql("sr", "user_id, window_index") + """, fo AS (SELECT user_id, count(*) AS days, corr(y, g) AS forecast_r, 1 - sum((y - g) ** 2) / nullif(count(*) * var_pop(y), 0) AS forecast_r2 FROM (SELECT rs.user_id, y, amplitude * cos(2 * pi() * day / period - phase) AS g FROM rs JOIN pk ON pk.user_id = rs.user_id AND pk.window_index = 1 WHERE rs.window_index = 2) GROUP BY 1),
jo AS (SELECT a.user_id, a.period AS p1, b.period AS p2, row_number() OVER (ORDER BY sha256('perm|' || a.user_id), a.user_id) AS r, count(*) OVER () AS n FROM pk a JOIN pk b ON b.user_id = a.user_id AND a.window_index = 1 AND b.window_index = 2)
"""
add("forecast_correlation", carried, "SELECT * FROM fo", PER, "forecast_r forecast_r2")
add("pearson_pairs", lambda s, d: wmeans(s, d).groupBy("user_id").agg(F.max(F.when(F.col("window_index") == 1, F.col("mean"))).alias("a"), F.max(F.when(F.col("window_index") == 2, F.col("mean"))).alias("b")).agg(F.count("b").alias("pairs"), F.corr("a", "b").alias("r")), "SELECT count(b) AS pairs, corr(a, b) AS r FROM (SELECT user_id, max(mean) FILTER (window_index = 1) AS a, max(mean) FILTER (window_index = 2) AS b FROM wm GROUP BY 1)", WM, "r")
add("period_persistence", lambda s, d: inf.period_persistence(peaks(s, d), carried(s, d)), "SELECT users, share, share_permuted, (SELECT avg(forecast_r2) FROM fo) AS mean_r2, (SELECT avg(forecast_r) FROM fo) AS mean_r FROM (SELECT count(*) AS users, avg((abs(x.p1 - x.p2) <= 1.5)::INT) AS share, avg((abs(x.p1 - o.p2) <= 1.5)::INT) AS share_permuted FROM jo x JOIN jo o ON o.r = x.r % x.n + 1)", PER, "share share_permuted mean_r2 mean_r")
