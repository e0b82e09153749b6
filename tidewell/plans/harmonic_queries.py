"""Registered queries of clock curves and of periods behind nuisance terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import cohorts, epochs as ep, harmonics as hm, nulls, rhythms, spectra as sc
from tidewell.plans import fits_sql as fs, views as vw
from tidewell.plans.queries import D, DW, E, GRID, SPEC, add, events, grid, spec, wins

hours = lambda s, d: ep.hour_stats(events(s, d), ("user_id", "hour"))
series = lambda s, d: cohorts.window_range_join(vw.daily_values(s, d), wins(s, d)).select("user_id", "window_index", "day", "value")
SERIES = DW + ", sr AS (SELECT user_id, window_index, day, value FROM daily_values JOIN win USING (user_id) WHERE day BETWEEN start_day AND end_day), "
UW = "user_id, window_index"
_ns = lambda periods, **k: fs.spectrum("sr", UW, periods, **k)
_wide, _band, _bent, _four = _ns([7.0 + i / 2 for i in range(57)]), _ns([25.0 + i / 2 for i in range(21)]), _ns([28.0, 30.0], degree=3), _ns([7.0, 28.0, 29.530588, 30.4375])
CU = E + """, hc AS (SELECT user_id, hour, count(*) AS n, sum(value) AS vsum, avg(value) AS m FROM e GROUP BY ALL), lo AS (SELECT user_id, min(m) AS lo, sum(m) - count(*) * min(m) AS mass FROM hc GROUP BY 1)
"""
CURVE = "SELECT user_id, count(*) AS hours, sum(vsum) FILTER (hour < 6) / sum(n) FILTER (hour < 6) AS night_mean, sum(vsum) FILTER (hour BETWEEN 8 AND 19) / sum(n) FILTER (hour BETWEEN 8 AND 19) - sum(vsum) FILTER (hour < 6) / sum(n) FILTER (hour < 6) AS day_night, CASE WHEN count(*) FILTER (hour BETWEEN 5 AND 9) >= 2 THEN max(slope) END AS morning_slope, max(m) - min(m) AS range, coalesce(-sum(CASE WHEN m > lo AND mass > 1e-12 THEN (m - lo) / mass * ln((m - lo) / mass) END), 0) AS entropy FROM hc JOIN lo USING (user_id) LEFT JOIN (SELECT user_id, regr_slope(value, hour) AS slope FROM e WHERE hour BETWEEN 5 AND 9 GROUP BY 1) USING (user_id) GROUP BY 1"
add("curve_features", lambda s, d: hm.curve_features(hours(s, d)), CURVE, CU, "night_mean day_night morning_slope range entropy")
_turns = lambda x: [f"{f}(2 * pi() * {k} * {x} / 24)" for k in (1, 2, 3) for f in ("cos", "sin")]
_at = lambda x: " + ".join(["b[1]", *(f"b[{i}] * {w}" for i, w in enumerate(_turns(x), 2))])
CLOCK = CU.rstrip() + ", " + fs.solved("hc", "user_id", ["1.0", *_turns("hour")], "m", "n") + f""", pk AS (SELECT user_id, arg_max(h, (round({_at("h")}, 9), -h)) AS peak_hour FROM lq, (SELECT unnest(range(0, 96)) / 4 AS h) GROUP BY 1),
rs AS (SELECT user_id, sqrt(sum(n * (m - ({_at("hour")})) ** 2) / sum(n)) AS residual_sd FROM hc JOIN lq USING (user_id) GROUP BY 1)
"""
add("circadian_24h", lambda s, d: hm.circadian_24h(hours(s, d)), f"SELECT user_id, b[1] AS level, sqrt(b[2] ** 2 + b[3] ** 2) AS amplitude_1, sqrt(b[4] ** 2 + b[5] ** 2) AS amplitude_2, sqrt(b[6] ** 2 + b[7] ** 2) AS amplitude_3, peak_hour, residual_sd, c.* EXCLUDE (user_id) FROM lq JOIN pk USING (user_id) JOIN rs USING (user_id) JOIN ({CURVE}) c USING (user_id)", CLOCK, "level amplitude_1 amplitude_2 amplitude_3 peak_hour residual_sd night_mean day_night morning_slope range entropy")
add("window_spectrum", lambda s, d: hm.nuisance_spectrum(series(s, d), [7.0 + i / 2 for i in range(57)]), _wide[1], SERIES + _wide[0], "explained amplitude angle")
add("spectrum_plain", lambda s, d: hm.nuisance_spectrum(vw.daily_values(s, d), [28.0, 30.0], ("user_id",), degree=0, weekdays=False).select("user_id", "period", "n", "explained", "amplitude", "angle"), "SELECT user_id, period, n, (b * cy + g * sy) / yy AS explained, sqrt(b ** 2 + g ** 2) AS amplitude, atan2(g, b) AS angle FROM (SELECT *, (cy * ss - sy * cs) / (cc * ss - cs ** 2) AS b, (sy * cc - cy * cs) / (cc * ss - cs ** 2) AS g FROM (SELECT user_id, period, count(*) AS n, covar_pop(c, c) AS cc, covar_pop(s, s) AS ss, covar_pop(c, s) AS cs, covar_pop(c, value) AS cy, covar_pop(s, value) AS sy, covar_pop(value, value) AS yy FROM (SELECT user_id, value, period, cos(2 * pi() * day / period) AS c, sin(2 * pi() * day / period) AS s FROM daily_values, (SELECT unnest([28.0, 30.0]::DOUBLE[]) AS period)) GROUP BY ALL))", D, "explained amplitude angle")
add("band_summary", lambda s, d: hm.band_summary(hm.nuisance_spectrum(series(s, d), [25.0 + i / 2 for i in range(21)]), 25, 35), f"""SELECT user_id, window_index, arg_max(period, (round(explained, 9), -period)) AS peak_period, arg_max(explained, (round(explained, 9), -period)) AS peak_share, arg_max(amplitude, (round(explained, 9), -period)) AS peak_amplitude, sum(area) / nullif(max(period) - min(period), 0) AS band_mean
FROM (SELECT *, (period - lag(period) OVER w) * (explained + lag(explained) OVER w) / 2 AS area FROM ({_band[1]}) WHERE explained IS NOT NULL WINDOW w AS (PARTITION BY user_id, window_index ORDER BY period)) GROUP BY ALL""", SERIES + _band[0], "peak_share peak_amplitude band_mean")
add("seasonal_spectrum", lambda s, d: hm.nuisance_spectrum(series(s, d), [28.0, 30.0], degree=3), _bent[1], SERIES + _bent[0], "explained amplitude angle")

# Each user's first 180 days: tenth percentile of a day, and what of the day and of each quarter was recorded
first_days = lambda s, d: sc.day_signals(grid(s, d)).withColumn("window_index", F.lit(1).cast("long"))
spans = lambda s, d: first_days(s, d).groupBy("user_id", "window_index").agg(F.min("day").alias("start_day")).withColumn("end_day", F.col("start_day") + 179)
quarters = [f"block_{b}" for b in range(4)]
_fit = "explained amplitude angle"
SIGNALS = GRID + ", sg AS (SELECT user_id, 1::BIGINT AS window_index, day, quantile_cont(hr, 0.1) AS p10, avg((hr IS NOT NULL)::INT) AS occupancy, " + ", ".join(f"avg((hr IS NOT NULL)::INT) FILTER (bin * 4 // 8 = {b}) AS block_{b}" for b in range(4)) + " FROM g GROUP BY user_id, day), "
_broad, _narrow = (fs.window_fits("sg", UW, p, ["p10"], quarters) for p in (sc.BROAD, sc.NARROW))
_record = fs.window_fits("(SELECT *, block_0 AS night FROM sg)", UW, sc.NARROW, ["occupancy", "night"])
add("nuisance_spectrum", lambda s, d: sc.window_fits(first_days(s, d), sc.BROAD, responses=["p10"], coverage=quarters).drop("phase"), f"SELECT * EXCLUDE (phase) FROM ({_broad[1]})", SIGNALS + _broad[0], "period " + _fit)
add("narrow_spectrum", lambda s, d: sc.peaks(sc.window_fits(first_days(s, d), sc.NARROW, responses=["p10"], coverage=quarters), 25, 35), fs.peaks(_narrow[1], UW + ", response"), SIGNALS + _narrow[0], "peak_share peak_amplitude band_mean")
add("recording_spectrum", lambda s, d: sc.window_fits(first_days(s, d).withColumn("night", F.col("block_0")), sc.NARROW, responses=["occupancy", "night"]).drop("phase"), f"SELECT * EXCLUDE (phase) FROM ({_record[1]})", SIGNALS + _record[0], _fit)
_level = fs.window_fits("ins", UW, sc.NARROW, ["p10"], quarters, name="lv")
_both = fs.window_fits("(SELECT *, block_0 AS night FROM ins)", UW, sc.NARROW, ["occupancy", "night"], name="bo")
_of = ", ".join(f"max({c}) FILTER (response = '{r}') AS {r}_{o}" for r in ("occupancy", "night") for c, o in (("peak_amplitude", "amplitude"), ("peak_share", "share"), ("peak_period", "period"), ("available", "available"), ("zero_variance", "zero_variance")))
CONTROLS = SIGNALS + f"ins AS (SELECT * FROM sg JOIN (SELECT user_id, min(day) AS start_day FROM sg GROUP BY 1) USING (user_id) WHERE day <= start_day + 179 AND p10 IS NOT NULL), {_level[0]}, {_both[0]}"
_plain = f"""SELECT user_id, window_index, avg(p10) AS p10_mean, stddev_samp(p10) AS p10_sd, regr_slope(p10, day) AS p10_slope, CASE WHEN count(*) > 2 THEN sqrt(greatest(regr_syy(p10, day) - regr_slope(p10, day) * regr_sxy(p10, day), 0) / (count(*) - 2)) END AS p10_residual_sd, {", ".join(f"avg({b}) AS {b}_mean" for b in quarters)}, max(day) - min(day) AS span, greatest(min(day) - any_value(start_day), any_value(start_day) + 179 - max(day), max(gap)) AS longest_gap
FROM (SELECT *, day - lag(day) OVER (PARTITION BY user_id, window_index ORDER BY day) - 1 AS gap FROM ins) GROUP BY user_id, window_index"""
add("q_controls", lambda s, d: sc.recording_controls(first_days(s, d), spans(s, d)), f"SELECT * FROM ({_plain}) JOIN (SELECT user_id, window_index, available AS hr_available, zero_variance AS hr_zero_variance FROM ({fs.peaks(_level[1], UW)})) USING (user_id, window_index) JOIN (SELECT user_id, window_index, {_of} FROM ({fs.peaks(_both[1], UW + ', response')}) GROUP BY ALL) USING (user_id, window_index)", CONTROLS, " ".join(["p10_mean p10_sd p10_slope p10_residual_sd", *[f"{b}_mean" for b in quarters], *[f"{r}_{c}" for r in ("occupancy", "night") for c in ("amplitude", "share", "period")]]))
add("null_endpoints", lambda s, d: nulls.null_endpoints(first_days(s, d), value="p10", coverage=quarters).drop("spectrum", "null_mean", "null_variance"), doubles="v1 phi1 v2 phi2 nll band_excess band_excess_se peak_share peak_amplitude null_peak peak_excess p")
moon_days = lambda s, d: vw.daily_values(s, d).select("day").distinct().select("day", sc.lunar_elongation(F.col("day")).alias("lunar"), sc.lunar_anomaly(F.col("day")).alias("anomalistic"))
moons = lambda s, d: series(s, d).join(F.broadcast(moon_days(s, d)), "day")  # noqa: E731  (a row for each day of the calendar)
SHAM = [18.0, 27.0, 28.0, 29.0, 34.0, 48.0, 55.0, 60.0]
named_angles = lambda s, d: sc.window_fits(moons(s, d), SHAM, phases=["lunar", "anomalistic"])
_poly = lambda c: " + ".join(f"{v!r} * c ** {i}" for i, v in enumerate(c))
_moon = " + ".join(f"{a!r} * sin(radians({i} * d + {j} * m + {k} * l))" for a, (i, j, k) in sc.ELONGATION_TERMS)
_perigee = " + ".join(f"{a!r} * sin(radians({k} * l))" for a, k in sc.ANOMALY_TERMS)
PHASES = f"""SELECT day, (e % 360 + 360) % 360 AS elongation, (a % 360 + 360) % 360 AS anomaly FROM (SELECT day, d + {_moon} AS e, l + {_perigee} AS a
FROM (SELECT day, (({_poly(sc.MEAN_ELONGATION)}) % 360 + 360) % 360 AS d, (({_poly(sc.SOLAR_ANOMALY)}) % 360 + 360) % 360 AS m, (({_poly(sc.LUNAR_ANOMALY)}) % 360 + 360) % 360 AS l FROM (SELECT DISTINCT day, (day + {sc.JD_1970} - {sc.JD_2000})::DOUBLE / {sc.CENTURY} AS c FROM daily_values)))"""
_named = fs.window_fits("mo", UW, SHAM, phases=["lunar", "anomalistic"])
MOONS = SERIES + f"mo AS (SELECT sr.*, elongation AS lunar, anomaly AS anomalistic FROM sr JOIN ({PHASES}) USING (day)), " + _named[0]
TURNS = MOONS + f""", an AS (SELECT *, coalesce(phase, period::VARCHAR) AS term FROM ({_named[1]}) WHERE angle IS NOT NULL),
tu AS (SELECT term, r, count(*) AS n, sqrt(avg(cos(a)) ** 2 + avg(sin(a)) ** 2) AS c FROM (SELECT term, r, angle + CASE WHEN r > 0 THEN 2 * pi() * ('0x' || substr(md5('turn|' || user_id || '|' || window_index || '|' || r), 1, 8))::BIGINT / 2 ** 32 ELSE 0 END AS a FROM an, (SELECT unnest(range(0, 33)) AS r)) GROUP BY ALL)
"""
add("fixed_period_angles", lambda s, d: named_angles(s, d).drop("dropped", "response"), f"SELECT * EXCLUDE (dropped, response) FROM ({_named[1]})", MOONS, _fit)
add("phase_lock", lambda s, d: sc.rotation_null(named_angles(s, d).withColumn("term", F.coalesce("phase", F.col("period").cast("string"))), ["term"], ["user_id", "window_index"]), "SELECT term, max(n) AS n, max(c) FILTER (r = 0) AS coherence, avg(c) FILTER (r > 0) AS null_mean, max(c) FILTER (r > 0) AS null_max, (1 + count(*) FILTER (r > 0 AND c >= c0)) / 33 AS p FROM tu JOIN (SELECT term, c AS c0 FROM tu WHERE r = 0) USING (term) GROUP BY 1", TURNS, "coherence null_mean null_max p")
add("lunar_phases", lambda s, d: vw.daily_values(s, d).select("day").distinct().select("day", sc.lunar_elongation(F.col("day")).alias("elongation"), sc.lunar_anomaly(F.col("day")).alias("anomaly")), PHASES, D, "elongation anomaly")
occupied = lambda s, d: grid(s, d).groupBy("user_id", "day").agg(F.avg(F.col("hr").isNotNull().cast("double")).alias("value"))
_occ = fs.spectrum("oc", "user_id", [5.0, 7.0, 10.0, 14.0], weekdays=False)
add("occupancy_spectrum", lambda s, d: hm.nuisance_spectrum(occupied(s, d), [5.0, 7.0, 10.0, 14.0], ("user_id",), weekdays=False), _occ[1], GRID + ", oc AS (SELECT user_id, day, avg((hr IS NOT NULL)::INT) AS value FROM g GROUP BY ALL), " + _occ[0], "explained amplitude angle")
add("period_coherence", lambda s, d: hm.nuisance_spectrum(series(s, d), [7.0, 28.0, 29.530588, 30.4375]).groupBy("window_index", "period").agg(F.count("angle").alias("n"), F.hypot(F.avg(F.cos("angle")), F.avg(F.sin("angle"))).alias("coherence"), F.avg("explained").alias("explained")), f"SELECT window_index, period, count(angle) AS n, sqrt(avg(cos(angle)) ** 2 + avg(sin(angle)) ** 2) AS coherence, avg(explained) AS explained FROM ({_four[1]}) GROUP BY ALL", SERIES + _four[0], "coherence explained")
_pr = lambda s, d: hm.partial_r2(series(s, d), 28.0)
add("partial_r2", lambda s, d: _pr(s, d).select("user_id", "window_index", "n", "r2_trend"), "SELECT user_id, window_index, count(*) AS n, regr_r2(value, day) AS r2_trend FROM daily_values JOIN win USING (user_id) WHERE day BETWEEN start_day AND end_day GROUP BY ALL", DW, "r2_trend")
_nested = fs.behind("(SELECT *, day - avg(day) OVER (PARTITION BY user_id, window_index) AS own FROM sr)", UW, ["1.0::DOUBLE", "own", *fs.WEEKDAYS, "cos(2 * pi() * day / 28)", "sin(2 * pi() * day / 28)"], marks=(1, 2, 8, 10))
add("partial_r2_blocks", _pr, f"SELECT {UW}, count(*) AS n, {', '.join(f'CASE WHEN max(rss_1) > 1e-12 THEN (max(rss_{a}) - max(rss_{b})) / max(rss_1) END AS {c}' for a, b, c in ((1, 2, 'r2_trend'), (2, 8, 'r2_weekdays'), (8, 10, 'r2_period')))} FROM gs GROUP BY ALL", SERIES + _nested, "r2_trend r2_weekdays r2_period")
halves = lambda s, d, w: rhythms.detrend(series(s, d).where(F.col("window_index") == w))
FF = DW + """, sr AS (SELECT user_id, window_index, day, value FROM daily_values JOIN win USING (user_id) WHERE day BETWEEN start_day AND end_day), ft AS (SELECT user_id, window_index, regr_slope(value, day) AS b, avg(value) AS m, avg(day) AS t FROM sr GROUP BY ALL),
rs AS (SELECT user_id, window_index, day, value - m - b * (day - t) AS y, cos(2 * pi() * day / 28) AS c, sin(2 * pi() * day / 28) AS s FROM sr JOIN ft USING (user_id, window_index)), cv AS (SELECT user_id, avg(c * c) AS cc, avg(s * s) AS ss, avg(c * s) AS cs, avg(c * y) AS cy, avg(s * y) AS sy FROM rs WHERE window_index = 1 GROUP BY 1)
"""
add("frozen_forecast", lambda s, d: hm.frozen_forecast(rhythms.spectrum(halves(s, d, 1), [28.0]), halves(s, d, 2), 28.0), "SELECT user_id, count(*) AS n, corr((cy * ss - sy * cs) / (cc * ss - cs ** 2) * c + (sy * cc - cy * cs) / (cc * ss - cs ** 2) * s, y) AS r FROM rs JOIN cv USING (user_id) WHERE window_index = 2 GROUP BY 1", FF, "r")
add("calendar_phase", lambda s, d: hm.calendar_phase(spec(s, d)).select("user_id", "period", "peak_day"), "SELECT user_id, period, CASE WHEN phase < 0 THEN phase / (2 * pi()) * period + period ELSE phase / (2 * pi()) * period END AS peak_day FROM sp", SPEC, "peak_day")
covered = lambda s, d: events(s, d).groupBy("user_id").agg(F.avg("value").alias("level"), F.log(F.count("*").cast("double")).alias("log_n"))
add("coverage_residuals", lambda s, d: hm.coverage_residuals(covered(s, d), covered(s, d).where("user_id % 2 = 0"), ["level"], ["log_n"]), "SELECT user_id, level, log_n, level - a - b * log_n AS level_residual FROM cr, (SELECT regr_slope(level, log_n) AS b, regr_intercept(level, log_n) AS a FROM cr WHERE user_id % 2 = 0)", E + ", cr AS (SELECT user_id, avg(value) AS level, ln(count(*)) AS log_n FROM e GROUP BY 1)\n", "level log_n level_residual")
