"""Registered queries of participants' features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell.operators import blocks, epochs as ep, features as ft, gaps, splits
from tidewell.plans import views as vw
from tidewell.plans.queries import CH, COV, DW, E, EX, GRID, D, add, days, events, good_days, grid, wins

BUCKET = "CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END"

CS = COV + """, cs AS (SELECT *, last_date - first_date + 1 AS span_days, events / observed_days AS events_per_day, p75_of_daily_median - p25_of_daily_median AS iqr_of_daily_median, max_of_daily_max - min_of_daily_min AS range_of_daily_extremes, weekend_mean - weekday_mean AS weekend_minus_weekday
FROM (SELECT user_id, channel, count(*) AS observed_days, count(*) FILTER (adequate) AS adequate_days, sum(n)::BIGINT AS events, min(day) AS first_date, max(day) AS last_date, avg(cov_s) / 3600 AS mean_cov_h, avg(hours) AS mean_hours,
 avg(mean) FILTER (adequate) AS mean_of_daily_mean, stddev_samp(mean) FILTER (adequate) AS sd_of_daily_mean, avg(sd) FILTER (adequate) AS mean_of_daily_sd, median(median) FILTER (adequate) AS median_of_daily_median, quantile_cont(median, 0.25) FILTER (adequate) AS p25_of_daily_median, quantile_cont(median, 0.75) FILTER (adequate) AS p75_of_daily_median,
 min(vmin) FILTER (adequate) AS min_of_daily_min, max(vmax) FILTER (adequate) AS max_of_daily_max, avg(mean) FILTER (adequate AND (day + 3) % 7 < 5) AS weekday_mean, avg(mean) FILTER (adequate AND (day + 3) % 7 >= 5) AS weekend_mean FROM days GROUP BY ALL))
"""
CS_DOUBLES = "mean_cov_h mean_hours mean_of_daily_mean sd_of_daily_mean mean_of_daily_sd median_of_daily_median p25_of_daily_median p75_of_daily_median min_of_daily_min max_of_daily_max weekday_mean weekend_mean events_per_day iqr_of_daily_median range_of_daily_extremes weekend_minus_weekday"
summary = lambda s, d: ft.channel_summary(days(s, d))
wide = lambda s, d: ft.widen_channels(summary(s, d), CH, ["events", "mean_of_daily_mean"])
WIDE = CS + ", wd AS (SELECT user_id, " + ", ".join(f"max({x}) FILTER (channel = {c}) AS ch{c}_{x}" for c in CH for x in ("events", "mean_of_daily_mean")) + " FROM cs GROUP BY 1)\n"
add("channel_summary", summary, "SELECT * FROM cs", CS, CS_DOUBLES)
add("overall_summary", lambda s, d: ft.overall_summary(days(s, d)), "SELECT user_id, sum(n)::BIGINT AS events, count(DISTINCT day) AS days, count(*) FILTER (adequate) AS adequate_days, min(day) AS first_date, max(day) AS last_date, max(day) - min(day) + 1 AS span_days FROM days GROUP BY 1", COV)
add("widen_channels", wide, "SELECT * FROM wd", WIDE, " ".join(f"ch{c}_mean_of_daily_mean" for c in CH))
add("channel_contrasts", lambda s, d: ft.channel_contrasts(wide(s, d), "mean_of_daily_mean", 3000, (3001, 3002)), "SELECT user_id, ch3000_mean_of_daily_mean - ch3001_mean_of_daily_mean AS ch3000_minus_ch3001, ch3000_mean_of_daily_mean - ch3002_mean_of_daily_mean AS ch3000_minus_ch3002 FROM wd", WIDE, "ch3000_minus_ch3001 ch3000_minus_ch3002")
add("feature_formulas", lambda s, d: ft.feature_formulas(summary(s, d).select("user_id", "channel", "adequate_days", "observed_days", "mean_hours"), [("mean_hours", "observed_days")], [("observed_days", "adequate_days")], [("observed_days", "adequate_days")]), "SELECT user_id, channel, adequate_days, observed_days, mean_hours, mean_hours * observed_days AS mean_hours_x_observed_days, CASE WHEN adequate_days > 0 THEN observed_days / adequate_days END AS observed_days_per_adequate_days, observed_days - adequate_days AS observed_days_minus_adequate_days FROM cs", CS, "mean_hours mean_hours_x_observed_days observed_days_per_adequate_days")
_tod = [(c, b) for c in CH for b in ft.BUCKETS]
add("tod_profile", lambda s, d: ft.tod_profile(ep.hour_stats(events(s, d)), ep.user_meta(vw.epochs(s, d), CH, EX).where("tz_missing_events <= 1 AND valid_events > 0"), CH), "SELECT user_id, " + ", ".join(f"CASE WHEN max(missing) <= 1 THEN avg(value) FILTER (channel = {c} AND bucket = '{b}') END AS ch{c}_tod_{b}" for c, b in _tod) + f" FROM (SELECT *, {BUCKET} AS bucket FROM e) JOIN (SELECT user_id, count(*) FILTER (tz_min IS NULL) AS missing FROM epochs GROUP BY 1) USING (user_id) GROUP BY 1", E, " ".join(f"ch{c}_tod_{b}" for c, b in _tod))
_rp = [f"ch{c}_{x}" for c in CH for x in ("duty", "events_day", *[f"share_{b}" for b in ft.BUCKETS])]
add("recording_process", lambda s, d: ft.recording_process(days(s, d), ep.hour_stats(events(s, d)), CH), "SELECT user_id, any_duty, " + ", ".join(f"max(duty) FILTER (channel = {c}) AS ch{c}_duty, max(events_day) FILTER (channel = {c}) AS ch{c}_events_day, max(hours_seen) FILTER (channel = {c}) AS ch{c}_hours_seen, (count(*) FILTER (channel = {c}) > 0)::BIGINT AS ch{c}_present, " + ", ".join(f"max(share_{b}) FILTER (channel = {c}) AS ch{c}_share_{b}" for b in ft.BUCKETS) for c in CH) + " FROM rp JOIN (SELECT user_id, count(DISTINCT day) / (max(day) - min(day) + 1) AS any_duty FROM e GROUP BY 1) USING (user_id) GROUP BY ALL", E + ", rp AS (SELECT user_id, channel, count(DISTINCT day) / (max(day) - min(day) + 1) AS duty, count(*) / count(DISTINCT day) AS events_day, count(DISTINCT hour) AS hours_seen, " + ", ".join(f"count(*) FILTER ({BUCKET} = '{b}') / count(*) AS share_{b}" for b in ft.BUCKETS) + " FROM e GROUP BY ALL)\n", "any_duty " + " ".join(_rp))
_sp = "mean sd lo hi day_mean day_mean_sd day_count day_count_sd " + " ".join(f"share_{b}" for b in ft.BUCKETS)
add("source_profile", lambda s, d: ft.source_profile(events(s, d)), "SELECT user_id, source, channel, all_channels, sum(n)::BIGINT AS n, sum(s) / sum(n) AS mean, max(sd) AS sd, min(lo) AS lo, max(hi) AS hi, count(*) AS days, max(day) - min(day) + 1 AS span, avg(s / n) AS day_mean, stddev_samp(s / n) AS day_mean_sd, avg(n) AS day_count, stddev_samp(n) AS day_count_sd, " + ", ".join(f"sum({b}) / sum(n) AS share_{b}" for b in ft.BUCKETS) + " FROM dd JOIN sd USING (user_id, source, k) GROUP BY ALL", E + ", dd AS (SELECT user_id, source, channel, grouping(channel)::BIGINT AS all_channels, coalesce(channel, 0) AS k, day, count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi, " + ", ".join(f"count(*) FILTER ({BUCKET} = '{b}') AS {b}" for b in ft.BUCKETS) + " FROM e GROUP BY GROUPING SETS ((user_id, source, channel, day), (user_id, source, day))), sd AS (SELECT user_id, source, coalesce(channel, 0) AS k, stddev_samp(value) AS sd FROM e GROUP BY GROUPING SETS ((user_id, source, channel), (user_id, source)))\n", _sp)
_dt = " ".join([*[f"ch{c}_mean" for c in CH], "gap_3001", "gap_3002"])
add("day_table", lambda s, d: ft.day_wide(days(s, d), 3000, (3001, 3002), vw.demographics(s, d)), "SELECT w.*, ch3000_mean - ch3001_mean AS gap_3001, ch3000_mean - ch3002_mean AS gap_3002, year(DATE '1970-01-01' + day::INT) - birth_year AS age FROM (SELECT user_id, day, " + ", ".join(f"max({x}) FILTER (channel = {c}) AS ch{c}_{x}" for c in CH for x in ("mean", "n")) + " FROM days GROUP BY ALL HAVING coalesce(bool_or(adequate) FILTER (channel = 3000), false)) w LEFT JOIN demographics USING (user_id)", COV + f", {vw.DEMOGRAPHICS_SQL}\n", _dt)
_st = blocks.DAY_STATS
_bins = [f"bin_{b}" for b in range(blocks.BINS)]
BLOCK = COV + """, bd AS (SELECT user_id, (local_ms % 86400000) // 300000 AS bin, count(DISTINCT day) AS n FROM e WHERE channel = 3000 GROUP BY ALL),
dd AS (SELECT *, cov_s / 3600 AS cov_h FROM days WHERE channel = 3000)
"""
add("static_block", lambda s, d: blocks.day_block(good_days(s, d), events(s, d).where("channel = 3000")), "SELECT a.*, " + ", ".join(f"coalesce(bin_{b}, 0) / days AS bin_{b}" for b in range(blocks.BINS)) + " FROM (SELECT user_id, " + ", ".join([*[f"avg({x}) AS {x}_mean" for x in _st], *[f"stddev_samp({x}) AS {x}_sd" for x in _st]]) + ", avg(mean) FILTER ((day + 3) % 7 >= 5) - avg(mean) FILTER ((day + 3) % 7 < 5) AS weekend_contrast FROM dd GROUP BY 1) a JOIN (SELECT user_id, count(DISTINCT day) AS days FROM dd GROUP BY 1) USING (user_id) LEFT JOIN (SELECT user_id, " + ", ".join(f"max(n) FILTER (bin = {b}) AS bin_{b}" for b in range(blocks.BINS)) + " FROM bd GROUP BY 1) USING (user_id)", BLOCK, " ".join([*[f"{x}_{y}" for x in _st for y in ("mean", "sd")], "weekend_contrast", *_bins]))
_prof = lambda n, p: (", ".join(f"avg(hr) FILTER (bin = {b}) AS {p}{b}_mean, stddev_samp(hr) FILTER (bin = {b}) AS {p}{b}_sd" for b in range(n)), " ".join(f"{p}{b}_{y}" for b in range(n) for y in ("mean", "sd")))
add("bin_profile", lambda s, d: ft.bin_profile(grid(s, d), 8), f"SELECT user_id, {_prof(8, 'bin')[0]} FROM g GROUP BY 1", GRID, _prof(8, "bin")[1])
hourly = lambda s, d: events(s, d).groupBy("user_id", "day", F.col("hour").alias("bin")).agg(F.avg("value").alias("hr"))
HR = E + ", hh AS (SELECT user_id, day, hour AS bin, avg(value) AS hr FROM e GROUP BY ALL)\n"
add("hour_profile", lambda s, d: ft.bin_profile(hourly(s, d), 24, "hour"), f"SELECT user_id, {_prof(24, 'hour')[0]} FROM hh GROUP BY 1", HR, _prof(24, "hour")[1])
add("recording_descriptors", lambda s, d: ft.recording_descriptors(grid(s, d)), "SELECT user_id, max(day) - min(day) + 1 AS span, count(*) AS days, coalesce(max(gap), 0) AS longest_gap, avg(o) AS occupancy, stddev_samp(o) AS occupancy_sd, count(*) / (max(day) - min(day) + 1) AS density FROM (SELECT *, day - lag(day) OVER (PARTITION BY user_id ORDER BY day) - 1 AS gap FROM (SELECT user_id, day, avg((hr IS NOT NULL)::INT) AS o FROM g GROUP BY ALL)) GROUP BY 1", GRID, "occupancy occupancy_sd density")
add("tercile_groups", lambda s, d: ft.tercile_groups(ft.recording_descriptors(grid(s, d)), ft.recording_descriptors(grid(s, d)).where("user_id % 2 = 0"), ["span", "days"]), "SELECT user_id, span_group, days_group, span_group || '/' || days_group AS crossed FROM (SELECT user_id, CASE WHEN span <= s1 THEN 'low' WHEN span <= s2 THEN 'middle' ELSE 'high' END AS span_group, CASE WHEN days <= d1 THEN 'low' WHEN days <= d2 THEN 'middle' ELSE 'high' END AS days_group FROM rd, (SELECT quantile_cont(span, 1/3) AS s1, quantile_cont(span, 2/3) AS s2, quantile_cont(days, 1/3) AS d1, quantile_cont(days, 2/3) AS d2 FROM rd WHERE user_id % 2 = 0))", GRID + ", rd AS (SELECT user_id, max(day) - min(day) + 1 AS span, count(DISTINCT day) AS days FROM g GROUP BY 1)\n")
SUBGROUPS = {"history": "span", "occupancy": "occupancy", "continuity": "density", "occupancy_variability": "occupancy_sd"}
described = lambda s, d: ft.recording_descriptors(grid(s, d)).withColumns({c: F.round(F.col(c).cast("double"), 9) for c in SUBGROUPS.values()})
_level = lambda c: f"CASE WHEN {c} <= {c}_1 THEN 'low' WHEN {c} <= {c}_2 THEN 'middle' WHEN {c} IS NOT NULL THEN 'high' END"
_dims = [("overall", "'all'"), *[(n, f"{c}_l") for n, c in SUBGROUPS.items()], *[(f"{a}_x_occupancy", f"{SUBGROUPS[a]}_l || '/' || occupancy_l") for a in ("history", "continuity")]]
SUB = GRID + """, rd AS (SELECT user_id, (max(day) - min(day) + 1)::DOUBLE AS span, round(avg(o), 9) AS occupancy, round(count(*) / (max(day) - min(day) + 1), 9) AS density, round(stddev_samp(o), 9) AS occupancy_sd FROM (SELECT user_id, day, avg((hr IS NOT NULL)::INT) AS o FROM g GROUP BY ALL) GROUP BY 1),
lv AS (SELECT user_id, """ + ", ".join(f"{_level(c)} AS {c}_l" for c in SUBGROUPS.values()) + " FROM rd, (SELECT " + ", ".join(f"quantile_cont({c}, {i}/3) AS {c}_{i}" for c in SUBGROUPS.values() for i in (1, 2)) + """ FROM rd WHERE user_id % 2 = 0))
"""
add("tercile_subgroups", lambda s, d: ft.subgroups(described(s, d), described(s, d).where("user_id % 2 = 0"), SUBGROUPS, (("history", "occupancy"), ("continuity", "occupancy"))), " UNION ALL ".join(f"SELECT user_id, '{n}' AS dimension, {x} AS level FROM lv WHERE {x} IS NOT NULL" for n, x in _dims), SUB)
add("clock_fractions", lambda s, d: ft.clock_fractions(grid(s, d), 8), "SELECT user_id, day, " + ", ".join(f"count(*) FILTER (hr IS NOT NULL AND bin // 2 = {b}) / 2 AS block_{b}" for b in range(4)) + " FROM g GROUP BY ALL", GRID, " ".join(f"block_{b}" for b in range(4)))
add("physiology", lambda s, d: ft.physiology(grid(s, d), 2, (0, 9), (9, 24), 8), "SELECT user_id, day, avg(hr) FILTER (bin < 3) AS night, avg(hr) FILTER (bin >= 3) AS wake, 3.0 * arg_min(bin, (hr, bin)) AS nadir_hour, 3.0 * arg_min(bin, (-hr, bin)) AS peak_hour, CASE WHEN count(*) >= 2 THEN max(hr) - min(hr) END AS amplitude, avg(step) AS step, quantile_cont(hr, 0.1) AS p10, quantile_cont(hr, 0.5) AS p50, quantile_cont(hr, 0.9) AS p90, stddev_pop(hr) AS sd, 1 - avg(hr) FILTER (bin < 3) / nullif(avg(hr) FILTER (bin >= 3), 0) AS dip FROM (SELECT *, CASE WHEN bin - lag(bin) OVER w = 1 THEN abs(hr - lag(hr) OVER w) END AS step FROM b WINDOW w AS (PARTITION BY user_id, day ORDER BY bin)) GROUP BY ALL", GRID, "night wake nadir_hour peak_hour amplitude step p10 p50 p90 sd dip")
add("wear_windows", lambda s, d: ft.wear_windows(grid(s, d), {"night": (0, 2), "waking": (3, 6)}), "SELECT user_id, " + ", ".join(f"avg({k}) AS {k}_mean, stddev_samp({k}) AS {k}_sd, avg({k}) FILTER ((day + 3) % 7 >= 5) - avg({k}) FILTER ((day + 3) % 7 < 5) AS {k}_weekend, avg(({k} >= 0.8)::INT) AS {k}_worn, avg(({k} <= 0.2)::INT) AS {k}_off, avg(({k} > 0.2 AND {k} < 0.8)::INT) AS {k}_partial" for k in ("night", "waking")) + " FROM (SELECT user_id, day, avg((hr IS NOT NULL)::INT) FILTER (bin BETWEEN 0 AND 2) AS night, avg((hr IS NOT NULL)::INT) FILTER (bin BETWEEN 3 AND 6) AS waking FROM g GROUP BY ALL) GROUP BY 1", GRID, " ".join(f"{k}_{x}" for k in ("night", "waking") for x in ("mean", "sd", "weekend", "worn", "off", "partial")))
add("window_geometry", lambda s, d: ft.observation_controls(vw.daily_values(s, d), wins(s, d)), "SELECT user_id, window_index, count(*) AS dates, avg(value) AS mean, stddev_samp(value) AS sd, regr_slope(value, day) AS slope, CASE WHEN count(*) > 2 THEN sqrt(greatest(regr_syy(value, day) - regr_slope(value, day) * regr_sxy(value, day), 0) / (count(*) - 2)) END AS residual_sd, count(*) / 180 AS coverage, max(day) - min(day) + 1 AS span, greatest(max(gap), end_day - max(day)) AS longest_gap FROM (SELECT *, day - coalesce(lag(day) OVER (PARTITION BY user_id, window_index ORDER BY day), start_day - 1) - 1 AS gap FROM daily_values JOIN win USING (user_id) WHERE day BETWEEN start_day AND end_day) GROUP BY user_id, window_index, start_day, end_day", DW, "mean sd slope residual_sd coverage")
VEC = "WITH vv AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(1, len(embedding) + 1)) - 1 AS pos FROM embeddings)\n"
vectors = lambda s, d: vw.table(s, d, "embeddings")
add("pool_vectors", lambda s, d: ft.pool_vectors(vectors(s, d), "label", "embedding"), "SELECT label, pos, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM vv GROUP BY ALL", VEC, "mean sd")
add("pool_vectors_prefix", lambda s, d: ft.pool_vectors(vectors(s, d), "label", "embedding", 10, "vec_id"), "SELECT label, pos, count(v) AS n, avg(v) AS mean, stddev_samp(v) AS sd FROM vv WHERE vec_id IN (SELECT vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) <= 10) GROUP BY ALL", VEC, "mean sd")
day_hours = lambda s, d: ep.hour_stats(events(s, d).where("channel = 3000"), ("user_id", "day", "hour"))
_profile = lambda names: [f"{c}_{x}" for c in names for x in ("mean", "sd")] + [f"{c}_{x}" for c in blocks.CURVE for x in ("wd", "we", "wd_diff")]
add("date_profile_85", lambda s, d: blocks.date_profile(blocks.day_curves(day_hours(s, d))), doubles=" ".join(_profile((*blocks.FITTED, *blocks.CURVE, *blocks.HOURS))))
PROFILE = E + """, hc AS (SELECT user_id, day, hour, count(*) AS n, sum(value) AS vsum, avg(value) AS m FROM e WHERE channel = 3000 GROUP BY ALL),
lo AS (SELECT user_id, day, min(m) AS lo, sum(m) - count(*) * min(m) AS mass FROM hc GROUP BY ALL),
dc AS (SELECT user_id, day, (day + 3) % 7 >= 5 AS we, sum(vsum) FILTER (hour < 6) / sum(n) FILTER (hour < 6) AS night_mean, sum(vsum) FILTER (hour BETWEEN 8 AND 19) / sum(n) FILTER (hour BETWEEN 8 AND 19) - sum(vsum) FILTER (hour < 6) / sum(n) FILTER (hour < 6) AS day_night,
 max(slope) AS morning_slope, max(m) - min(m) AS range, coalesce(-sum(CASE WHEN m > lo AND mass > 1e-12 THEN (m - lo) / mass * ln((m - lo) / mass) END), 0) AS entropy, """ + ", ".join(f"max(m) FILTER (hour = {h}) AS hour_{h}" for h in range(24)) + """
 FROM hc JOIN lo USING (user_id, day) LEFT JOIN (SELECT user_id, day, regr_slope(value, hour) AS slope FROM e WHERE channel = 3000 AND hour BETWEEN 5 AND 9 GROUP BY ALL HAVING count(DISTINCT hour) > 1) USING (user_id, day) GROUP BY user_id, day)
"""
_plain = (*blocks.CURVE, *blocks.HOURS)
add("date_profile_plain", lambda s, d: blocks.date_profile(blocks.day_curves(day_hours(s, d), fits=False)), "SELECT *, " + ", ".join(f"{c}_wd - {c}_we AS {c}_wd_diff" for c in blocks.CURVE) + " FROM (SELECT user_id, " + ", ".join([f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_sd" for c in _plain] + [f"avg({c}) FILTER (NOT we) AS {c}_wd, avg({c}) FILTER (we) AS {c}_we" for c in blocks.CURVE]) + " FROM dc GROUP BY 1)", PROFILE, " ".join(_profile(_plain)))
add("value_profile", lambda s, d: ft.static_block(vw.daily_values(s, d), ("value",)), "SELECT user_id, avg(value) AS value_mean, stddev_samp(value) AS value_sd, avg(value) FILTER ((day + 3) % 7 < 5) - avg(value) FILTER ((day + 3) % 7 >= 5) AS value_weekday FROM daily_values GROUP BY 1", D, "value_mean value_sd value_weekday")
base = lambda s, d: splits.baseline_days(vw.daily_values(s, d), "base")
add("baseline_deviation", lambda s, d: ft.baseline_deviation(vw.daily_values(s, d), base(s, d)).select("user_id", "day", "deviation"), "SELECT user_id, day, value - bl AS deviation FROM daily_values LEFT JOIN (SELECT user_id, avg(value) AS bl FROM (SELECT user_id, value FROM daily_values QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sha256('base|' || user_id || '|' || day)) <= least(60, count(*) OVER (PARTITION BY user_id) // 4)) GROUP BY 1) USING (user_id)", D, "deviation")
add("truncate_calendar", lambda s, d: ft.truncate_calendar(good_days(s, d), 19725, 19727), "SELECT user_id, split, coalesce(count(*) FILTER (kept), 0) AS days, min(day) FILTER (kept) AS first_day, max(day) FILTER (kept) AS last_day, CASE WHEN split IS NULL THEN 'between' WHEN count(*) FILTER (kept) < 2 THEN 'few_days' ELSE 'kept' END AS reason FROM (SELECT *, CASE split WHEN 'train' THEN day < 19725 WHEN 'test' THEN day >= 19727 ELSE false END AS kept FROM (SELECT user_id, day, CASE WHEN f < 19725 THEN 'train' WHEN f >= 19727 THEN 'test' END AS split FROM (SELECT user_id, day, min(day) OVER (PARTITION BY user_id) AS f FROM days WHERE channel = 3000))) GROUP BY user_id, split", COV)
