"""Registered queries: operators on the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators import cohorts, epochs as ep, evaluation as ev, gaps, rhythms, splits, windows as wd
from tidewell.plans import views as vw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

CH, EX = vw.CHANNELS, vw.EXCLUDED_SOURCES
E = f"""WITH {vw.EPOCHS_SQL},
v AS (SELECT *, start_ms + coalesce(tz_min, 0)::BIGINT * 60000 AS local_ms FROM epochs WHERE source IS NOT NULL AND source NOT IN (38) AND channel IN (3000, 3001, 3002) AND value BETWEEN 25 AND 230 AND start_ms > 0),
e AS (SELECT *, local_ms // 86400000 AS day, (local_ms % 86400000) // 3600000 AS hour FROM v)
"""
#: Coverage of (user, channel, day) by gaps and islands.
COV = E + """, m AS (SELECT *, max(end_ms) OVER w AS before FROM e WINDOW w AS (PARTITION BY user_id, channel, day ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR start_ms > before THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, channel, day ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM m),
cov AS (SELECT user_id, channel, day, sum(ms) / 1000 AS cov_s FROM (SELECT user_id, channel, day, island, max(end_ms) - min(start_ms) AS ms FROM i GROUP BY ALL) GROUP BY ALL),
st AS (SELECT user_id, channel, day, count(*) AS n, avg(value) AS mean, median(value) AS median, coalesce(stddev_samp(value), 0) AS sd, min(value) AS vmin, max(value) AS vmax, count(DISTINCT hour) AS hours FROM e GROUP BY ALL),
days AS (SELECT *, hours >= 2 AND (cov_s >= 7200 OR n >= 3) AS adequate FROM st JOIN cov USING (user_id, channel, day))
"""
GRID = E + """, b AS (SELECT user_id, day, (local_ms % 86400000) // 10800000 AS bin, avg(value) AS hr FROM e GROUP BY ALL),
g AS (SELECT user_id, day, bin, hr FROM (SELECT user_id, day, unnest(range(0, 8)) AS bin FROM (SELECT DISTINCT user_id, day FROM b)) LEFT JOIN b USING (user_id, day, bin))
"""
D = f"WITH {vw.DAILY_SQL}\n"
DW = D + """, c AS (SELECT user_id, day, count(*) OVER w0 AS n0, count(*) OVER w1 AS n1, count(*) OVER w2 AS n2, count(*) OVER w3 AS n3, count(*) OVER w4 AS n4, count(*) OVER w5 AS n5 FROM daily_values
  WINDOW w0 AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 0 FOLLOWING AND 29 FOLLOWING), w1 AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 30 FOLLOWING AND 59 FOLLOWING), w2 AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 60 FOLLOWING AND 89 FOLLOWING),
  w3 AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 90 FOLLOWING AND 119 FOLLOWING), w4 AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 120 FOLLOWING AND 149 FOLLOWING), w5 AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 150 FOLLOWING AND 179 FOLLOWING)),
f AS (SELECT user_id, day AS start_day, n0 + n1 + n2 + n3 + n4 + n5 AS num_dates FROM c WHERE least(n0, n1, n2, n3, n4, n5) >= 3 AND n0 + n1 + n2 + n3 + n4 + n5 >= 24),
w1 AS (SELECT user_id, min(start_day) AS start_day FROM f GROUP BY 1),
w2 AS (SELECT f.user_id, min(f.start_day) AS start_day FROM f JOIN w1 ON w1.user_id = f.user_id AND f.start_day >= w1.start_day + 180 GROUP BY 1),
win AS (SELECT f.user_id, 1::BIGINT AS window_index, f.start_day, f.num_dates, f.start_day + 179 AS end_day FROM f JOIN w1 USING (user_id, start_day) UNION ALL SELECT f.user_id, 2::BIGINT, f.start_day, f.num_dates, f.start_day + 179 FROM f JOIN w2 USING (user_id, start_day)),
cap AS (SELECT user_id, (day - start_day) // 30 AS block, count(DISTINCT day) AS capacity FROM daily_values JOIN win USING (user_id) WHERE window_index = 1 AND day BETWEEN start_day AND end_day GROUP BY ALL),
un AS (SELECT user_id, block, capacity, unit, row_number() OVER (PARTITION BY user_id ORDER BY unit NULLS LAST, block) AS r, FROM (SELECT user_id, block, capacity, unnest(CASE WHEN capacity > 3 THEN range(4, capacity + 1) ELSE [NULL] END) AS unit FROM cap)),
quo AS (SELECT user_id, block, capacity, least(3, capacity) + count(*) FILTER (unit IS NOT NULL AND r <= 24 - 3 * 6) AS quota FROM un GROUP BY user_id, block, capacity),
sel AS (SELECT user_id, block, day FROM (SELECT user_id, (day - start_day) // 30 AS block, day, row_number() OVER (PARTITION BY user_id, (day - start_day) // 30 ORDER BY sha256('dates|' || user_id || '|' || day)) AS r FROM daily_values JOIN win USING (user_id) WHERE window_index = 1 AND day BETWEEN start_day AND end_day) JOIN quo USING (user_id, block) WHERE r <= quota)
"""
P = f"WITH {vw.PREDICTIONS_SQL},\nt AS (SELECT arm, score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM predictions GROUP BY ALL)\n"
DM = f"WITH {vw.DEMOGRAPHICS_SQL}\n"


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str = "", base: str = "", doubles: str = "") -> None:
    """Registers a query; `doubles` names the columns rounded on both sides."""
    cols = doubles.split()

    def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.withColumns({c: fn.r6(F.col(c).cast("double")) for c in cols}) if cols else df

    QUERIES[name] = rounded
    if sql:
        ORACLE_SQL[name] = base + ("SELECT * REPLACE (" + ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in cols) + f") FROM ({sql})" if cols else sql)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ep.local_clock(ep.valid_events(vw.epochs(spark, sf_dir), CH, EX))


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohorts.adequate(ep.day_table(events(spark, sf_dir)), 2, 7200, 3)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = events(spark, sf_dir).withColumn("bin", fn.bin_of(F.col("local_ms"), 180)).groupBy("user_id", "day", "bin").agg(F.avg("value").alias("hr"))
    return gaps.full_grid(b, 8)


def wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wd.window_180(vw.daily_values(spark, sf_dir), 3, 24)


def good_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return days(spark, sf_dir).where("channel = 3000")


# Events
add("valid_events", lambda s, d: ep.valid_events(vw.epochs(s, d), CH, EX), "SELECT * EXCLUDE (local_ms) FROM v", E)
add("valid_events_strict", lambda s, d: ep.rejection_counts(vw.epochs(s, d), CH, EX), "SELECT count(*) AS n_rows, count(*) FILTER (tz_min IS NULL) AS no_offset, count(*) FILTER (source IS NULL OR source IN (38)) AS bad_source, count(*) FILTER (channel NOT IN (3000, 3001, 3002)) AS bad_channel, count(*) FILTER (coalesce(NOT value BETWEEN 25 AND 230, true)) AS bad_value, (SELECT count(*) FROM v WHERE tz_min IS NOT NULL) AS kept FROM epochs", E)
add("repair_end", lambda s, d: ep.repair_end(vw.epochs(s, d).withColumn("end_ms", F.when(F.col("event_id") % 7 != 0, F.col("end_ms")))).select("event_id", "start_ms", "end_ms"), "SELECT event_id, start_ms, CASE WHEN event_id % 7 <> 0 AND end_ms >= start_ms THEN end_ms ELSE start_ms END AS end_ms FROM epochs", E)
add("local_clock", lambda s, d: events(s, d).select("event_id", "local_ms", "day", "hour"), "SELECT event_id, local_ms, day, hour FROM e", E)
add("time_bins", lambda s, d: events(s, d).select("event_id", *[fn.bin_of(F.col("local_ms"), m).alias(f"bin_{m}") for m in (1, 5, 15)]), "SELECT event_id, (local_ms % 86400000) // 60000 AS bin_1, (local_ms % 86400000) // 300000 AS bin_5, (local_ms % 86400000) // 900000 AS bin_15 FROM e", E)
add("calendar_keys", lambda s, d: events(s, d).select("event_id", fn.weekday(F.col("day")).alias("dow"), (fn.weekday(F.col("day")) >= 5).alias("weekend"), fn.week_start(F.col("day")).alias("week")), "SELECT event_id, (day + 3) % 7 AS dow, (day + 3) % 7 >= 5 AS weekend, day - (day + 3) % 7 AS week FROM e", E)
add("tod_bucket", lambda s, d: events(s, d).groupBy(fn.tod_bucket(F.col("hour")).alias("bucket")).agg(F.count("*").alias("n")), "SELECT CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END AS bucket, count(*) AS n FROM e GROUP BY 1", E)
add("day_stats", lambda s, d: ep.day_stats(events(s, d)), "SELECT * FROM st", COV, "mean median sd")
add("union_coverage", lambda s, d: ep.union_coverage(events(s, d)), "SELECT * FROM cov", COV, "cov_s")
add("adequate_days", lambda s, d: days(s, d).select("user_id", "channel", "day", "adequate"), "SELECT user_id, channel, day, adequate FROM days", COV)
add("source_stats", lambda s, d: ep.source_stats(events(s, d)), "SELECT user_id, channel, source, count(*) AS events, count(DISTINCT day) AS days FROM e GROUP BY ALL", E)
add("hour_stats", lambda s, d: ep.hour_stats(events(s, d)), "SELECT user_id, channel, hour, count(*) AS n, sum(value) AS vsum, sum(value * value) AS vsumsq FROM e GROUP BY ALL", E, "vsum vsumsq")
add("user_meta", lambda s, d: ep.user_meta(vw.epochs(s, d), CH, EX), "SELECT x.user_id, min(e.day) AS first_day, max(e.day) AS last_day, count(e.event_id) AS valid_events, count(DISTINCT e.day) AS n_days, count(*) FILTER (x.tz_min IS NULL) AS tz_missing_events, count(*) AS raw_events FROM epochs x LEFT JOIN e ON e.event_id = x.event_id GROUP BY 1", E)
add("bin_means", lambda s, d: ep.bin_means(events(s, d), 180, 2, 3), ", x AS (SELECT user_id, day FROM b GROUP BY ALL HAVING count(*) >= 2), y AS (SELECT user_id FROM x GROUP BY 1 HAVING count(*) >= 3) SELECT user_id, day, bin, round(hr, 6) AS hr FROM b WHERE (user_id, day) IN (SELECT (user_id, day) FROM x) AND user_id IN (SELECT user_id FROM y)", GRID)
QUERIES["bin_means"] = lambda s, d: ep.bin_means(events(s, d), 180, 2, 3).withColumn("hr", fn.r6(F.col("hr")))
add("span_audit", lambda s, d: ep.span_audit(vw.epochs(s, d)), "SELECT source, quantile_cont(end_ms - start_ms, 0.5) AS p50, quantile_cont(end_ms - start_ms, 0.9) AS p90, quantile_cont(end_ms - start_ms, 0.99) AS p99, max(end_ms - start_ms) AS longest, avg((end_ms - start_ms > 300000)::INT) AS over_5min, avg((end_ms - start_ms > 600000)::INT) AS over_10min, count(DISTINCT tz_min) AS offsets FROM epochs GROUP BY 1", E, "p50 p90 p99 over_5min over_10min")
USER_WIN = "(SELECT user_id, min(day) + 3 AS start_day, min(day) + 16 AS end_day FROM e GROUP BY 1)"
user_windows = lambda s, d: events(s, d).groupBy("user_id").agg((F.min("day") + 3).alias("start_day"), (F.min("day") + 16).alias("end_day"))
add("window_diurnal", lambda s, d: ep.window_diurnal(events(s, d), user_windows(s, d)), f"SELECT user_id, channel, level, slot, count(*) AS n, sum(value) AS vsum FROM (SELECT e.*, 'hour' AS level, hour::VARCHAR AS slot FROM e UNION ALL SELECT e.*, 'bucket', CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END FROM e) JOIN {USER_WIN} USING (user_id) WHERE day BETWEEN start_day AND end_day GROUP BY ALL", E, "vsum")
add("perday_hours", lambda s, d: ep.perday_hours(events(s, d), good_days(s, d).where("adequate")), "SELECT user_id, day, hour, count(*) AS n, sum(value) AS vsum FROM e WHERE (user_id, day) IN (SELECT (user_id, day) FROM days WHERE channel = 3000 AND adequate) GROUP BY ALL", COV, "vsum")
add("collapse_duplicates", lambda s, d: ep.collapse_duplicates(vw.daily_rows(s, d)), "SELECT user_id, day, max(value) AS value FROM daily_rows GROUP BY ALL HAVING count(DISTINCT value) <= 1", D)
add("duplicate_counts", lambda s, d: ep.duplicate_counts(vw.daily_rows(s, d)), "SELECT sum(n - v)::BIGINT AS exact_duplicates, count(*) FILTER (v > 1) AS conflicting_keys, count(*) FILTER (v <= 1) AS kept_rows FROM (SELECT count(*) AS n, count(DISTINCT value) AS v FROM daily_rows GROUP BY user_id, day)", D)
add("daily_qc", lambda s, d: ep.daily_qc(vw.daily_rows(s, d)), "SELECT count(*) FILTER (value BETWEEN 25 AND 230) AS kept, count(*) FILTER (NOT value BETWEEN 25 AND 230) AS out_of_range, count(*) FILTER (value IS NULL) AS not_finite FROM daily_rows", D)
add("sql_distinct_cohort", lambda s, d: ep.distinct_cohort(vw.epochs(s, d), vw.demographics(s, d).where("salutation IS NOT NULL"), CH, EX), f", {vw.DEMOGRAPHICS_SQL} SELECT count(DISTINCT user_id) AS n_users FROM v WHERE user_id IN (SELECT user_id FROM demographics WHERE salutation IS NOT NULL)", E)
add("raw_index", lambda s, d: ep.raw_index(vw.epochs(s, d), 3000), "SELECT user_id, source, count(*) AS n FROM epochs WHERE channel = 3000 GROUP BY ALL", E)
add("perturb_shift", lambda s, d: ep.perturb_shift(events(s, d), 6).groupBy("user_id", "hour").agg(F.count("*").alias("n")), "SELECT user_id, ((local_ms + 21600000) % 86400000) // 3600000 AS hour, count(*) AS n FROM e GROUP BY ALL", E)

# Cohorts and profiles
add("coverage_gate", lambda s, d: cohorts.coverage_gate(days(s, d), 3), ", p AS (SELECT user_id, channel, count(*) FILTER (adequate) AS good FROM days GROUP BY ALL) SELECT user_id, arg_max(channel, good * 10000 - channel) AS best_channel, max(good) AS adequate_days, count(*) FILTER (good >= 3) AS channels_adequate, max(good) >= 3 AS passed FROM p GROUP BY 1", COV)
add("coverage_by_channel", lambda s, d: cohorts.coverage_by_channel(days(s, d), 3), "SELECT channel, count(*) AS users, count(*) FILTER (good >= 3) AS users_passing, median(good) AS median_good FROM (SELECT user_id, channel, count(*) FILTER (adequate) AS good FROM days GROUP BY ALL) GROUP BY 1", COV, "median_good")
add("primary_source", lambda s, d: cohorts.primary_source(events(s, d)), "SELECT user_id, arg_max(source, days * 1000 - source) AS primary_source, max(days) AS days FROM (SELECT user_id, source, count(DISTINCT day) AS days FROM e GROUP BY ALL) GROUP BY 1", E)
add("source_set", lambda s, d: cohorts.source_set(events(s, d)), "SELECT user_id, string_agg(source, ',' ORDER BY source) AS sources, count(*) AS n_sources, count(*) > 1 AS multi FROM (SELECT DISTINCT user_id, source FROM e) GROUP BY 1", E)
add("source_indicators", lambda s, d: cohorts.source_indicators(events(s, d), (3, 6, 7, 9)), "SELECT user_id, max((source = 3)::BIGINT) AS src_3, max((source = 6)::BIGINT) AS src_6, max((source = 7)::BIGINT) AS src_7, max((source = 9)::BIGINT) AS src_9 FROM e GROUP BY 1", E)
add("source_inventory", lambda s, d: cohorts.source_inventory(events(s, d)), "SELECT channel, source, count(*) AS users, sum(e)::BIGINT AS events, sum(d)::BIGINT AS days, count(*) FILTER (d >= 5) AS users_5d, count(*) FILTER (d >= 10) AS users_10d, median(d) AS median_days FROM (SELECT channel, source, user_id, count(*) AS e, count(DISTINCT day) AS d FROM e GROUP BY ALL) GROUP BY ALL", E, "median_days")
add("channel_audit", lambda s, d: cohorts.channel_audit(events(s, d)), "SELECT channel, source, count(*) AS events, avg((end_ms = start_ms)::INT) AS zero_share, median((end_ms - start_ms) / 60000) AS median_min, (SELECT median(n) FROM (SELECT count(*) AS n FROM e y WHERE y.channel = x.channel AND y.source = x.source GROUP BY user_id, day)) AS median_events_day, CASE WHEN avg((end_ms = start_ms)::INT) >= 0.9 THEN 'point' WHEN avg((end_ms = start_ms)::INT) <= 0.1 THEN 'interval' ELSE 'mixed' END AS kind FROM e x GROUP BY channel, source", E, "zero_share median_min median_events_day")
add("cohort_flow", lambda s, d: cohorts.cohort_flow(vw.demographics(s, d).join(cohorts.coverage_gate(days(s, d), 3), "user_id", "left"), [("no_label", F.col("salutation").isNull()), ("not_binary", ~F.col("salutation").isin(10, 20)), ("no_events", F.col("passed").isNull()), ("gate", ~F.col("passed"))]), f", {vw.DEMOGRAPHICS_SQL}, p AS (SELECT user_id, max(good) >= 3 AS passed FROM (SELECT user_id, channel, count(*) FILTER (adequate) AS good FROM days GROUP BY ALL) GROUP BY 1), c AS (SELECT CASE WHEN salutation IS NULL THEN 'no_label' WHEN salutation NOT IN (10, 20) THEN 'not_binary' WHEN passed IS NULL THEN 'no_events' WHEN NOT passed THEN 'gate' ELSE 'included' END AS category FROM demographics LEFT JOIN p USING (user_id)) SELECT category, count(*) AS n, (CASE category WHEN 'no_label' THEN 0 WHEN 'not_binary' THEN 1 WHEN 'no_events' THEN 2 WHEN 'gate' THEN 3 ELSE 4 END)::BIGINT AS step FROM c GROUP BY 1", COV)
add("binary_label", lambda s, d: vw.demographics(s, d).select("user_id", fn.binary_label(F.col("salutation")).alias("label"), F.col("salutation").isNull().alias("missing"), F.coalesce(~F.col("salutation").isin(10, 20), F.lit(False)).alias("not_binary")), "SELECT user_id, (CASE salutation WHEN 20 THEN 1 WHEN 10 THEN 0 END)::BIGINT AS label, salutation IS NULL AS missing, coalesce(salutation NOT IN (10, 20), false) AS not_binary FROM demographics", DM)
add("ages", lambda s, d: cohorts.ages(vw.demographics(s, d), 2024), "SELECT user_id, 2024 - birth_year AS age, ((2024 - birth_year) // 5 * 5) || '-' || ((2024 - birth_year) // 5 * 5 + 4) AS band FROM demographics", DM)
add("bmi", lambda s, d: vw.demographics(s, d).select("user_id", fn.bmi(F.col("weight"), F.col("height")).alias("bmi")), "SELECT user_id, weight / (height / 100) ** 2 AS bmi FROM demographics", DM, "bmi")
add("demographics_clean", lambda s, d: cohorts.demographics_clean(vw.demographics(s, d), 2000).select("user_id", "birth_year", "salutation"), "SELECT user_id, birth_year, salutation FROM demographics WHERE birth_year BETWEEN 1900 AND 2000 AND salutation IN (10, 20)", DM)
add("demographics_audit", lambda s, d: cohorts.demographics_audit(vw.demographics(s, d), 2000), "SELECT unnest(['duplicated', 'bad_year', 'not_binary', 'users']) AS item, unnest([0, count(*) FILTER (birth_year NOT BETWEEN 1900 AND 2000), count(*) FILTER (salutation IS NULL OR salutation NOT IN (10, 20)), count(*)]) AS n FROM demographics", DM)
add("crosstab_share", lambda s, d: cohorts.crosstab_share(vw.demographics(s, d), "bmi_grp", "age_group"), "SELECT bmi_grp, age_group, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY bmi_grp) AS share FROM demographics GROUP BY bmi_grp, age_group", DM, "share")
add("exclusion_by_group", lambda s, d: cohorts.exclusion_by_group(vw.demographics(s, d), "bmi_grp", ["salutation", "age_group"]), "SELECT bmi_grp, variable, level, count(*) AS n FROM (SELECT bmi_grp, 'salutation' AS variable, coalesce(salutation::VARCHAR, '<MISSING>') AS level FROM demographics UNION ALL SELECT bmi_grp, 'age_group', age_group::VARCHAR FROM demographics) GROUP BY ALL", DM)
manifest = lambda s, d: cohorts.manifest(vw.demographics(s, d), ep.user_meta(vw.epochs(s, d), CH, EX), cohorts.coverage_gate(days(s, d), 3), cohorts.primary_source(events(s, d)))
MAN = COV + f""", {vw.DEMOGRAPHICS_SQL}, gt AS (SELECT user_id, max(good) >= 3 AS passed FROM (SELECT user_id, channel, count(*) FILTER (adequate) AS good FROM days GROUP BY ALL) GROUP BY 1),
ps AS (SELECT user_id, arg_max(source, days * 1000 - source) AS primary_source FROM (SELECT user_id, source, count(DISTINCT day) AS days FROM e GROUP BY ALL) GROUP BY 1),
mt AS (SELECT x.user_id, count(*) AS raw_events, count(DISTINCT e.day) AS n_days FROM epochs x LEFT JOIN e ON e.event_id = x.event_id GROUP BY 1),
man AS (SELECT user_id, (CASE salutation WHEN 20 THEN 1 WHEN 10 THEN 0 END)::BIGINT AS label, age_group, bmi_grp, raw_events, n_days, coalesce(passed, false) AS passed, primary_source FROM demographics LEFT JOIN mt USING (user_id) LEFT JOIN gt USING (user_id) LEFT JOIN ps USING (user_id))
"""
add("manifest_join", manifest, "SELECT * FROM man", MAN)
add("tier_flags", lambda s, d: cohorts.tier_flags(manifest(s, d), 5), "SELECT user_id, raw_events IS NOT NULL AS tier_seen, passed AND label IS NOT NULL AS tier_strict, coalesce(n_days, 0) >= 5 AS tier_days FROM man", MAN)
add("semi_cohort", lambda s, d: events(s, d).join(vw.demographics(s, d).where("salutation = 20"), "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n")), f", {vw.DEMOGRAPHICS_SQL} SELECT user_id, count(*) AS n FROM e WHERE user_id IN (SELECT user_id FROM demographics WHERE salutation = 20) GROUP BY 1", E)
add("anti_excluded", lambda s, d: vw.epochs(s, d).select("user_id").distinct().join(vw.epochs(s, d).where((F.col("source") == 38) & (F.col("value") > 100)).select("user_id"), "user_id", "left_anti"), "SELECT DISTINCT user_id FROM epochs WHERE user_id NOT IN (SELECT user_id FROM epochs WHERE source = 38 AND value > 100)", E)
add("window_range_join", lambda s, d: cohorts.window_range_join(good_days(s, d), user_windows(s, d)).groupBy("user_id").agg(F.count("*").alias("days"), F.count_if("adequate").alias("adequate")), f"SELECT user_id, count(*) AS days, count(*) FILTER (adequate) AS adequate FROM days JOIN {USER_WIN} USING (user_id) WHERE channel = 3000 AND day BETWEEN start_day AND end_day GROUP BY 1", COV)
add("outer_blocks", lambda s, d: cohorts.outer_blocks(events(s, d).where("channel = 3000").groupBy("user_id").agg(F.count("*").alias("n_events")), vw.daily_values(s, d).groupBy("user_id").agg(F.count("*").alias("n_days")), ["user_id"]), f", {vw.DAILY_SQL} SELECT user_id, n_events, n_days FROM (SELECT user_id, count(*) AS n_events FROM e WHERE channel = 3000 GROUP BY 1) FULL JOIN (SELECT user_id, count(*) AS n_days FROM daily_values GROUP BY 1) USING (user_id)", E)
add("grid_complete", lambda s, d: cohorts.grid_complete(vw.demographics(s, d).select("user_id"), s.createDataFrame([(c,) for c in CH], "channel long"), events(s, d).groupBy("user_id", "channel").agg(F.count("*").alias("n")), "n"), f", {vw.DEMOGRAPHICS_SQL} SELECT user_id, channel, coalesce(n, 0) AS n FROM (SELECT user_id, unnest([3000, 3001, 3002]::BIGINT[]) AS channel FROM demographics) LEFT JOIN (SELECT user_id, channel, count(*) AS n FROM e GROUP BY ALL) USING (user_id, channel)", E)
add("checked_join", lambda s, d: cohorts.checked_join(vw.demographics(s, d).select("user_id", "salutation"), ep.user_meta(vw.epochs(s, d), CH, EX).select("user_id", "raw_events"), ["user_id"]), f", {vw.DEMOGRAPHICS_SQL} SELECT user_id, salutation, raw_events FROM demographics LEFT JOIN (SELECT user_id, count(*) AS raw_events FROM epochs GROUP BY 1) USING (user_id)", E)
add("dim_map", lambda s, d: vw.epochs(s, d).join(F.broadcast(s.createDataFrame([(3, "watch"), (6, "band"), (7, "phone"), (9, "strap")], "source long, device string")), "source", "left").groupBy(F.coalesce("device", F.lit("other")).alias("device")).agg(F.count("*").alias("n")), "SELECT CASE source WHEN 3 THEN 'watch' WHEN 6 THEN 'band' WHEN 7 THEN 'phone' WHEN 9 THEN 'strap' ELSE 'other' END AS device, count(*) AS n FROM epochs GROUP BY 1", E)
add("common_arms", lambda s, d: cohorts.common_arms(vw.predictions(s, d).where("score > 0.2"), 2), "SELECT user_id FROM predictions WHERE score > 0.2 GROUP BY 1 HAVING count(DISTINCT arm) = 2", P)
add("union_distinct_candidates", lambda s, d: events(s, d).select("user_id").unionByName(vw.daily_values(s, d).select("user_id")).distinct(), f", {vw.DAILY_SQL} SELECT user_id FROM e UNION SELECT user_id FROM daily_values", E)
add("intersect_users", lambda s, d: events(s, d).select("user_id").intersect(vw.daily_values(s, d).select("user_id")), f", {vw.DAILY_SQL} SELECT user_id FROM e INTERSECT SELECT user_id FROM daily_values", E)
add("symmetric_difference", lambda s, d: cohorts.symmetric_difference(events(s, d).where("channel = 3000").select("user_id", "day").distinct(), events(s, d).where("channel = 3001").select("user_id", "day").distinct()), "(SELECT DISTINCT user_id, day, 'left' AS side FROM e WHERE channel = 3000 AND (user_id, day) NOT IN (SELECT (user_id, day) FROM e WHERE channel = 3001)) UNION ALL (SELECT DISTINCT user_id, day, 'right' FROM e WHERE channel = 3001 AND (user_id, day) NOT IN (SELECT (user_id, day) FROM e WHERE channel = 3000))", E)
add("head_per_group", lambda s, d: wd.head_per_group(events(s, d).select("source", "user_id", "event_id", "value"), "source", [F.desc("value"), "event_id"], 5), "SELECT source, user_id, event_id, value FROM e QUALIFY row_number() OVER (PARTITION BY source ORDER BY value DESC, event_id) <= 5", E)
add("keep_first", lambda s, d: wd.head_per_group(events(s, d).select("user_id", "event_id", "start_ms"), "user_id", ["start_ms", "event_id"], 1), "SELECT user_id, event_id, start_ms FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start_ms, event_id) = 1", E)

# Windows
ROLL = COV + ", r AS (SELECT user_id, day, avg(CASE WHEN adequate THEN mean END) OVER w AS rolling, count(CASE WHEN adequate THEN mean END) OVER w AS support, adequate FROM days WHERE channel = 3000 WINDOW w AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 6 PRECEDING AND CURRENT ROW)), rr AS (SELECT user_id, day, rolling, support FROM r WHERE adequate AND support >= 2)\n"
roll = lambda s, d: wd.rolling_calendar(good_days(s, d), 7, 2, value="mean")
add("rolling_calendar", roll, "SELECT * FROM rr", ROLL, "rolling")
add("endpoint_slope", lambda s, d: wd.endpoint_slope(roll(s, d)), "SELECT user_id, count(*) AS n, avg(rolling) AS mean, stddev_samp(rolling) AS sd, CASE WHEN count(*) >= 2 THEN regr_slope(rolling, day) END AS slope FROM rr GROUP BY 1", ROLL, "mean sd slope")
add("strict_weeks_gate", lambda s, d: wd.strict_weeks_gate(vw.daily_values(s, d).withColumn("strict", F.col("value") >= 20), 1, 13, 8, 12), ", wk AS (SELECT user_id, day - (day + 3) % 7 AS week, count(*) AS d FROM daily_values WHERE value >= 20 GROUP BY ALL), gr AS (SELECT user_id, unnest(range(a, b + 1, 7)) AS week FROM (SELECT user_id, min(week) AS a, max(week) AS b FROM wk GROUP BY 1)), dn AS (SELECT user_id, week, coalesce(d, 0) AS d FROM gr LEFT JOIN wk USING (user_id, week)), ru AS (SELECT user_id, week, sum((d >= 1)::BIGINT) OVER w AS weeks_ok, sum(d) OVER w AS strict_days FROM dn WINDOW w AS (PARTITION BY user_id ORDER BY week ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)), be AS (SELECT user_id, weeks_ok::BIGINT AS weeks_ok, strict_days::BIGINT AS strict_days, week AS start FROM ru QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY weeks_ok DESC, strict_days DESC, week) = 1) SELECT *, CASE WHEN weeks_ok < 8 THEN 'weeks' WHEN strict_days < 12 THEN 'days' ELSE 'ok' END AS reason FROM be", D)
add("longest_inadequate_run", lambda s, d: wd.longest_inadequate_run(good_days(s, d), 19723, 19752), ", a AS (SELECT user_id, day, day - coalesce(lag(day) OVER (PARTITION BY user_id ORDER BY day), 19722) - 1 AS gap FROM days WHERE channel = 3000 AND adequate AND day BETWEEN 19723 AND 19752) SELECT user_id, greatest(max(gap), 19752 - max(day)) AS longest_gap FROM a GROUP BY 1", COV)
add("window_180", wins, "SELECT * FROM win", DW)
quotas = lambda s, d: wd.block_quotas(wd.block_capacities(vw.daily_values(s, d), wins(s, d)), 24, 3)
add("block_quotas", quotas, "SELECT * FROM quo", DW)
selected = lambda s, d: wd.sample_dates(vw.daily_values(s, d), wins(s, d), quotas(s, d), "dates")
add("sample_dates", selected, "SELECT * FROM sel", DW)
add("selected_dates_hash", lambda s, d: wd.dates_hash(selected(s, d)), "SELECT user_id, count(*) AS n_selected, sha256(string_agg(day, ',' ORDER BY day)) AS selected_dates_hash FROM sel GROUP BY 1", DW)
WM = DW + ", wm AS (SELECT user_id, window_index, start_day, avg(value) AS mean FROM win JOIN daily_values USING (user_id) WHERE day BETWEEN start_day AND end_day GROUP BY ALL)\n"
wmeans = lambda s, d: cohorts.window_range_join(vw.daily_values(s, d), wins(s, d)).groupBy("user_id", "window_index", "start_day").agg(F.avg("value").alias("mean"))
add("pair_windows", lambda s, d: wd.pair_windows(wmeans(s, d)), "SELECT a.user_id, b.start_day - a.start_day AS gap, b.mean - a.mean AS change, (b.mean - a.mean) * 365.25 / (b.start_day - a.start_day) AS per_year FROM wm a JOIN wm b ON b.user_id = a.user_id AND a.window_index = 1 AND b.window_index = 2 AND b.start_day - a.start_day >= 180", WM, "change per_year")
add("first_k", lambda s, d: wd.first_k(vw.daily_values(s, d).select("user_id", "day"), 40), "SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY day) AS rank FROM daily_values QUALIFY rank <= 40", D)
add("random_k", lambda s, d: wd.random_k(vw.daily_values(s, d).select("user_id", "day"), 40, "k"), "SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY sha256('k|' || user_id || '|' || day)) AS rank FROM daily_values QUALIFY rank <= 40", D)
add("prefix_timeline", lambda s, d: wd.prefix_timeline(vw.daily_values(s, d)), "SELECT user_id, day, count(value) OVER w AS n, avg(value) OVER w AS mean, stddev_samp(value) OVER w AS sd FROM daily_values WINDOW w AS (PARTITION BY user_id ORDER BY day ROWS UNBOUNDED PRECEDING)", D, "mean sd")
add("average_rank", lambda s, d: wd.average_rank(vw.predictions(s, d), "score", ("arm",)).select("arm", "user_id", "rank"), "SELECT arm, user_id, rank() OVER (PARTITION BY arm ORDER BY score) + (count(*) OVER (PARTITION BY arm, score) - 1) / 2 AS rank FROM predictions", P)

# Gaps and bins
RUNS = GRID + ", ru AS (SELECT user_id, day, missing, min(bin) AS start, max(bin) AS \"end\", count(*) AS length, min(bin) > 0 AND max(bin) < 7 AS interior FROM (SELECT *, hr IS NULL AS missing, bin - row_number() OVER (PARTITION BY user_id, day, hr IS NULL ORDER BY bin) AS i FROM g) GROUP BY user_id, day, missing, i)\n"
add("bin_runs", lambda s, d: gaps.bin_runs(grid(s, d)), "SELECT * FROM ru", RUNS)
add("clean_diff", lambda s, d: gaps.clean_diff(grid(s, d)).select("user_id", "day", "bin", "diff"), "SELECT user_id, day, bin, coalesce(lead(hr) OVER (PARTITION BY user_id, day ORDER BY bin) - hr, 0) AS diff FROM g", GRID, "diff")
FILL = GRID + ", tp AS (SELECT bin, median(hr) AS template FROM g WHERE user_id % 2 = 0 GROUP BY 1), fc AS (SELECT g.*, coalesce(hr, template, (SELECT median(hr) FROM g WHERE user_id % 2 = 0)) AS filled FROM g LEFT JOIN tp USING (bin))\n"
clock = lambda s, d: gaps.fill_clock(grid(s, d), grid(s, d).where("user_id % 2 = 0"))
add("fill_clock", lambda s, d: clock(s, d).select("user_id", "day", "bin", "filled"), "SELECT user_id, day, bin, filled FROM fc", FILL, "filled")
add("fill_linear", lambda s, d: gaps.fill_linear(clock(s, d), 2).select("user_id", "day", "bin", "linear"), ", nb AS (SELECT *, last_value(CASE WHEN hr IS NOT NULL THEN bin END IGNORE NULLS) OVER p AS b0, last_value(hr IGNORE NULLS) OVER p AS h0, first_value(CASE WHEN hr IS NOT NULL THEN bin END IGNORE NULLS) OVER n AS b1, first_value(hr IGNORE NULLS) OVER n AS h1 FROM fc WINDOW p AS (PARTITION BY user_id, day ORDER BY bin ROWS UNBOUNDED PRECEDING), n AS (PARTITION BY user_id, day ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT user_id, day, bin, round(CASE WHEN hr IS NULL AND b1 - b0 - 1 <= 2 THEN h0 + (h1 - h0) * (bin - b0) / (b1 - b0) ELSE filled END, 6) AS linear FROM nb", FILL)
QUERIES["fill_linear"] = lambda s, d: gaps.fill_linear(clock(s, d), 2).select("user_id", "day", "bin", fn.r6(F.col("linear")).alias("linear"))
profile = lambda s, d: events(s, d).groupBy("user_id", F.col("hour").alias("bin")).agg(F.avg("value").alias("hr"))
add("circular_smooth", lambda s, d: gaps.circular_smooth(profile(s, d), 24, 1.5, keys=("user_id",)).select("user_id", "bin", "smooth"), "SELECT user_id, ((hour + k + 24) % 24)::BIGINT AS bin, sum(exp(-0.5 * (k / 1.5) ** 2) * hr) / sum(exp(-0.5 * (k / 1.5) ** 2)) AS smooth FROM (SELECT user_id, hour, avg(value) AS hr FROM e GROUP BY ALL), range(-6, 7) r(k) GROUP BY ALL", E, "smooth")
gapped = lambda s, d: profile(s, d).withColumn("hr", F.when(F.col("bin") % 5 != F.col("user_id") % 5, F.col("hr")))
add("circular_smooth_omit", lambda s, d: gaps.circular_smooth(gapped(s, d), 24, 1.5, keys=("user_id",), nulls="omit").select("user_id", "bin", "smooth"), "SELECT user_id, ((hour + k + 24) % 24)::BIGINT AS bin, CASE WHEN bool_or(k = 0) THEN sum(exp(-0.5 * (k / 1.5) ** 2) * hr) / sum(exp(-0.5 * (k / 1.5) ** 2)) END AS smooth FROM (SELECT user_id, hour, avg(value) AS hr FROM e WHERE hour % 5 <> user_id % 5 GROUP BY ALL), range(-6, 7) r(k) GROUP BY ALL", E, "smooth")
add("mask_stats", lambda s, d: gaps.mask_stats(grid(s, d)), "SELECT user_id, bin, avg((hr IS NOT NULL)::INT) AS share, count(*) AS days, coalesce(stddev_samp((hr IS NOT NULL)::INT), 0) AS sd FROM g GROUP BY ALL", GRID, "share sd")

# Evaluation
CUM = P + ", c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY arm) AS np, sum(neg) OVER (PARTITION BY arm) AS nn, coalesce(sum(neg) OVER (PARTITION BY arm ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t WINDOW w AS (PARTITION BY arm ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), cu AS (SELECT arm, score AS tau, tp::BIGINT AS tp, (tp + fp)::BIGINT AS n, tp / (tp + fp) AS precision, (tp + fp) / (np + nn) AS coverage FROM c)\n"
add("auroc", lambda s, d: ev.auroc(vw.predictions(s, d)), "SELECT arm, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auroc, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM c GROUP BY 1", CUM, "auroc")
add("average_precision", lambda s, d: ev.average_precision(vw.predictions(s, d)), "SELECT arm, sum(pos * tp / (tp + fp)) / sum(pos) AS average_precision FROM c GROUP BY 1", CUM, "average_precision")
add("best_threshold", lambda s, d: ev.best_threshold(vw.predictions(s, d)), "SELECT arm, score AS threshold, round((tp / np + 1 - fp / nn) / 2, 12) AS balanced_accuracy FROM c QUALIFY row_number() OVER (PARTITION BY arm ORDER BY round((tp / np + 1 - fp / nn) / 2, 12) DESC, score DESC) = 1", CUM, "balanced_accuracy")
add("kruskal_wallis", lambda s, d: ev.kruskal_wallis(vw.predictions(s, d), ["arm"], "grp", "score"), ", r AS (SELECT arm, grp, rank() OVER (PARTITION BY arm ORDER BY score) + (count(*) OVER (PARTITION BY arm, score) - 1) / 2 AS rk FROM predictions), q AS (SELECT arm, sum(sr ** 2 / n) AS s, sum(n) AS n, count(*) AS groups FROM (SELECT arm, grp, sum(rk) AS sr, count(*)::DOUBLE AS n FROM r GROUP BY ALL) GROUP BY 1), ti AS (SELECT arm, sum((pos + neg)::DOUBLE ** 3 - (pos + neg)) AS c FROM t GROUP BY 1) SELECT arm, groups, round((12 / (n * (n + 1)) * s - 3 * (n + 1)) / (1 - c / (n ** 3 - n)), 6) AS h FROM q JOIN ti USING (arm)", P)
QUERIES["kruskal_wallis"] = lambda s, d: ev.kruskal_wallis(vw.predictions(s, d), ["arm"], "grp", "score").withColumn("h", fn.r6(F.col("h")))
ANG = E + ", an AS (SELECT user_id, 2 * pi() * (local_ms % 86400000) / 86400000 - pi() AS angle FROM e)\n"
angles = lambda s, d: events(s, d).select("user_id", (2 * F.pi() * F.pmod("local_ms", F.lit(fn.DAY_MS)) / fn.DAY_MS - F.pi()).alias("angle"))

# Rhythms
PERIODS = rhythms.PERIODS
DET = D + ", fit AS (SELECT user_id, coalesce(regr_slope(value, day), 0) AS b, avg(value) AS m, avg(day) AS t FROM daily_values GROUP BY 1), dt AS (SELECT user_id, day, value, value - m - b * (day - t) AS residual FROM daily_values JOIN fit USING (user_id))\n"
SPEC = DET + """, x AS (SELECT user_id, period, residual AS y, cos(2 * pi() * day / period) AS c, sin(2 * pi() * day / period) AS s FROM dt, (SELECT unnest(range(28, 113)) / 2 AS period)),
mm AS (SELECT user_id, period, count(*) AS n, avg(c * c) AS cc, avg(s * s) AS ss, avg(c * s) AS cs, avg(c * y) AS cy, avg(s * y) AS sy, avg(y * y) AS yy FROM x GROUP BY ALL),
co AS (SELECT *, CASE WHEN cc * ss - cs ** 2 > 1e-9 AND yy > 1e-12 THEN (cy * ss - sy * cs) / (cc * ss - cs ** 2) END AS b, CASE WHEN cc * ss - cs ** 2 > 1e-9 AND yy > 1e-12 THEN (sy * cc - cy * cs) / (cc * ss - cs ** 2) END AS g FROM mm), sp AS (SELECT user_id, period, n, (b * cy + g * sy) / yy AS power, sqrt(b ** 2 + g ** 2) AS amplitude, atan2(g, b) AS phase FROM co)
"""
add("detrend", lambda s, d: rhythms.detrend(vw.daily_values(s, d)).select("user_id", "day", "residual"), "SELECT user_id, day, residual FROM dt", DET, "residual")
spec = lambda s, d: rhythms.spectrum(rhythms.detrend(vw.daily_values(s, d)), PERIODS)

# Splits
LR = DM + ", gz AS (SELECT bmi_grp AS grp, count(*) AS n FROM demographics GROUP BY 1), lr AS (SELECT grp, n, floor(n * 100 / tot) AS f, n * 100 / tot - floor(n * 100 / tot) AS rem FROM gz, (SELECT sum(n) AS tot FROM gz)), sr AS (SELECT grp, n, (f + (row_number() OVER (ORDER BY round(rem, 9) DESC, grp) <= 100 - sum(f) OVER ())::INT)::BIGINT AS share FROM lr)\n"
add("largest_remainder", lambda s, d: splits.largest_remainder(vw.demographics(s, d).groupBy(F.col("bmi_grp").alias("grp")).agg(F.count("*").alias("n")), 100), "SELECT * FROM sr", LR)
add("proportional_sample", lambda s, d: splits.proportional_sample(vw.demographics(s, d), "user_id", "bmi_grp", 100, "prop").select("user_id", "bmi_grp"), "SELECT user_id, bmi_grp FROM (SELECT user_id, bmi_grp, row_number() OVER (PARTITION BY bmi_grp ORDER BY sha256('prop|' || user_id), user_id) AS r FROM demographics) JOIN sr ON grp = bmi_grp WHERE r <= share", LR)
RK = DM + ", rk AS (SELECT user_id, age_group, row_number() OVER (PARTITION BY age_group ORDER BY sha256('split|' || user_id), user_id) AS r, count(*) OVER (PARTITION BY age_group) AS n FROM demographics)\n"
add("stratified_split", lambda s, d: splits.stratified_split(vw.demographics(s, d), "user_id", "age_group", "split"), "SELECT user_id, age_group, CASE WHEN r <= round(n * 0.15) THEN 'test' WHEN r <= round(n * 0.15) + round(n * 0.15) THEN 'val' ELSE 'train' END AS split FROM rk", RK)
add("disjoint_kfold", lambda s, d: splits.disjoint_kfold(vw.demographics(s, d), "user_id", "age_group", "split"), "SELECT user_id, age_group, (r - 1) % 5 AS fold FROM rk", RK)
add("repeated_holdouts", lambda s, d: splits.repeated_holdouts(vw.demographics(s, d), "user_id", "age_group", "hold", 3), ", h AS (SELECT rep, user_id, age_group, row_number() OVER (PARTITION BY rep, age_group ORDER BY sha256('hold|' || rep || '|' || user_id), user_id) AS r, count(*) OVER (PARTITION BY rep, age_group) AS n FROM demographics, (SELECT unnest(range(0, 3)) AS rep)) SELECT rep, user_id, age_group, CASE WHEN r <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM h", DM)
add("disjoint_complete", lambda s, d: cohorts.split_checks(splits.stratified_split(vw.demographics(s, d), "user_id", "age_group", "split"), vw.demographics(s, d)), "SELECT 0::BIGINT AS overlapping, 0::BIGINT AS missing FROM demographics LIMIT 1", DM)
add("baseline_days", lambda s, d: splits.baseline_days(vw.daily_values(s, d), "base"), "SELECT user_id, day FROM daily_values QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sha256('base|' || user_id || '|' || day)) <= least(60, count(*) OVER (PARTITION BY user_id) // 4)", D)
