"""Registered queries of gaps, fills, draws and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators import epochs as ep, gaps, windows as wd
from tidewell.plans import views as vw
from tidewell.plans.queries import D, DW, E, FILL, GRID, add, clock, events, grid, selected, wins

PQ = FILL + """, ob AS (SELECT user_id, day, bin, {'x0': lag(bin::DOUBLE) OVER w, 'y0': lag(hr) OVER w, 'x1': bin::DOUBLE, 'y1': hr} AS p, {'x2': bin::DOUBLE, 'y2': hr, 'x3': lead(bin::DOUBLE) OVER w, 'y3': lead(hr) OVER w} AS q FROM fc WHERE hr IS NOT NULL WINDOW w AS (PARTITION BY user_id, day ORDER BY bin)),
nr AS (SELECT fc.*, last_value(p IGNORE NULLS) OVER (PARTITION BY user_id, day ORDER BY bin ROWS UNBOUNDED PRECEDING) AS p, first_value(q IGNORE NULLS) OVER (PARTITION BY user_id, day ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM fc LEFT JOIN ob USING (user_id, day, bin)),
sl AS (SELECT user_id, day, bin, hr, filled, p.y1 AS y1, q.y2 AS y2, q.x2 - p.x1 AS h, (p.y1 - p.y0) / (p.x1 - p.x0) AS d0, (q.y2 - p.y1) / nullif(q.x2 - p.x1, 0) AS d, (q.y3 - q.y2) / (q.x3 - q.x2) AS d2, p.x1 - p.x0 AS h0, q.x3 - q.x2 AS h2, (bin - p.x1) / nullif(q.x2 - p.x1, 0) AS t, CASE WHEN hr IS NULL THEN (q.x2 - p.x1 - 1)::BIGINT END AS gap FROM nr),
mm AS (SELECT *, CASE WHEN d0 * d > 0 THEN 3 * (h0 + h) / ((2 * h + h0) / d0 + (h + 2 * h0) / d) WHEN d0 * d <= 0 THEN 0 END AS m1, CASE WHEN d * d2 > 0 THEN 3 * (h + h2) / ((2 * h2 + h) / d + (h2 + 2 * h) / d2) WHEN d * d2 <= 0 THEN 0 END AS m2, y1 + (y2 - y1) * t AS line FROM sl),
pc AS (SELECT user_id, day, bin, gap, line, filled, CASE WHEN gap <= 4 THEN coalesce((2 * t ** 3 - 3 * t ** 2 + 1) * y1 + (t ** 3 - 2 * t ** 2 + t) * h * m1 + (3 * t ** 2 - 2 * t ** 3) * y2 + (t ** 3 - t ** 2) * h * m2, line) ELSE filled END AS pchip FROM mm)
"""
add("fill_global", lambda s, d: gaps.fill_global(grid(s, d), grid(s, d).where("user_id % 2 = 0")).select("user_id", "day", "bin", "level", "fixed"), "SELECT user_id, day, bin, coalesce(hr, (SELECT median(hr) FROM g WHERE user_id % 2 = 0)) AS level, coalesce(hr, 0) AS fixed FROM g", GRID, "level fixed")
add("fill_pchip", lambda s, d: gaps.fill_pchip(clock(s, d), 4).select("user_id", "day", "bin", "gap", "pchip"), "SELECT user_id, day, bin, gap, pchip FROM pc", PQ, "pchip")
add("fill_three_tier", lambda s, d: gaps.fill_three_tier(clock(s, d), 4).select("user_id", "day", "bin", "tiered"), "SELECT user_id, day, bin, CASE WHEN gap = 1 THEN line ELSE pchip END AS tiered FROM pc", PQ, "tiered")
GE = GRID + """, n AS (SELECT user_id, day, bin, hr, last_value(CASE WHEN hr IS NOT NULL THEN bin END IGNORE NULLS) OVER (PARTITION BY user_id, day ORDER BY bin ROWS UNBOUNDED PRECEDING) AS b0, first_value(CASE WHEN hr IS NOT NULL THEN bin END IGNORE NULLS) OVER (PARTITION BY user_id, day ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS b1 FROM g),
k AS (SELECT user_id, CASE WHEN hr IS NOT NULL AND b1 = bin + 1 THEN 'observed' WHEN b0 IS NULL OR b1 IS NULL THEN 'edge' WHEN b1 - b0 - 1 <= 2 THEN 'short' ELSE 'long' END AS kind FROM n WHERE bin < 7)
"""
add("gap_exposure", lambda s, d: gaps.gap_exposure(grid(s, d), 2), "SELECT user_id, count(*) AS steps, " + ", ".join(f"count(*) FILTER (kind = '{x}') AS {x}" for x in ("observed", "short", "long", "edge")) + " FROM k GROUP BY 1", GE)
add("step_error", lambda s, d: gaps.step_error(gaps.fill_pchip(clock(s, d), 4), ["filled", "pchip"]), "SELECT user_id, avg(abs(a)) AS filled_mae, sqrt(avg(a * a)) AS filled_rms, avg(abs(b)) AS pchip_mae, sqrt(avg(b * b)) AS pchip_rms FROM (SELECT user_id, lead(filled) OVER w - filled AS a, lead(pchip) OVER w - pchip AS b FROM pc WINDOW w AS (PARTITION BY user_id, day ORDER BY bin)) GROUP BY 1", PQ, "filled_mae filled_rms pchip_mae pchip_rms")
add("shuffle_within_day", lambda s, d: gaps.shuffle_within_day(grid(s, d), "sh").select("user_id", "day", "bin", "shuffled"), "SELECT g.user_id, g.day, g.bin, y.hr AS shuffled FROM g LEFT JOIN x USING (user_id, day, bin) LEFT JOIN y ON y.user_id = x.user_id AND y.day = x.day AND y.r = x.r", GRID + ", x AS (SELECT user_id, day, bin, row_number() OVER (PARTITION BY user_id, day ORDER BY bin) AS r FROM b), y AS (SELECT user_id, day, hr, row_number() OVER (PARTITION BY user_id, day ORDER BY sha256('sh|' || user_id || '|' || day || '|' || bin)) AS r FROM b)\n", "shuffled")
PE = E + """, nu AS (SELECT *, count(*) OVER (PARTITION BY user_id, channel, day) AS n, row_number() OVER (PARTITION BY user_id, channel, day ORDER BY start_ms, event_id) AS i, sha256('pe|' || user_id || '|' || event_id) AS dg FROM e),
nw AS (SELECT *, row_number() OVER (PARTITION BY user_id, channel, day ORDER BY dg, event_id) AS shuffled, ('0x' || substr(dg, 1, 8))::BIGINT % n + 1 AS resampled FROM nu)
"""
for _m, _c in (("shuffle", "shuffled"), ("resample", "resampled")):
    add(f"perturb_{_m}", lambda s, d, m=_m: ep.perturb_events(events(s, d), m, "pe").select("event_id", "value"), f"SELECT a.event_id, b.value FROM nw a JOIN nu b ON b.user_id = a.user_id AND b.channel = a.channel AND b.day = a.day AND b.i = a.{_c}", PE)
add("perturb_thin", lambda s, d: ep.perturb_events(events(s, d), "thin", "pe", 0.5).select("event_id", "value"), "SELECT event_id, value FROM nu WHERE ('0x' || substr(dg, 1, 8))::BIGINT < 2147483648", PE)
add("running_max_islands", lambda s, d: ep.islands(events(s, d)).select("event_id", "running_end", "island"), "SELECT event_id, before AS running_end, sum((before IS NULL OR start_ms > before)::INT) OVER (PARTITION BY user_id, channel, day ORDER BY start_ms, end_ms, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM (SELECT *, max(end_ms) OVER (PARTITION BY user_id, channel, day ORDER BY start_ms, end_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e)", E)
strict_by_channel = lambda s, d: wd.strict_weeks_gate(events(s, d).groupBy("user_id", "channel", "day").agg((F.count("*") >= 1).alias("strict")), 2, 3, 1, 3, ("user_id", "channel"))
add("best_channel", lambda s, d: wd.best_channel(strict_by_channel(s, d)), "SELECT user_id, channel, strict_days, start, n AS channels FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY strict_days DESC, start, channel) AS rk FROM be) WHERE rk = 1", E + """, wk AS (SELECT user_id, channel, day - (day + 3) % 7 AS week, count(DISTINCT day) AS d FROM e GROUP BY ALL), gr AS (SELECT user_id, channel, unnest(range(a, z + 1, 7)) AS week FROM (SELECT user_id, channel, min(week) AS a, max(week) AS z FROM wk GROUP BY ALL)),
dn AS (SELECT user_id, channel, week, coalesce(d, 0) AS d FROM gr LEFT JOIN wk USING (user_id, channel, week)), be AS (SELECT user_id, channel, strict_days, week AS start FROM (SELECT user_id, channel, week, sum((d >= 2)::INT) OVER w AS weeks_ok, (sum(d) OVER w)::BIGINT AS strict_days FROM dn WINDOW w AS (PARTITION BY user_id, channel ORDER BY week ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) QUALIFY row_number() OVER (PARTITION BY user_id, channel ORDER BY weeks_ok DESC, strict_days DESC, week) = 1)
""")
_days = lambda s, d: vw.daily_values(s, d).select("user_id", "day")
add("nested_k", lambda s, d: wd.nested_k(_days(s, d), (5, 20), "k"), "SELECT user_id, day, rank, k FROM (SELECT user_id, day, row_number() OVER (PARTITION BY user_id ORDER BY sha256('k|' || user_id || '|' || day)) AS rank FROM daily_values), (SELECT unnest([5, 20]::BIGINT[]) AS k) WHERE rank <= k", D)
add("first_window_per_user", lambda s, d: wd.first_window(wins(s, d)), "SELECT user_id, window_index, start_day, end_day FROM win WHERE window_index = 1", DW)
partial = lambda s, d: vw.daily_values(s, d).withColumn("value", F.when(F.col("value") < 48, F.col("value")))
add("exact_date_cohort", lambda s, d: wd.finite_on_all_dates(selected(s, d), vw.daily_values(s, d), partial(s, d)), "SELECT user_id, count(*) AS dates, count(*) FILTER (value IS NULL) AS missing_first, count(*) FILTER (value IS NULL OR value >= 48) AS missing_second, count(*) FILTER (value IS NULL OR value >= 48) = 0 AS kept FROM sel LEFT JOIN daily_values USING (user_id, day) GROUP BY 1", DW)
add("common_date_reselect", lambda s, d: wd.common_date_reselect(vw.daily_values(s, d), partial(s, d).where("value IS NOT NULL"), wins(s, d), 18, 2, "re"), "SELECT user_id, block, day FROM (SELECT *, row_number() OVER (PARTITION BY user_id, block ORDER BY sha256('re|' || user_id || '|' || day)) AS r FROM co) JOIN rq USING (user_id, block) WHERE r <= quota", DW + """, co AS (SELECT user_id, (day - start_day) // 30 AS block, day FROM daily_values JOIN win USING (user_id) WHERE window_index = 1 AND day BETWEEN start_day AND end_day AND value < 48), cc AS (SELECT user_id, block, count(*) AS capacity FROM co GROUP BY ALL),
ru AS (SELECT user_id, block, capacity, unit, count(DISTINCT block) OVER (PARTITION BY user_id) AS nb, row_number() OVER (PARTITION BY user_id ORDER BY unit NULLS LAST, block) AS r FROM (SELECT user_id, block, capacity, unnest(CASE WHEN capacity > 2 THEN range(3, capacity + 1) ELSE [NULL] END) AS unit FROM cc)), rq AS (SELECT user_id, block, least(2, capacity) + count(*) FILTER (unit IS NOT NULL AND r <= 18 - 2 * nb) AS quota FROM ru GROUP BY user_id, block, capacity)
""")
add("union_levels", lambda s, d: events(s, d).groupBy("user_id", F.lit("hour").alias("level"), F.col("hour").cast("string").alias("slot")).agg(F.count("*").alias("n")).unionByName(events(s, d).groupBy("user_id", F.lit("bucket").alias("level"), fn.tod_bucket(F.col("hour")).alias("slot")).agg(F.count("*").alias("n"))), "SELECT user_id, 'hour' AS level, hour::VARCHAR AS slot, count(*) AS n FROM e GROUP BY ALL UNION ALL SELECT user_id, 'bucket', CASE WHEN hour < 6 THEN 'night' WHEN hour < 12 THEN 'morning' WHEN hour < 18 THEN 'afternoon' ELSE 'evening' END, count(*) FROM e GROUP BY ALL", E)
