"""Cohort gates, source profiles, flow tables, demographic cleaning and joins that check cardinality."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators.ranks import join_nulls, quantiles


def adequate(days: DataFrame, min_hours: int = 8, min_cov_s: float = 28_800, min_n: int = 60) -> DataFrame:
    return days.withColumn("adequate", (F.col("hours") >= min_hours) & ((F.col("cov_s") >= min_cov_s) | (F.col("n") >= min_n)))


def coverage_gate(days: DataFrame, min_days: int = 14) -> DataFrame:
    """Adequate days of each user's best channel (ties to the smallest), channels that pass, and the gate."""
    per = days.groupBy("user_id", "channel").agg(F.count_if("adequate").alias("good"))
    best = F.max(F.struct(F.col("good"), (-F.col("channel")).alias("c")))
    out = per.groupBy("user_id").agg(best.alias("b"), F.count_if(F.col("good") >= min_days).alias("channels_adequate"))
    return out.select("user_id", (-F.col("b.c")).alias("best_channel"), F.col("b.good").alias("adequate_days"), "channels_adequate", (F.col("b.good") >= min_days).alias("passed"))


def coverage_by_channel(days: DataFrame, min_days: int = 14) -> DataFrame:
    per = days.groupBy("user_id", "channel").agg(F.count_if("adequate").alias("good"))
    return per.groupBy("channel").agg(F.count("*").alias("users"), F.count_if(F.col("good") >= min_days).alias("users_passing"), F.median("good").alias("median_good"))


def coverage_semantics(days: DataFrame, keys=("source", "channel")) -> DataFrame:
    """Days, days whose coverage exceeds 24 hours (it isn't clipped at midnight), the largest, and the user and day that attain it."""
    top = F.max_by(F.struct("user_id", "day"), F.struct("cov_s", -F.col("user_id"), -F.col("day")))
    return days.groupBy(*keys).agg(F.count("*").alias("day_rows"), F.count_if(F.col("cov_s") > 86_400).alias("over_24h"), F.max("cov_s").alias("most"), top.alias("t")).select(*keys, "day_rows", "over_24h", "most", F.col("t.user_id").alias("user_id"), F.col("t.day").alias("day"))


def primary_source(events: DataFrame) -> DataFrame:
    """The source with most distinct days, ties to the smallest code."""
    per = events.groupBy("user_id", "source").agg(F.countDistinct("day").alias("days"))
    return per.groupBy("user_id").agg(F.max_by("source", F.struct(F.col("days"), -F.col("source"))).alias("primary_source"), F.max("days").alias("days"))


def source_set(events: DataFrame) -> DataFrame:
    s = F.array_sort(F.collect_set("source"))
    return events.groupBy("user_id").agg(s.alias("s")).select("user_id", F.array_join(F.col("s").cast("array<string>"), ",").alias("sources"), F.size("s").cast("long").alias("n_sources"), (F.size("s") > 1).alias("multi"))


def source_indicators(events: DataFrame, codes) -> DataFrame:
    return events.groupBy("user_id").pivot("source", list(codes)).agg(F.max(F.lit(1).cast("long"))).na.fill(0).select("user_id", *[F.col(str(c)).alias(f"src_{c}") for c in codes])


def sole_source(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.countDistinct("source").alias("_n"), F.min("source").alias("source")).where("_n = 1").drop("_n")


def source_inventory(events: DataFrame, day_marks=(5, 10)) -> DataFrame:
    per = events.groupBy("channel", "source", "user_id").agg(F.count("*").alias("e"), F.countDistinct("day").alias("d"))
    return per.groupBy("channel", "source").agg(F.count("*").alias("users"), F.sum("e").alias("events"), F.sum("d").alias("days"), *[F.count_if(F.col("d") >= m).alias(f"users_{m}d") for m in day_marks], F.median("d").alias("median_days"))


def channel_audit(events: DataFrame) -> DataFrame:
    """Events, share of points, median minutes and median events a user-day of each channel and source, and whether it holds points or intervals."""
    ms = F.col("end_ms") - F.col("start_ms")
    keys = ["channel", "source"]
    daily = quantiles(events.groupBy(*keys, "user_id", "day").agg(F.count("*").alias("n")), keys, "n", {"median_events_day": 0.5})
    length = quantiles(events.select(*keys, (ms / 60_000).alias("_m")), keys, "_m", {"median_min": 0.5})
    own = events.groupBy(*keys).agg(F.count("*").alias("events"), F.avg((ms == 0).cast("double")).alias("zero_share"))
    own = join_nulls(own, F.broadcast(length), keys)  # one row for each channel and source
    kind = F.when(F.col("zero_share") >= 0.9, "point").when(F.col("zero_share") <= 0.1, "interval").otherwise("mixed")
    return join_nulls(own, F.broadcast(daily), keys).withColumn("kind", kind)


def cohort_flow(people: DataFrame, steps: list[tuple[str, object]], last: str = "included") -> DataFrame:
    """Counts by the first step whose condition holds, in the order of steps."""
    names = [n for n, _ in steps] + [last]
    cat = reduce(lambda acc, s: acc.when(F.coalesce(s[1], F.lit(False)), s[0]), steps[1:], F.when(F.coalesce(steps[0][1], F.lit(False)), steps[0][0])).otherwise(last)
    order = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (n, i)])
    return people.groupBy(cat.alias("category")).agg(F.count("*").alias("n")).withColumn("step", order[F.col("category")].cast("long"))


def demographics_clean(people: DataFrame, year_now: int, first_year: int = 1900) -> DataFrame:
    """Users that stand once, of a year in range and a binary salutation."""
    n = F.count("*").over(Window.partitionBy("user_id"))
    return people.withColumn("_n", n).where((F.col("_n") == 1) & F.col("birth_year").between(first_year, year_now) & F.col("salutation").isin(10, 20)).drop("_n")


def demographics_audit(people: DataFrame, year_now: int, first_year: int = 1900) -> DataFrame:
    own = people.groupBy("user_id").agg(F.count("*").alias("n"), F.first("birth_year").alias("y"), F.first("salutation").alias("s"))
    counts = own.agg(F.count_if(F.col("n") > 1).alias("a"), F.count_if(F.coalesce(~F.col("y").between(first_year, year_now), F.lit(True))).alias("b"), F.count_if(F.coalesce(~F.col("s").isin(10, 20), F.lit(True))).alias("c"), F.count("*").alias("d"))
    return counts.select(F.expr("stack(4, 'duplicated', a, 'bad_year', b, 'not_binary', c, 'users', d) as (item, n)"))


def ages(people: DataFrame, year: int) -> DataFrame:
    """Age in a year by birth year, null outside 0..120, and its five-year band."""
    age = F.lit(year) - F.col("birth_year")
    ok = age.between(0, 120)
    low = F.floor(age / 5) * 5
    band = F.when(F.col("birth_year").isNull(), fn.MISSING).when(ok, F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string"))).otherwise("INVALID")
    return people.select("user_id", F.when(ok, age).cast("long").alias("age"), band.alias("band"))


def age_support(people: DataFrame, year: int, least: int, bands: int = 3) -> DataFrame:
    """Users of either label in each band of five years, whether both reach a number, and whether so many bands do that ages can be compared."""
    a = people.withColumn("band", F.floor((F.lit(year) - F.col("birth_year")) / 5) * 5)
    out = a.groupBy("band").agg(F.count_if(F.col("salutation") == 10).alias("n0"), F.count_if(F.col("salutation") == 20).alias("n1"))
    out = out.withColumn("supported", (F.col("n0") >= least) & (F.col("n1") >= least))
    enough = out.agg((F.count_if("supported") >= bands).alias("comparable"))
    return out.crossJoin(F.broadcast(enough))  # enough is one row


def crosstab_share(rows: DataFrame, a: str, b: str) -> DataFrame:
    n = rows.groupBy(a, b).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def exclusion_by_group(rows: DataFrame, category: str, variables) -> DataFrame:
    """Long counts over (category, variable, value) for several variables in one pass."""
    pairs = ", ".join(f"'{v}', cast({v} as string)" for v in variables)
    long = rows.select(category, F.expr(f"stack({len(variables)}, {pairs}) as (variable, level)"))
    return long.groupBy(category, "variable", F.coalesce("level", F.lit(fn.MISSING)).alias("level")).agg(F.count("*").alias("n"))


def checked_join(left: DataFrame, right: DataFrame, on, how: str = "left") -> DataFrame:
    """left joined to right, whose keys must be unique: a repeated key raises as the join runs."""
    n = F.count("*").over(Window.partitionBy(*on))
    once = right.withColumn("_n", n).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.lit("repeated key in the right table"))).otherwise(F.lit(True))).where("_ok").drop("_n", "_ok")
    return left.join(once, list(on), how)


def manifest(people: DataFrame, meta: DataFrame, gate: DataFrame, primary: DataFrame) -> DataFrame:
    """One row for each person with label, event counts, gate and main source; those never seen have nulls and no pass."""
    joined = people.join(meta.select("user_id", "raw_events", "n_days"), "user_id", "left").join(gate.select("user_id", "passed"), "user_id", "left").join(primary.select("user_id", "primary_source"), "user_id", "left")
    return joined.select("user_id", fn.binary_label(F.col("salutation")).alias("label"), "age_group", "bmi_grp", "raw_events", "n_days", F.coalesce("passed", F.lit(False)).alias("passed"), "primary_source")


def tier_flags(m: DataFrame, min_days: int) -> DataFrame:
    return m.select("user_id", F.col("raw_events").isNotNull().alias("tier_seen"), (F.col("passed") & F.col("label").isNotNull()).alias("tier_strict"), (F.coalesce(F.col("n_days"), F.lit(0)) >= min_days).alias("tier_days"))


def window_range_join(days: DataFrame, windows: DataFrame) -> DataFrame:
    return days.join(windows, "user_id").where(F.col("day").between(F.col("start_day"), F.col("end_day")))


def grid_complete(users: DataFrame, channels: DataFrame, stats: DataFrame, value: str) -> DataFrame:
    """A row for each user and channel; channels is a dimension of a few rows. Missing counts are 0."""
    return users.crossJoin(F.broadcast(channels)).join(stats, ["user_id", "channel"], "left").select("user_id", "channel", F.coalesce(value, F.lit(0)).alias(value))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def split_checks(splits: DataFrame, users: DataFrame) -> DataFrame:
    """Users in several splits, and users in none."""
    many = splits.groupBy("user_id").agg(F.countDistinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("overlapping"))
    none = users.select("user_id").distinct().join(splits, "user_id", "left_anti").agg(F.count("*").alias("missing"))
    return many.crossJoin(none)  # one row each


def common_arms(preds: DataFrame, arms: int) -> DataFrame:
    return preds.groupBy("user_id").agg(F.countDistinct("arm").alias("k")).where(F.col("k") == arms).select("user_id")


def outer_blocks(a: DataFrame, b: DataFrame, on) -> DataFrame:
    return a.join(b, list(on), "full")


def cohort_checks(m: DataFrame, events: DataFrame, days: DataFrame, splits: DataFrame, excluded=(), min_days: int = 14, forbidden=()) -> DataFrame:
    """(check, violations, passed) of a manifest (user_id, label, passed, adequate_days, raw_events) and what belongs to it.

    Labels are 0 or 1, users unique, those passed were seen, no event is of an excluded source, the gate and its days come out the
    same from the day table, forbidden columns are absent, and splits hold each passed user once and no other.
    """
    n = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
    own = m.agg(F.count_if(F.coalesce(~F.col("label").isin(0, 1), F.lit(False))).alias("a"), (F.count("*") - F.countDistinct("user_id")).alias("b"), F.count_if(F.col("passed") & F.col("raw_events").isNull()).alias("c"))
    base = own.select(F.expr("stack(3, 'labels_binary', a, 'users_unique', b, 'passed_were_seen', c) as (check, violations)"))
    best = days.groupBy("user_id", "channel").agg(F.count_if("adequate").alias("_g")).groupBy("user_id").agg(F.max("_g").alias("_g"))
    gate = m.join(best, "user_id", "left").withColumn("_g", F.coalesce("_g", F.lit(0)))
    passed = m.where("passed").select("user_id").distinct()
    once = splits.groupBy("user_id").agg(F.count("*").alias("_n"))
    bad = len(set(forbidden) & set(m.columns))
    checks = (
        base.unionByName(n(events.where(F.col("source").isin(*excluded)) if excluded else events.limit(0), "no_excluded_source"))
        .unionByName(n(gate.where(~F.col("_g").eqNullSafe(F.coalesce("adequate_days", F.lit(0)))), "adequate_days_recomputed"))
        .unionByName(n(gate.where(F.coalesce("passed", F.lit(False)) != (F.col("_g") >= min_days)), "gate_recomputed"))
        .unionByName(base.limit(1).select(F.lit("forbidden_absent").alias("check"), F.lit(bad).cast("long").alias("violations")))
        .unionByName(n(passed.join(once, "user_id", "full").where(F.coalesce("_n", F.lit(0)) != 1), "split_covers_each_once"))
        .unionByName(n(once.join(passed, "user_id", "left_anti"), "split_holds_no_other"))
    )
    return checks.withColumn("passed", F.col("violations") == 0)
