"""Column expressions: calendar, labels, hashing, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS, HOUR_MS = 86_400_000, 3_600_000
MISSING = "<MISSING>"


def local_ms(start: str = "start_ms", tz_min: str = "tz_min") -> Column:
    """Local wall-clock milliseconds; a missing offset counts as UTC."""
    return F.col(start) + F.coalesce(F.col(tz_min), F.lit(0)).cast("long") * 60_000


def day_of(ms: Column) -> Column:
    return F.floor(ms / DAY_MS).cast("long")


def hour_of(ms: Column) -> Column:
    return F.floor(F.pmod(ms, F.lit(DAY_MS)) / HOUR_MS).cast("long")


def bin_of(ms: Column, minutes: int) -> Column:
    return F.floor(F.pmod(ms, F.lit(DAY_MS)) / (minutes * 60_000)).cast("long")


def weekday(day: Column) -> Column:
    """Monday is 0."""
    return F.pmod(day + 3, F.lit(7)).cast("long")


def week_start(day: Column) -> Column:
    return (day - weekday(day)).cast("long")


def tod_bucket(hour: Column) -> Column:
    return F.when(hour < 6, "night").when(hour < 12, "morning").when(hour < 18, "afternoon").otherwise("evening")


def binary_label(code: Column, one: int = 20, zero: int = 10) -> Column:
    return F.when(code == one, 1).when(code == zero, 0).cast("long")


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def bmi(weight: Column, height_cm: Column) -> Column:
    return F.when((weight > 0) & (height_cm > 0), weight / F.pow(height_cm / 100, F.lit(2)))


def hash_rank_key(tag: str, *cols: Column) -> Column:
    """A key whose order is a fixed draw: SHA-256 of a tag and the values."""
    return F.sha2(F.concat_ws("|", F.lit(tag), *[c.cast("string") for c in cols]), 256)


def r6(c: Column) -> Column:
    """Rounded for reports, so that the order of a sum doesn't show."""
    return F.round(c, 6)


def steady(c: Column, digits: int = 14) -> Column:
    """Significant digits beyond the noise of sums, so that their order doesn't decide where a value halfway is rounded to."""
    return F.when(c.isNotNull(), F.format_string(f"%.{digits - 1}e", c).cast("double"))


def wrap_phase(c: Column) -> Column:
    return F.atan2(F.sin(c), F.cos(c))


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal z, by the rational approximation of the error function with an error below 2e-7."""
    # The published coefficients of that approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + p * x)
    return sum((c * F.pow(t, F.lit(i)) for i, c in enumerate(a, 1)), F.lit(0.0)) * F.exp(-x * x)


def student_quantile(df: Column, z: float = 1.959963984540054) -> Column:
    """The quantile of Student's t that belongs to the normal one z, by the first terms of its expansion in 1 / df."""
    g = (z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384)
    return sum((c / F.pow(df, F.lit(i)) for i, c in enumerate(g)), F.lit(0.0))
