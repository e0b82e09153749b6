"""Exact ranks and running sums of groups of any size: ordered buckets first, then rows within a bucket."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_nulls(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Joins on keys of which null equals null; right's keys are dropped."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # right is one row
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    return left.join(r, reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])).drop(*[f"_r_{k}" for k in keys])


def running_totals(rows: DataFrame, keys, order: str, cols, buckets: int = 64, few: bool = False) -> DataFrame:
    """Adds <c>_before, the sum of c over the key's rows of lesser `order`, and <c>_total. `order` is distinct within keys.

    Approximate quantiles cut each key's rows into buckets, whose sums are few. A window then orders only the rows of
    one bucket, so no task sorts a whole key; where the cuts lie doesn't change the result. With `few` the caller vouches
    for some thousand keys at most (arms, strata, bins of a day): their buckets are broadcast, so a large key isn't dealt to one task.
    """
    keys, hint = list(keys), F.broadcast if few else lambda df: df
    edges = rows.groupBy(*keys).agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 1000).alias("_e"))
    cut = join_nulls(rows, hint(edges), keys).withColumn("_b", F.size(F.filter("_e", lambda e: e < F.col(order)))).drop("_e")
    sums = cut.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_{c}") for c in cols])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select(*keys, "_b", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in cols], *[F.sum(f"_{c}").over(Window.partitionBy(*keys)).alias(f"{c}_total") for c in cols])
    inner = Window.partitionBy(*keys, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = join_nulls(cut, hint(parts), [*keys, "_b"]).withColumns({f"{c}_before": F.col(f"_o_{c}") + F.coalesce(F.sum(c).over(inner), F.lit(0)) for c in cols})
    return out.drop("_b", *[f"_o_{c}" for c in cols])


def hash_rank(rows: DataFrame, keys, draw: Column, id_col: str, name: str = "rank", few: bool = False) -> DataFrame:
    """Adds the rank from 1 of `draw`, a hex digest, then id_col, within keys, and the key's size as <name>_of.

    Digests spread evenly, so their first three digits make 4,096 ordered buckets of a key; each is ranked by itself. `few` as in running_totals, for some hundred keys.
    """
    keys = list(keys)
    cut = rows.withColumn("_d", draw).withColumn("_b", F.substring("_d", 1, 3))
    sums = cut.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    parts = sums.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"), F.sum("_n").over(Window.partitionBy(*keys)).alias(f"{name}_of"))
    inner = Window.partitionBy(*keys, "_b").orderBy("_d", id_col)
    hint = F.broadcast if few else lambda df: df
    return join_nulls(cut, hint(parts), [*keys, "_b"]).withColumn(name, F.col("_o") + F.row_number().over(inner)).drop("_d", "_b", "_o")


def quantiles(rows: DataFrame, keys, value: str, shares: dict[str, float], few: bool = False) -> DataFrame:
    """Quantiles of value for each key, exact and interpolated between neighbours; shares maps names to shares. Nulls are left out.

    Equal values are counted first and the order statistics found in running sums, so no task holds a key's values. `few` as in running_totals.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    totals = running_totals(counts, keys, value, ("_c",), few=few)
    at = lambda place: F.max(F.when((F.col("_c_before") <= place) & (place < F.col("_c_before") + F.col("_c")), F.col(value)))
    place = {n: (F.col("_c_total") - 1) * p for n, p in shares.items()}
    out = totals.groupBy(*keys).agg(F.max("_c_total").alias("_c_total"), *[at(f(x)).alias(f"_{w}_{n}") for n, x in place.items() for w, f in (("l", F.floor), ("h", F.ceil))])
    return out.select(*keys, *[(F.col(f"_l_{n}") + (F.col(f"_h_{n}") - F.col(f"_l_{n}")) * (x - F.floor(x))).alias(n) for n, x in place.items()])
