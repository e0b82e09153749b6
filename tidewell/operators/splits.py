"""Deterministic splits and samples by hash rank and largest remainders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators.ranks import hash_rank, join_nulls


def largest_remainder(groups: DataFrame, total: int, weight: str = "n") -> DataFrame:
    """Whole shares of total in proportion to weight; what is left goes to the largest remainders, ties to the first group.

    groups has a row for each group, so its windows without partition see few rows.
    """
    whole = groups.agg(F.sum(weight).alias("_w"))
    exact = groups.crossJoin(whole).withColumn("_x", F.col(weight) * total / F.col("_w")).withColumn("_f", F.floor("_x"))
    left = total - F.sum("_f").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), "grp"))
    return exact.withColumn("_l", left).withColumn("_r", rank).select("grp", weight, (F.col("_f") + (F.col("_r") <= F.col("_l")).cast("long")).alias("share"))


def stratified_split(rows: DataFrame, id_col: str, label: str, tag: str, test: float = 0.15, val: float = 0.15) -> DataFrame:
    """test, val and train by hash rank within each label; the first two have rounded sizes."""
    ranked = hash_rank(rows.select(id_col, label), [label], fn.hash_rank_key(tag, F.col(id_col)), id_col)
    a, b = F.round(F.col("rank_of") * test), F.round(F.col("rank_of") * val)
    return ranked.select(id_col, label, F.when(F.col("rank") <= a, "test").when(F.col("rank") <= a + b, "val").otherwise("train").alias("split"))


def disjoint_kfold(rows: DataFrame, id_col: str, label: str, tag: str, k: int = 5) -> DataFrame:
    ranked = hash_rank(rows.select(id_col, label), [label], fn.hash_rank_key(tag, F.col(id_col)), id_col)
    return ranked.select(id_col, label, ((F.col("rank") - 1) % k).cast("long").alias("fold"))


def balanced_folds(rows: DataFrame, id_col: str, strata, tag: str, k: int = 5) -> DataFrame:
    """k folds whose sizes differ by one row at most, as does each stratum's part of them.

    Rows are dealt round in the order of stratum, then hash: place = rows of lesser strata + rank within one's own.
    Strata are few, so their window without partition sees few rows.
    """
    strata = list(strata)
    ranked = hash_rank(rows.select(id_col, *strata), strata, fn.hash_rank_key(tag, F.col(id_col)), id_col)
    sizes = rows.groupBy(*strata).agg(F.count("*").alias("_n"))
    offset = sizes.select(*strata, F.coalesce(F.sum("_n").over(Window.orderBy(*strata).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    return join_nulls(ranked, offset, strata).select(id_col, *strata, ((F.col("_o") + F.col("rank") - 1) % k).cast("long").alias("fold"))


def customer_split(rows: DataFrame, entity: str, label: str, tag: str) -> DataFrame:
    """Splits entities, not rows, and gives each row its entity's split; entities of several labels, or of none, are left out."""
    own = rows.groupBy(entity).agg(F.min(label).alias("_a"), F.max(label).alias("_b")).where("_a = _b").select(entity, F.col("_a").alias(label))
    return rows.drop(label).join(stratified_split(own, entity, label, tag), entity)


def split_checks(rows: DataFrame, entity: str, label: str, assigned: DataFrame, splits=("train", "val", "test"), labels=(0, 1)) -> DataFrame:
    """(check, violations, passed) of an assignment (entity, split) of the entities of rows, a row for each check.

    missing_entity and missing_label count rows, conflicting_label, unassigned, unknown_entity and assigned_twice entities, other_label
    entities with a label that isn't one of `labels`, unknown_split assignments; single_class counts splits that lack one of the labels.
    Each side is one row for each entity before they meet, so the join is of entities, once.
    """
    own = rows.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.min(label).alias("_a"), F.max(label).alias("_b"))
    given = assigned.groupBy(F.col(entity)).agg(F.count("*").alias("_n"), F.count_if(F.col("split").isNull() | ~F.col("split").isin(*splits)).alias("_odd"), F.min("split").alias("_s"))
    clear = F.col("_a") == F.col("_b")
    met = own.withColumn("_in", F.lit(True)).join(given, entity, "full")
    classes = [F.count_if(F.col("_in") & clear & (F.col("_s") == s) & (F.col("_a") == v)) == 0 for s in splits for v in labels]
    lacking = [classes[i * len(labels) : (i + 1) * len(labels)] for i in range(len(splits))]
    found = met.agg(
        F.count_if(F.col("_a") != F.col("_b")).alias("conflicting_label"), F.count_if(F.col("_in") & ~(F.col("_a").isin(*labels) & F.col("_b").isin(*labels))).alias("other_label"), F.count_if(F.col("_in") & F.col("_n").isNull()).alias("unassigned"),
        F.count_if(F.col("_in").isNull()).alias("unknown_entity"), F.count_if(F.col("_n") > 1).alias("assigned_twice"), F.coalesce(F.sum("_odd"), F.lit(0)).alias("unknown_split"),
        sum((F.when(reduce(lambda a, b: a | b, c), 1).otherwise(0) for c in lacking), F.lit(0)).cast("long").alias("single_class"),
    )
    empty = rows.agg(F.count_if(F.col(entity).isNull()).alias("missing_entity"), F.count_if(F.col(label).isNull()).alias("missing_label"))
    names = [*empty.columns, *found.columns]
    wide = empty.crossJoin(found)  # one row each
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in names])).alias("c")).select("c.check", "c.violations", (F.col("c.violations") == 0).alias("passed"))


def repeated_holdouts(rows: DataFrame, id_col: str, label: str, tag: str, repeats: int, test: float = 0.2) -> DataFrame:
    r = rows.select(id_col, label, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(repeats - 1).cast("long"))).alias("rep"))
    ranked = hash_rank(r, ["rep", label], fn.hash_rank_key(tag, F.col("rep"), F.col(id_col)), id_col)
    return ranked.select("rep", id_col, label, F.when(F.col("rank") <= F.round(F.col("rank_of") * test), "test").otherwise("train").alias("split"))


def proportional_sample(rows: DataFrame, id_col: str, grp: str, total: int, tag: str) -> DataFrame:
    """Exactly total rows, from groups in proportion by largest remainder, drawn by hash."""
    sizes = rows.groupBy(F.col(grp).alias("grp")).agg(F.count("*").alias("n"))
    shares = largest_remainder(sizes, total).select(F.col("grp").alias(grp), "share")
    ranked = hash_rank(rows.select(id_col, grp), [grp], fn.hash_rank_key(tag, F.col(id_col)), id_col)
    return ranked.join(shares, grp).where(F.col("rank") <= F.col("share")).select(id_col, grp)


def baseline_days(days: DataFrame, tag: str, most: int = 60) -> DataFrame:
    """min(most, n div 4) days of each user, drawn by hash."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(fn.hash_rank_key(tag, F.col("user_id"), F.col("day"))))
    n = F.count("*").over(Window.partitionBy("user_id"))
    return days.select("user_id", "day", rank.alias("_r"), n.alias("_n")).where(F.col("_r") <= F.least(F.lit(most), F.floor(F.col("_n") / 4))).select("user_id", "day")
