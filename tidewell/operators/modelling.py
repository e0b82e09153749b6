"""Tables for models and the models themselves: everything is learnt from training rows alone."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell import functions as fn
from tidewell.operators.evaluation import auroc
from tidewell.operators.ranks import hash_rank, quantiles


def prepare(train: DataFrame, rows: DataFrame, numeric, categorical=(), max_levels: int = 200) -> tuple[DataFrame, list[str]]:
    """Imputes medians beside missing indicators, the mode of categories, and one-hot codes; names the columns that vary.

    Columns without any training value are dropped. A category's unseen levels get zeros. A column of more than
    max_levels levels raises an error: that is a key, not a category. What comes to the driver is a few values for each column.
    """
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("v")) for c in numeric])).alias("e")).select("e.*") if numeric else None
    middle = {} if long is None else {r.item: r.m for r in quantiles(long, ["item"], "v", {"m": 0.5}, few=True).collect()}  # a row for each column
    stats = train.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"k_{c}") for c in numeric], *[F.count_distinct(c).alias(f"l_{c}") for c in categorical]).first()
    wide = [c for c in categorical if stats[f"l_{c}"] > max_levels]
    if wide:
        raise ValueError(f"more than {max_levels} levels in {wide}")
    new = {}
    for c in numeric:
        if middle.get(c) is not None:
            new[f"x_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(float(middle[c])))
            if stats[f"k_{c}"]:
                new[f"x_{c}_missing"] = F.col(c).isNull().cast("double")
    for c in categorical:
        levels = [(r[0], r[1]) for r in train.where(F.col(c).isNotNull()).groupBy(c).count().collect()]  # max_levels rows at most
        if levels:
            mode = min(levels, key=lambda v: (-v[1], str(v[0])))[0]
            for v in sorted(str(x) for x, _ in levels):
                new[f"x_{c}_{v}"] = (F.coalesce(F.col(c).cast("string"), F.lit(str(mode))) == v).cast("double")
    if not new:
        return rows, []
    spread = train.select(*[e.alias(k) for k, e in new.items()]).agg(*[F.var_pop(k).alias(k) for k in new]).first()
    kept = [k for k in new if spread[k]]
    return rows.withColumns({k: new[k] for k in kept}) if kept else rows, kept


def near_zero_variance(train: DataFrame, columns, ratio: float = 19.0, unique: float = 0.1) -> DataFrame:
    """Columns whose commonest value is `ratio` times as frequent as the next while few values are distinct."""
    long = train.select(F.expr(f"stack({len(columns)}, " + ", ".join(f"'{c}', cast({c} as string)" for c in columns) + ") as (item, v)"))
    counts = long.groupBy("item", "v").agg(F.count("*").alias("c"))
    s = counts.groupBy("item").agg(F.sum("c").alias("n"), F.count("v").alias("levels"), F.max("c").alias("top"), F.max_by(F.col("v"), F.struct("c", "v")).alias("mode"))
    second = counts.join(s.select("item", "mode"), "item").where(~F.col("v").eqNullSafe(F.col("mode"))).groupBy("item").agg(F.max("c").alias("next"))
    out = s.join(second, "item", "left").withColumn("ratio", F.col("top") / F.col("next")).withColumn("unique_share", F.col("levels") / F.col("n"))
    return out.select("item", "ratio", "unique_share", (F.col("next").isNull() | ((F.col("ratio") > ratio) & (F.col("unique_share") < unique))).alias("drop"))


def prune_correlated(train: DataFrame, columns, limit: float = 0.95) -> list[str]:
    """Columns in order, without those whose rank correlation with one kept before exceeds the limit."""
    r = Correlation.corr(VectorAssembler(inputCols=list(columns), outputCol="_f").transform(train), "_f", "spearman").first()[0].toArray()
    kept: list[int] = []
    for i in range(len(columns)):
        if all(not abs(r[i, j]) > limit for j in kept):
            kept.append(i)
    return [columns[i] for i in kept]


def _assembled(rows: DataFrame, features) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="error").transform(rows)


def linear_score(model, rows: DataFrame, features) -> DataFrame:
    """Adds the score of a linear model as a sum of columns, which needs no vectors."""
    return rows.withColumn("score", sum((F.col(f) * float(c) for f, c in zip(features, model.coefficients)), F.lit(float(model.intercept))))


def ridge_fit(train: DataFrame, val: DataFrame, features, y: str = "y", alphas=(0.01, 0.1, 1.0, 10.0)):
    """Ridge regression, penalised on standardised features; alpha has the best AUROC on val, ties to the largest.

    The normal equations are one pass over the training rows for each alpha; one alpha needs no look at val.
    """
    fit = _assembled(train, features)
    models = {a: LinearRegression(featuresCol="_features", labelCol=y, elasticNetParam=0.0, regParam=a, standardization=True, solver="normal").fit(fit) for a in alphas}
    if len(alphas) == 1:
        return models[alphas[0]]
    guess = lambda m: sum((F.col(f) * float(c) for f, c in zip(features, m.coefficients)), F.lit(float(m.intercept)))
    each = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.round(guess(m), 9).alias("score")) for a, m in models.items()]))
    areas = auroc(val.select(F.col(y).alias("y"), each.alias("e")).select("y", "e.*"), ("alpha",)).collect()  # a row for each alpha
    best = max(areas, key=lambda r: (round(r.auroc if r.auroc is not None else 0.5, 12), r.alpha), default=None)
    return models[next(a for a in alphas if best is None or float(a) == best.alpha)]


def forest(train: DataFrame, rows: DataFrame, features, y: str = "y", trees: int = 50, depth: int = 6, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Scores of a random forest and the importance of each feature."""
    model = RandomForestClassifier(featuresCol="_features", labelCol=y, numTrees=trees, maxDepth=depth, seed=seed).fit(_assembled(train, features))
    scored = model.transform(_assembled(rows, features)).withColumn("score", vector_to_array("probability")[1]).drop("_features", "rawPrediction", "probability", "prediction")
    weights = [(f, float(model.featureImportances[i])) for i, f in enumerate(features)]
    return scored, rows.sparkSession.createDataFrame(weights, "feature string, importance double")


def tune_forest(train: DataFrame, features, id_col: str, depths=(3, 6), y: str = "y", folds: int = 3, trees: int = 20, tag: str = "tune") -> tuple[int, DataFrame]:
    """The depth whose out-of-fold scores have the largest AUROC, ties to the smaller, and (depth, auroc) of all.

    Folds come from a hash of id_col. Each forest scores the fold it hasn't seen, and a depth's folds are judged together.
    """
    dealt = train.withColumn("_fold", F.conv(F.substring(fn.hash_rank_key(tag, F.col(id_col)), 1, 8), 16, 10).cast("long") % folds)
    parts = None
    for d in depths:
        for k in range(folds):
            own = forest(dealt.where(F.col("_fold") != k), dealt.where(F.col("_fold") == k), features, y, trees, d)[0].select(F.lit(d).cast("long").alias("depth"), F.col(y).alias("y"), F.round("score", 9).alias("score"))
            parts = own if parts is None else parts.unionByName(own)
    areas = auroc(parts, ("depth",)).select("depth", "auroc")
    best = min(((-(r.auroc if r.auroc is not None else 0.5), r.depth) for r in areas.collect()), default=(0, depths[0]))  # a row for each depth
    return int(best[1]), areas


def platt(val: DataFrame, rows: DataFrame, y: str = "y") -> DataFrame:
    """Calibrated scores by a logistic map fitted on val alone; rows without a score keep none."""
    model = LogisticRegression(featuresCol="_features", labelCol=y).fit(_assembled(val.where("score IS NOT NULL"), ["score"]))
    a, b = float(model.coefficients[0]), float(model.intercept)
    return rows.withColumn("calibrated", 1 / (1 + F.exp(-(F.col("score") * a + b))))


def blend(val: DataFrame, a: str, b: str, steps: int = 20) -> DataFrame:
    """The weight of arm a, of a grid, that gives two standardised scores the best AUROC on val; ties to the smallest."""
    z = val.where(F.col("arm").isin(a, b)).groupBy("arm").agg(F.avg("score").alias("_m"), F.stddev_samp("score").alias("_s"))
    wide = val.join(F.broadcast(z), "arm").withColumn("_z", F.try_divide(F.col("score") - F.col("_m"), "_s")).groupBy("user_id", "y").agg(F.max(F.when(F.col("arm") == a, F.col("_z"))).alias("_a"), F.max(F.when(F.col("arm") == b, F.col("_z"))).alias("_b"))  # z has two rows
    tried = wide.dropna(subset=["_a", "_b"]).withColumn("weight", F.explode(F.array(*[F.lit(i / steps) for i in range(steps + 1)]))).withColumn("score", F.round(F.col("weight") * F.col("_a") + (1 - F.col("weight")) * F.col("_b"), 9))
    return auroc(tried, ("weight",)).agg(F.min_by(F.struct("weight", "auroc"), F.struct(-F.round("auroc", 9), F.col("weight"))).alias("b")).select("b.*")


def permute(rows: DataFrame, column: str, id_col: str, tag: str) -> DataFrame:
    """Deals a column's values to other rows: the rank of one hash takes the value at that rank of another. No task sees all rows."""
    to = hash_rank(rows.drop(column), [], fn.hash_rank_key(f"{tag}|to", F.col(id_col)), id_col)
    frm = hash_rank(rows.select(id_col, column), [], fn.hash_rank_key(f"{tag}|from", F.col(id_col)), id_col).select(column, "rank")
    return to.join(frm, "rank").drop("rank", "rank_of")


def permutation_importance(score, val: DataFrame, features, id_col: str, tag: str = "perm") -> DataFrame:
    """Loss of AUROC on val for each feature with its values dealt anew; `score` maps rows to rows with y and score."""
    area = lambda d: auroc(score(d).select(F.lit("m").alias("arm"), "y", F.round("score", 9).alias("score")))
    base = area(val).select(F.col("auroc").alias("_base"))
    parts = [area(permute(val, f, id_col, f"{tag}|{f}")).select(F.lit(f).alias("feature"), "auroc") for f in features]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.crossJoin(F.broadcast(base)).select("feature", (F.col("_base") - F.col("auroc")).alias("loss"))  # base is one row


def top_features(weights: DataFrame, k: int) -> DataFrame:
    return weights.orderBy(F.desc("importance"), "feature").limit(k)


def transfer(local: DataFrame, imported: DataFrame) -> DataFrame:
    """AUROC of a model fitted at home and of one fitted elsewhere on the same rows, and the difference."""
    both = local.select(F.lit("local").alias("arm"), "y", "score").unionByName(imported.select(F.lit("imported").alias("arm"), "y", "score"))
    a = auroc(both).groupBy().agg(F.max(F.when(F.col("arm") == "local", F.col("auroc"))).alias("local"), F.max(F.when(F.col("arm") == "imported", F.col("auroc"))).alias("imported"))
    return a.withColumn("effect", F.col("imported") - F.col("local"))
