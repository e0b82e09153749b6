"""Registered queries of models: the quality label from lengths, counts and origin of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.operators import evaluation as ev, modelling as ml, splits
from tidewell.operators.preparation import Preparation, PreparationModel
from tidewell.plans import fits_sql as fs, views as vw
from tidewell.plans.queries import P, add
from tidewell.sources.files import scratch

NUMERIC, GROUPS = ["n_chars", "n_words", "digits", "words_per_line"], ["lang", "source"]


def table(spark, sf_dir: str) -> DataFrame:
    d = vw.table(spark, sf_dir, "documents").join(vw.table(spark, sf_dir, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id")
    words, lines = F.size(F.split("text", r"\s+")), F.size(F.split("text", "\n"))
    return d.select(F.col("doc_id").alias("user_id"), "y", "n_chars", words.alias("n_words"), F.regexp_count("text", F.lit("[0-9]")).alias("digits"), (words / lines).alias("words_per_line"), "lang", "source")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet and read back."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark, sf_dir: str):
    """Prepared training, validation and test rows, and the features' names.

    Columns and splits are scratch tables: every fit and every permutation reads them, and neither texts nor ranks are gone through again.
    """
    t = stored(table(spark, sf_dir), "model")
    s = stored(t.join(splits.stratified_split(t.select("user_id", "y"), "user_id", "y", "ml").select("user_id", "split"), "user_id"), "split")
    ready, names = ml.prepare(s.where("split = 'train'"), s, NUMERIC, GROUPS)
    return [ready.where(F.col("split") == p) for p in ("train", "val", "test")], names


def ridge_scores(s, d):
    (train, val, test), names = parts(s, d)
    return ml.linear_score(ml.ridge_fit(train, val, names), test, names).select("user_id", "y", "score")


def forest_parts(s, d):
    """A forest of the depth that out-of-fold scores choose."""
    (train, _, test), names = parts(s, d)
    return ml.forest(train, test, names, depth=ml.tune_forest(train, names, "user_id", folds=2)[0])


def importance(s, d):
    (train, val, _), names = parts(s, d)
    numeric = [n for n in names if n in {f"x_{c}" for c in NUMERIC}]
    model = ml.ridge_fit(train, val, names, alphas=(0.1,))
    return ml.permutation_importance(lambda rows: ml.linear_score(model, rows, names), val, numeric, "user_id")


def platt_scores(s, d):
    p = vw.predictions(s, d).where("arm = 'length'")
    return ml.platt(p.where("user_id % 2 = 0").withColumn("y", F.col("y").cast("double")), p.where("user_id % 2 = 1")).select("user_id", "score", "calibrated")


def transfers(s, d):
    (train, val, test), names = parts(s, d)
    own = test.where("source = 'src0'")
    fit = lambda cond: ml.linear_score(ml.ridge_fit(train.where(cond), val.where(cond), names, alphas=(0.1,)), own, names)
    return ml.transfer(fit("source = 'src0'"), fit("source <> 'src0'"))


def pruned(s, d):
    (train, _, _), names = parts(s, d)
    kept = set(ml.prune_correlated(train, [n for n in names if n in {f"x_{c}" for c in NUMERIC}]))
    return s.createDataFrame([(n, n in kept) for n in names if n in {f"x_{c}" for c in NUMERIC}], "feature string, kept boolean")


def prep_report(s, d):
    (train, _, _), names = parts(s, d)
    return train.agg(*[F.avg(n).alias(n) for n in names]).select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', `{n}`" for n in names) + ") as (feature, mean)"))


def saved_preparation(s, d):
    """What a preparation learnt from training rows says after it was saved and loaded."""
    t = table(s, d)
    train = t.join(splits.stratified_split(t.select("user_id", "y"), "user_id", "y", "ml").where("split = 'train'").select("user_id"), "user_id")
    path = scratch(s, "prep")
    Preparation(numeric=NUMERIC, categorical=GROUPS).fit(train).save(path)
    return PreparationModel.load(path).statistics(s)


SP = """WITH mt AS (SELECT doc_id, quality::DOUBLE AS y, n_chars, len(regexp_split_to_array(text, '\\s+')) AS n_words, len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_split_to_array(text, '\\s+')) / len(string_split(text, chr(10))) AS words_per_line, lang, source FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
tr AS (SELECT * FROM mt JOIN (SELECT doc_id, row_number() OVER (PARTITION BY y ORDER BY sha256('ml|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY y) AS n FROM mt) USING (doc_id) WHERE r > round(n * 0.15) + round(n * 0.15))
"""
_num = " UNION ALL ".join(f"SELECT '{c}' AS item, count(*) AS rows, count(*) - count({c}) AS missing, median({c})::DOUBLE AS median, NULL::VARCHAR AS mode, NULL::BIGINT AS levels FROM tr" for c in NUMERIC)
_cat = " UNION ALL ".join(f"SELECT '{c}', count(*), count(*) - count({c}), NULL, (SELECT {c} FROM tr WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), count(DISTINCT {c}) FROM tr" for c in GROUPS)
add("prep_saved", saved_preparation, f"{_num} UNION ALL {_cat}", SP, "median")

#: fv: (user_id, y, split, source, feature, x) of prepared features, each learnt from training rows; those that don't vary there are left out.
_filled = " UNION ALL ".join(f"SELECT doc_id, 'x_{c}' AS feature, coalesce({c}, (SELECT median({c}) FROM trn))::DOUBLE AS x FROM sp UNION ALL SELECT doc_id, 'x_{c}_missing', ({c} IS NULL)::INT FROM sp WHERE (SELECT count(*) > count({c}) FROM trn)" for c in NUMERIC)
_coded = " UNION ALL ".join(f"SELECT doc_id, 'x_{c}_' || level, (coalesce({c}, (SELECT {c} FROM trn WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) = level)::INT FROM sp, (SELECT DISTINCT {c} AS level FROM trn WHERE {c} IS NOT NULL)" for c in GROUPS)
FEATURES = f"""{SP.split("tr AS")[0].replace("WITH", "WITH RECURSIVE", 1)}
sp AS (SELECT *, CASE WHEN r <= round(n * 0.15) THEN 'test' WHEN r <= round(n * 0.15) + round(n * 0.15) THEN 'val' ELSE 'train' END AS split FROM mt JOIN (SELECT doc_id, row_number() OVER (PARTITION BY y ORDER BY sha256('ml|' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY y) AS n FROM mt) USING (doc_id)),
trn AS (SELECT * FROM sp WHERE split = 'train'),
fa AS ({_filled} UNION ALL {_coded}),
fv AS (SELECT doc_id AS user_id, y, split, source, feature, x FROM fa JOIN sp USING (doc_id) WHERE feature IN (SELECT feature FROM fa JOIN trn USING (doc_id) GROUP BY 1 HAVING max(x) > min(x)))
"""


def ridge_sql(fits: str) -> str:
    """co: (fit, feature, b) of ridge fits, with the intercept as feature ''. `fits` selects (fit, alpha, user_id) of the rows of each.

    Features are standardised; the penalty is alpha over the label's deviation, as Spark's solver has it. Elimination runs over a list of lists.
    """
    return f""", fr AS (SELECT fit, alpha, user_id, y, feature, x FROM fv JOIN ({fits}) USING (user_id)),
fm AS (SELECT fit, alpha, feature, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM fr GROUP BY ALL HAVING max(x) > min(x)),
fi AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY feature) AS i, count(*) OVER (PARTITION BY fit) AS p FROM fm),
fz AS (SELECT fit, user_id, i, (x - mx) / sx AS z, y - my AS v FROM fr JOIN fi USING (fit, feature)),
fg AS (SELECT a.fit, a.i, b.i AS j, avg(a.z * b.z) AS v FROM fz a JOIN fz b USING (fit, user_id) GROUP BY ALL UNION ALL SELECT fit, i, 1 + max(i) OVER (PARTITION BY fit), c FROM (SELECT fit, i, avg(z * v) AS c FROM fz GROUP BY ALL)),
fl AS (SELECT fit, i, list(v + CASE WHEN i = j THEN alpha / sy ELSE 0 END ORDER BY j) AS line FROM fg JOIN fi USING (fit, i) GROUP BY ALL),
gj AS (SELECT fit, 1 AS k, count(*) AS p, list(line ORDER BY i) AS m FROM fl GROUP BY 1 UNION ALL SELECT fit, k + 1, p, [[CASE WHEN i = k THEN m[k][j] / m[k][k] ELSE m[i][j] - m[i][k] * m[k][j] / m[k][k] END for j in range(1, p + 2)] for i in range(1, p + 1)] FROM gj WHERE k <= p),
cb AS (SELECT fit, feature, mx, my, m[i][p + 1] / sx AS b FROM fi JOIN (SELECT fit, m FROM gj WHERE k > p) USING (fit)),
co AS (SELECT fit, feature, b FROM cb UNION ALL SELECT fit, '', max(my) - sum(b * mx) FROM cb GROUP BY 1)
"""


_guess = lambda rows: f"SELECT fit, user_id, y, any_value(b0) + sum(x * b) AS score FROM {rows} JOIN co USING (feature) JOIN (SELECT fit, b AS b0 FROM co WHERE feature = '') USING (fit) GROUP BY ALL"
RIDGE = FEATURES + ridge_sql("SELECT alpha AS fit, alpha, doc_id AS user_id FROM trn, (SELECT unnest([0.01, 0.1, 1.0, 10.0]::DOUBLE[]) AS alpha)") + f", vs AS (SELECT fit, y, round(score, 9) AS score FROM ({_guess("(SELECT * FROM fv WHERE split = 'val')")})), va AS ({fs.auroc('vs', 'fit')})\n"
add("prep_fit", prep_report, "SELECT feature, avg(x) AS mean FROM fv WHERE split = 'train' GROUP BY 1", FEATURES, "mean")
add("scale_ridge", ridge_scores, f"SELECT user_id, y, score FROM ({_guess("(SELECT * FROM fv WHERE split = 'test')")}) WHERE fit = (SELECT fit FROM va ORDER BY round(coalesce(auroc, 0.5), 12) DESC, fit DESC LIMIT 1)", RIDGE, "score")
add("forest", lambda s, d: forest_parts(s, d)[0].select("user_id", "y", "score"), doubles="score")
add("topk_features", lambda s, d: ml.top_features(forest_parts(s, d)[1], 5), doubles="importance")
_one = FEATURES + ridge_sql("SELECT 0 AS fit, 0.1::DOUBLE AS alpha, doc_id AS user_id FROM trn") + f""", pn AS (SELECT DISTINCT feature FROM fv WHERE feature IN ({", ".join(f"'x_{c}'" for c in NUMERIC)})), 
pr AS (SELECT feature, user_id, x, row_number() OVER (PARTITION BY feature ORDER BY sha256('perm|' || feature || '|to|' || user_id), user_id) AS "to", row_number() OVER (PARTITION BY feature ORDER BY sha256('perm|' || feature || '|from|' || user_id), user_id) AS "from" FROM fv WHERE split = 'val' AND feature IN (FROM pn)),
px AS (SELECT a.feature AS item, a.user_id, b.x AS moved FROM pr a JOIN pr b ON b.feature = a.feature AND b."from" = a."to"),
ps AS (SELECT item, y, round(score, 9) AS score FROM (SELECT item, user_id, y, any_value(b0) + sum(CASE WHEN v.feature = item THEN moved ELSE x END * b) AS score FROM px JOIN fv v USING (user_id) JOIN co USING (feature), (SELECT b AS b0 FROM co WHERE feature = '') GROUP BY ALL)
UNION ALL SELECT '', y, round(score, 9) FROM ({_guess("(SELECT * FROM fv WHERE split = 'val')")})), pa AS ({fs.auroc("ps", "item")})
"""
add("permutation_importance", importance, "SELECT item AS feature, (SELECT auroc FROM pa WHERE item = '') - auroc AS loss FROM pa WHERE item <> ''", _one, "loss")
add("platt", platt_scores, doubles="score calibrated")
_moved = FEATURES + ridge_sql("SELECT CASE WHEN source = 'src0' THEN 'local' ELSE 'imported' END AS fit, 0.1::DOUBLE AS alpha, doc_id AS user_id FROM trn WHERE source IS NOT NULL") + f""", ts AS ({_guess("(SELECT * FROM fv WHERE split = 'test' AND source = 'src0')")}), ta AS ({fs.auroc("ts", "fit")})
"""
add("transfer", transfers, "SELECT *, imported - local AS effect FROM (SELECT max(auroc) FILTER (fit = 'local') AS local, max(auroc) FILTER (fit = 'imported') AS imported FROM ta)", _moved, "local imported effect")
_order = " ".join(f"WHEN 'x_{c}' THEN {i}" for i, c in enumerate(NUMERIC, 1))
_keep = lambda i: " AND ".join(["true", *(f"NOT (k{j} AND coalesce(abs(c{j}{i}), 0) > 0.95)" for j in range(1, i))])
PRUNE = FEATURES + f""", ra AS (SELECT user_id, feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS r FROM fv WHERE split = 'train' AND feature IN ({", ".join(f"'x_{c}'" for c in NUMERIC)})),
ri AS (SELECT feature, row_number() OVER (ORDER BY CASE feature {_order} END) AS i FROM (SELECT DISTINCT feature FROM ra)),
rc AS (SELECT {", ".join(f"max(c) FILTER (i = {i} AND j = {j}) AS c{i}{j}" for i in range(1, 5) for j in range(i + 1, 5))} FROM (SELECT x.i, y.i AS j, corr(a.r, b.r) AS c FROM ra a JOIN ra b USING (user_id) JOIN ri x ON x.feature = a.feature JOIN ri y ON y.feature = b.feature GROUP BY ALL)),
k1 AS (SELECT *, true AS k1 FROM rc), k2 AS (SELECT *, {_keep(2)} AS k2 FROM k1), k3 AS (SELECT *, {_keep(3)} AS k3 FROM k2), k4 AS (SELECT *, {_keep(4)} AS k4 FROM k3)
"""
add("corr_prune", pruned, "SELECT feature, CASE i WHEN 1 THEN k1 WHEN 2 THEN k2 WHEN 3 THEN k3 ELSE k4 END AS kept FROM ri, k4", PRUNE)
BL = P + """, zs AS (SELECT user_id, y, max((score - m) / s) FILTER (arm = 'length') AS a, max((score - m) / s) FILTER (arm = 'mixed') AS b FROM predictions JOIN (SELECT arm, avg(score) AS m, stddev_samp(score) AS s FROM predictions GROUP BY 1) USING (arm) GROUP BY ALL),
tr AS (SELECT weight, round(weight * a + (1 - weight) * b, 9) AS score, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM zs, (SELECT unnest(range(0, 21)) / 20 AS weight) GROUP BY ALL),
bl AS (SELECT weight, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS auroc FROM (SELECT *, coalesce(sum(neg) OVER (PARTITION BY weight ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM tr) GROUP BY 1)
"""
add("blend", lambda s, d: ml.blend(vw.predictions(s, d), "length", "mixed"), "SELECT weight, auroc FROM bl ORDER BY round(auroc, 9) DESC, weight LIMIT 1", BL, "auroc")
NZ = "WITH lg AS (SELECT unnest(['lang', 'source', 'n_chars']) AS item, unnest([lang, source, n_chars::VARCHAR]) AS v FROM documents), c0 AS (SELECT item, v, count(*) AS c FROM lg GROUP BY ALL), ct AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY c DESC, v DESC NULLS LAST) AS r FROM c0), sm AS (SELECT item, sum(c) AS n, count(v) AS levels, max(c) AS top, max(c) FILTER (r > 1) AS nxt FROM ct GROUP BY 1)\n"
add("nzv", lambda s, d: ml.near_zero_variance(vw.table(s, d, "documents"), ["lang", "source", "n_chars"]), "SELECT item, top / nxt AS ratio, levels / n AS unique_share, nxt IS NULL OR (top / nxt > 19 AND levels / n < 0.1) AS \"drop\" FROM sm", NZ, "ratio unique_share")
