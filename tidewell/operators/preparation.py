"""Feature preparation as a fitted model that is saved and loaded, so that other rows are prepared without the training rows."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param.shared import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.ranks import quantiles


class PreparationModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """What Preparation learnt. transform adds `columns`; save and load keep all of it as one JSON parameter."""

    state = Param(Params._dummy(), "state", "fitted values as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, state: str | None = None):
        super().__init__()
        if state is not None:
            self._set(state=state)

    @property
    def learnt(self) -> dict:
        return json.loads(self.getOrDefault(self.state))

    @property
    def columns(self) -> list[str]:
        return self.learnt["columns"]

    def expressions(self) -> dict:
        """All prepared columns by name, those that didn't vary in training too."""
        out = {}
        for c, s in self.learnt["numeric"].items():
            if s["median"] is not None:
                out[f"x_{c}"] = F.coalesce(F.col(c).cast("double"), F.lit(float(s["median"])))
                if s["missing"]:
                    out[f"x_{c}_missing"] = F.col(c).isNull().cast("double")
        for c, s in self.learnt["categorical"].items():
            for v in s["levels"]:
                out[f"x_{c}_{v}"] = (F.coalesce(F.col(c).cast("string"), F.lit(s["mode"])) == v).cast("double")
        return out

    def _transform(self, rows: DataFrame) -> DataFrame:
        every = self.expressions()
        return rows.withColumns({c: every[c] for c in self.columns}) if self.columns else rows

    def statistics(self, spark: SparkSession) -> DataFrame:
        """(item, rows, missing, median, mode, levels) of each column, from the fitted values alone."""
        own = self.learnt
        found = [(c, own["rows"], s["missing"], s["median"], None, None) for c, s in own["numeric"].items()]
        found += [(c, own["rows"], s["missing"], None, s["mode"], len(s["levels"])) for c, s in own["categorical"].items()]
        return spark.createDataFrame(found, "item string, rows long, missing long, median double, mode string, levels long")


class Preparation(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Medians beside missing indicators for numeric columns; for categories the mode (ties: first as text) and a column for each level.

    Learnt from the rows given to fit alone. A numeric column without values, and prepared columns that don't vary there, are left
    out of `columns`; levels not seen get zeros; a null category counts as the mode. More than max_levels levels raise an error, as that is a key.
    Medians of all columns are exact and found together; the driver gets a few values for each column.
    """

    numeric = Param(Params._dummy(), "numeric", "numeric columns", typeConverter=TypeConverters.toListString)
    categorical = Param(Params._dummy(), "categorical", "categories", typeConverter=TypeConverters.toListString)
    max_levels = Param(Params._dummy(), "max_levels", "levels of a category at most", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, numeric=(), categorical=(), max_levels=200):
        super().__init__()
        given = dict(self._input_kwargs)
        self._setDefault(numeric=[], categorical=[], max_levels=200)
        self._set(**{k: list(v) if k != "max_levels" else v for k, v in given.items()})

    def _fit(self, train: DataFrame) -> PreparationModel:
        numeric, categorical, most = (self.getOrDefault(p) for p in (self.numeric, self.categorical, self.max_levels))
        counts = train.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"k_{c}") for c in [*numeric, *categorical]], *[F.count_distinct(c).alias(f"l_{c}") for c in categorical]).first()
        wide = [c for c in categorical if counts[f"l_{c}"] > most]
        if wide:
            raise ValueError(f"more than {most} levels in {wide}")
        middle = {}
        if numeric:
            long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("v")) for c in numeric])).alias("x")).select("x.*")
            middle = {r["item"]: r["m"] for r in quantiles(long, ["item"], "v", {"m": 0.5}, few=True).collect()}  # a row for each column
        state = {"rows": counts["rows"], "numeric": {c: {"median": middle.get(c), "missing": counts[f"k_{c}"]} for c in numeric}, "categorical": {}, "columns": []}
        for c in categorical:
            found = [(str(r[0]), r[1]) for r in train.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string")).count().collect()]  # max_levels rows at most
            mode = min(found, key=lambda v: (-v[1], v[0]))[0] if found else None
            state["categorical"][c] = {"mode": mode, "levels": sorted(v for v, _ in found), "missing": counts[f"k_{c}"]}
        every = PreparationModel(json.dumps(state)).expressions()
        if every:
            spread = train.select(*[e.alias(k) for k, e in every.items()]).agg(*[F.var_pop(f"`{k}`").alias(k) for k in every]).first()
            state["columns"] = [k for k in every if spread[k]]
        return PreparationModel(json.dumps(state))
