"""A saved preparation scores rows of another source as the fitted one does, and as a plain version."""

from __future__ import annotations

import statistics

import pytest

from tidewell.operators import modelling
from tidewell.operators.preparation import Preparation, PreparationModel
from tidewell.sources.files import scratch

TRAIN = [(1, 1.0, None, "a", 5.0), (2, None, None, "b", 5.0), (3, 7.0, None, "b", 5.0), (4, 2.5, None, None, 5.0), (5, 4.0, None, "a", 5.0)]
OTHER = [(9, None, 3.0, "new", None), (10, 8.0, None, None, 6.0), (11, None, None, "a", 5.0)]
SCHEMA = "id long, size double, empty double, kind string, fixed double"


def test_saved_and_loaded(spark):
    train, other = (spark.createDataFrame(r, SCHEMA) for r in (TRAIN, OTHER))
    model = Preparation(numeric=["size", "empty", "fixed"], categorical=["kind"]).fit(train)
    path = scratch(spark, "prep")
    model.save(path)
    loaded = PreparationModel.load(path)
    assert loaded.columns == model.columns == ["x_size", "x_size_missing", "x_kind_a", "x_kind_b"]  # empty has no value, fixed doesn't vary
    got = {r.id: tuple(r[c] for c in loaded.columns) for r in loaded.transform(other).collect()}
    middle = statistics.median(r[1] for r in TRAIN if r[1] is not None)
    assert got == {9: (middle, 1.0, 0.0, 0.0), 10: (8.0, 0.0, 1.0, 0.0), 11: (middle, 1.0, 1.0, 0.0)}  # an unseen level has zeros, a null one is the mode, the first on a tie
    stats = {r["item"]: r for r in loaded.statistics(spark).collect()}
    assert (stats["size"].median, stats["size"].missing, stats["empty"].median, stats["kind"]["mode"], stats["kind"].levels, stats["kind"].rows) == (middle, 1, None, "a", 2, 5)


def test_same_as_preparing_at_once(spark):
    train, other = (spark.createDataFrame(r, SCHEMA) for r in (TRAIN, OTHER))
    rows, names = modelling.prepare(train, other, ["size", "empty", "fixed"], ["kind"])
    model = Preparation(numeric=["size", "empty", "fixed"], categorical=["kind"]).fit(train)
    assert sorted(names) == sorted(model.columns)
    assert {tuple(r[c] for c in sorted(names)) for r in rows.collect()} == {tuple(r[c] for c in sorted(names)) for r in model.transform(other).collect()}


def test_keys_and_empty_rows(spark):
    train = spark.createDataFrame(TRAIN, SCHEMA)
    with pytest.raises(ValueError):
        Preparation(categorical=["kind"], max_levels=1).fit(train)
    nothing = Preparation(numeric=["size"], categorical=["kind"]).fit(train.where("false"))
    assert nothing.columns == [] and nothing.transform(train).columns == train.columns
