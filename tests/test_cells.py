"""Trees fitted on cells: MLlib's own predictions where features have few values, the same ones for any partitions, few rows to fit on."""

import numpy as np
import pytest
from calibrant.operators import cells
from calibrant.operators import models as md
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

KIND = "id int, a double, b double, y double, w double, t int, fold int"


def rows_of(n, values):
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, values, n) / 8, rng.normal(0, 1, n).round(1 if values < 100 else 6)
    b = np.clip(b, -1, 1)
    y = 3 * a - 2 * b * (a > 1) + rng.normal(0, 0.5, n)
    return [(i, float(a[i]), float(b[i]), float(y[i]), float(1 + i % 3), int(y[i] + rng.normal() > 4), i % 2) for i in range(n)]


def wanted(df, estimator):
    out = {}
    for f in (0, 1):
        out |= {r.id: r for r in estimator.fit(df.where(F.col("fold") != f)).transform(df.where(F.col("fold") == f)).collect()}
    return out


@pytest.mark.parametrize("loss", ["squared", "absolute", "classes"])
def test_boosting_on_cells_is_that_on_rows(spark, loss):
    df = md.assemble(spark.createDataFrame(rows_of(900, 20), KIND).repartition(3), ["a", "b"])
    if loss == "classes":
        estimator = GBTClassifier(labelCol="t", featuresCol="features", maxIter=4, maxDepth=3, seed=5)
    else:
        estimator = GBTRegressor(lossType=loss, labelCol="y", featuresCol="features", weightCol="w", maxIter=5, maxDepth=3, seed=5)
    got, want = {r.id: r for r in md.oof_predict(df, estimator, 2).collect()}, wanted(df, estimator)
    assert len(got) == len(want) == 900
    for i, r in want.items():
        assert abs(got[i].p - r.prediction) < 1e-9 and got[i].y == r.y
        if loss == "classes":
            assert np.abs(got[i].probability.toArray() - r.probability.toArray()).max() < 1e-9
    assert got.keys() == want.keys()


def test_predictions_do_not_depend_on_partitions_and_fits_see_cells(spark, monkeypatch):
    df = md.assemble(spark.createDataFrame(rows_of(24_000, 1000), KIND), ["a", "b"])
    sizes, fit = [], GBTRegressor.fit
    monkeypatch.setattr(GBTRegressor, "fit", lambda self, d, *a: sizes.append(d.count()) or fit(self, d, *a))
    for estimator in (GBTRegressor(labelCol="y", featuresCol="features", weightCol="w", maxIter=3, maxDepth=3, seed=5), RandomForestRegressor(labelCol="y", featuresCol="features", weightCol="w", numTrees=3, maxDepth=4, seed=5)):
        seen = [{r.id: r.p for r in md.oof_predict(df.repartition(n), estimator, 2).collect()} for n in (2, 5)]
        assert seen[0].keys() == seen[1].keys() and len(seen[0]) == 24_000
        assert max(abs(p - seen[1][i]) for i, p in seen[0].items()) < 1e-9
    assert sizes and max(sizes) <= 32 * 32


def test_forest_on_cells_predicts_as_well_as_on_rows(spark):
    df = md.assemble(spark.createDataFrame(rows_of(3000, 20), KIND), ["a", "b"])
    for rate in (1.0, 0.3):
        estimator = RandomForestRegressor(labelCol="y", featuresCol="features", weightCol="w", numTrees=20, maxDepth=5, subsamplingRate=rate, seed=5)
        error = lambda rows, p: np.mean([abs(r.y - r[p]) for r in rows])
        got, want = error(md.oof_predict(df, estimator, 2).collect(), "p"), error(wanted(df, estimator).values(), "prediction")
        assert abs(got - want) < 0.1 * want


def test_draws_are_poisson(spark):
    df = cells.poisson(spark.range(40_000).select(F.xxhash64("id").alias("h")), "h", 0.3, "k")
    got = df.agg(F.avg("k").alias("m"), F.var_samp("k").alias("v"), F.min("k").alias("low")).first()
    assert abs(got.m - 0.3) < 0.015 and abs(got.v - 0.3) < 0.02 and got.low == 0


def test_odd_targets_and_features(spark):
    rows = [*rows_of(200, 20), (900, None, 0.0, 1.0, 1.0, 0, 0), (901, 1.0, -0.0, 1.0, 0.0, 0, 1)]
    estimator = GBTRegressor(labelCol="y", featuresCol="features", weightCol="w", maxIter=2, maxDepth=2, seed=5)
    got = md.oof_predict(md.assemble(spark.createDataFrame(rows, KIND), ["a", "b"]), estimator, 2).collect()
    assert sorted(r.id for r in got) == [*range(200), 900, 901]
    flat = md.assemble(spark.createDataFrame([(i, 1.0, 1.0, float(i), 1.0, 0, i % 2) for i in range(10)], KIND), ["a", "b"])
    assert {(r.fold, r.p) for r in md.oof_predict(flat, estimator, 2).collect()} == {(0, 5.0), (1, 4.0)}
    with pytest.raises(Exception, match="target is null"):
        md.oof_predict(md.assemble(spark.createDataFrame([*rows_of(50, 20), (99, 1.0, 1.0, None, 1.0, 0, 0)], KIND), ["a", "b"]), estimator, 2).collect()
