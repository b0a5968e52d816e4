"""Estimators that share a table of cells: bins and rows are made once, draws are sums, keys hold any number of features."""

import numpy as np
from calibrant.operators import cells
from calibrant.operators import models as md
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

KW = {"labelCol": "y", "featuresCol": "features", "weightCol": "w", "seed": 5}


def table(spark, n, features, values):
    rng = np.random.default_rng(7)
    x = rng.integers(0, values, (n, features))
    y = x[:, 0] - 2.0 * x[:, 1] + rng.normal(0, 0.5, n)
    names = [f"x{i}" for i in range(features)]
    rows = [(i, float(y[i]), float(1 + i % 3), i % 3, *map(float, x[i])) for i in range(n)]
    return md.assemble(spark.createDataFrame(rows, f"id int, y double, w double, fold int, {', '.join(f'{c} double' for c in names)}").repartition(3), names)


def test_estimators_share_bins_and_rows(spark, monkeypatch):
    df, calls, written = table(spark, 600, 2, 12), [], []
    starts, cut = cells.bin_starts, cells.cut
    monkeypatch.setattr(cells, "bin_starts", lambda *a: calls.append(a) or starts(*a))
    monkeypatch.setattr(cells, "cut", lambda t, label="cut", **k: written.append(label) or cut(t, label, **k))
    estimators = {"squared": GBTRegressor(maxIter=2, maxDepth=2, **KW), "absolute": GBTRegressor(lossType="absolute", maxIter=3, maxDepth=2, **KW), "forest": RandomForestRegressor(numTrees=3, maxDepth=3, **KW), "linear": md.candidates()["linear"]}
    got = {name: {r.id: r.p for r in t.collect()} for name, t in md.oof_predict_each(df, estimators, 3).items()}
    assert len(calls) == 1 and written.count("cell-rows") == written.count("cell-fit") == 1
    assert written.count("cell-signs") == 2 and written.count("cells-drawn") == 1  # a pass a round, and one for a forest, whatever the folds
    for name, e in estimators.items():
        alone = {r.id: r.p for r in md.oof_predict(df, e, 3).collect()}
        assert alone.keys() == got[name].keys() == set(range(600)) and max(abs(p - alone[i]) for i, p in got[name].items()) < 1e-9


def test_drawn_sums_are_those_of_the_draws(spark, monkeypatch):
    monkeypatch.setattr(cells, "DRAWS_AT_ONCE", 64)
    rows = [(i % 7, float(i % 11), 1.0 + i % 3) for i in range(1000)]
    fit = spark.createDataFrame(rows, "_cell long, _y double, _w double").withColumn("_key", F.xxhash64("_cell", "_y", "_w")).repartition(3)
    got = {(r[0], r[1]): (r._c, r._s) for r in cells._drawn(fit, 4, 0.3).collect()}
    own, want = fit.toPandas(), {}
    for tree in range(4):
        u = (cells._tree_bits(own["_key"].to_numpy().view(np.uint64), tree) >> np.uint64(11)) / float(1 << 53)
        upto = np.exp(-0.3) * np.cumsum([1, 0.3, 0.3**2 / 2, 0.3**3 / 6, 0.3**4 / 24, 0.3**5 / 120])
        k = np.searchsorted(upto, u, "right")
        for cell, n, y, w in zip(own["_cell"], k, own["_y"], own["_w"]):
            if n:
                c, s = want.get((cell, tree), (0.0, 0.0))
                want[cell, tree] = (c + n * w, s + n * w * y)
    assert got.keys() == want.keys() and len({k[1] for k in got}) == 4
    assert all(np.allclose(got[k], v) for k, v in want.items())


def test_cells_of_more_features_than_a_long_holds(spark):
    df = table(spark, 240, 15, 20)
    e = GBTRegressor(maxIter=2, maxDepth=2, **KW)
    want = {}
    for f in range(3):
        want |= {r.id: r.prediction for r in e.fit(df.where(F.col("fold") != f)).transform(df.where(F.col("fold") == f)).collect()}
    out = md.oof_predict_each(df, {"boosted": e, "forest": RandomForestRegressor(numTrees=2, maxDepth=2, **KW)}, 3)
    got = {r.id: r.p for r in out["boosted"].collect()}
    assert got.keys() == want.keys() and max(abs(p - want[i]) for i, p in got.items()) < 1e-9
    assert out["forest"].where("p is not null").count() == 240
