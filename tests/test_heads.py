"""Heads of all families at once: the fits are optima, statuses say why there is none."""

import numpy as np
from calibrant.operators import models as md
from pyspark.sql import functions as F


def test_heads_of_all_families(spark):
    rng = np.random.default_rng(6)
    rows, truth = [], {"a": (0.5, 2.0, -1.0), "b": (-2.0, 0.0, 3.0), "c": (4.0, 1.0, 0.0)}
    for f, b in truth.items():
        for i in range(240):
            x = rng.normal(3, 2, 2)
            y = int(rng.random() < 1 / (1 + np.exp(-(b[0] + b[1] * (x[0] - 3) + b[2] * (x[1] - 3)))))
            rows.append((f, y, float(x[0]), float(x[1]), 7.0, i % 4 != 0))
    rows += [("few", i % 2, 1.0, 1.0, 7.0, True) for i in range(5)] + [("one", 1, 1.0, 2.0, 7.0, i % 2 == 0) for i in range(40)]
    rows += [("all_train", i % 2, 1.0, 2.0, 7.0, True) for i in range(40)] + [("train_one", int(i % 2 == 0), 1.0, 2.0, 7.0, i % 2 == 0) for i in range(40)]
    rows += [("test_one", i % 2, 1.0, 2.0, 7.0, i % 4 != 1) for i in range(40)] + [(None, 1, 1.0, 1.0, 7.0, True), ("a", None, 1.0, 1.0, 7.0, True), ("a", 1, None, 1.0, 7.0, True), ("a", 5, 1.0, 1.0, 7.0, True)]
    df = spark.createDataFrame(rows, "f string, y int, u double, v double, fixed double, t boolean").repartition(3)
    features = ["u", "v", "fixed"]
    heads = md.form_heads(df, "f", "y", features, F.col("t"))
    got = {r.f: r for r in heads.collect()}
    assert {f: r.status for f, r in got.items()} == {"a": "trained", "b": "trained", "c": "trained", "few": "skipped_low_rows", "one": "skipped_single_class", "all_train": "skipped_bad_split", "train_one": "skipped_single_class_train", "test_one": "skipped_single_class_test"}
    scores = {}
    for f in truth:
        mine = [r for r in rows if r[0] == f and r[1] in (0, 1) and None not in r]
        x, y, t = np.array([r[2:5] for r in mine]), np.array([r[1] for r in mine]), np.array([r[5] for r in mine])
        scale = x[t].std(axis=0)
        z = np.c_[np.ones(len(x)), np.where(scale > 0, (x - x[t].mean(axis=0)) / np.where(scale > 0, scale, 1), 0)]
        q = 1 / (1 + np.exp(-z @ np.array(got[f].beta)))
        w = np.where(y == 1, t.sum() / 2 / (t & (y == 1)).sum(), t.sum() / 2 / (t & (y == 0)).sum())
        gradient = (z * (w * (q - y))[:, None])[t].sum(axis=0) + np.r_[0, np.array(got[f].beta)[1:]]
        assert np.abs(gradient).max() < 1e-6 and got[f].beta[3] == 0 and got[f].rows == len(mine)
        grid = [0.1 + 0.025 * i for i in range(33)]
        accuracy = [((q[~t] >= g - 1e-12)[y[~t] == 1].mean() + (q[~t] < g - 1e-12)[y[~t] == 0].mean()) / 2 for g in grid]
        assert abs(got[f].balanced_accuracy - max(accuracy)) < 1e-9 and abs(got[f].threshold - grid[int(np.argmax(np.round(accuracy, 12)))]) < 1e-9
        scores |= {(f, r[2], r[3]): p for r, p in zip(mine, q)}
    out = md.apply_heads(df, heads, "f", features).collect()
    assert len(out) == len(rows)
    for r in out:
        if (r.f, r.u, r.v) in scores:
            near = abs(r.probability - got[r.f].threshold) < got[r.f].margin
            assert abs(r.probability - scores[r.f, r.u, r.v]) < 1e-9 and r.call == ("ambiguous" if near else "acid_form" if r.probability >= got[r.f].threshold else "base_form")
        elif r.f not in truth:
            assert r.probability is None and r.call is None
    assert md.form_heads(df.limit(0), "f", "y", features, F.col("t")).count() == 0
