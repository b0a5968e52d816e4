"""Estimators: MLlib models behind folds and gates. Every fit takes a DataFrame with a vector column."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.operators.cells import by_cells, cell_predict, reads
from calibrant.operators.metrics import best_threshold, error_metrics, group_balanced_mae
from calibrant.sources.tables import cut

SEED = 17


def assemble(df: DataFrame, inputs: list[str], out: str = "features") -> DataFrame:
    """Numeric columns into one vector, null as 0."""
    safe = df.select("*", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"_x_{c}") for c in inputs])
    return VectorAssembler(inputCols=[f"_x_{c}" for c in inputs], outputCol=out).transform(safe).drop(*[f"_x_{c}" for c in inputs])


def candidates(target: str = "y", weight: str = "w") -> dict[str, object]:
    """The fixed grid. MLlib has no extremely randomised trees; a forest on small samples stands in."""
    kw = {"labelCol": target, "featuresCol": "features", "weightCol": weight, "seed": SEED}
    return {
        "gbt_absolute": GBTRegressor(lossType="absolute", maxIter=20, maxDepth=4, **kw),
        "gbt_squared": GBTRegressor(lossType="squared", maxIter=20, maxDepth=4, **kw),
        "forest": RandomForestRegressor(numTrees=30, maxDepth=8, **kw),
        "small_sample_forest": RandomForestRegressor(numTrees=30, maxDepth=8, subsamplingRate=0.3, **kw),
        "linear": LinearRegression(labelCol=target, featuresCol="features", weightCol=weight, regParam=0.01),
    }


def oof_predict(df: DataFrame, estimator, folds: int, fold: str = "fold") -> DataFrame:
    """Every row predicted once (p) by a model that didn't see its fold. Raises where a fold leaves nothing to fit.

    Trees are fitted on sums by cell of their binned features (:mod:`calibrant.operators.cells`), other estimators on the rows."""
    return oof_predict_each(df, {"": estimator}, folds, fold)[""]


def oof_predict_each(df: DataFrame, estimators: dict[str, object], folds: int, fold: str = "fold") -> dict[str, DataFrame]:
    """:func:`oof_predict` for each of ``estimators``. ``df`` is computed once, and trees that read the same columns share bins and cells."""
    df = cut(df, "oof")
    there = df.agg(*[F.bool_or(t).alias(f"{n}{f}") for f in range(folds) for n, t in (("own", F.col(fold) == f), ("other", F.col(fold) != f))]).first()
    used = [f for f in range(folds) if there[f"own{f}"]]
    for f in used:
        if not there[f"other{f}"]:
            raise ValueError(f"fold {f} leaves no rows to fit")
    shared: dict[tuple, dict] = {}
    out = {}
    for name, e in estimators.items():
        if by_cells(e):
            shared.setdefault(reads(e), {})[name] = e
        else:
            parts = [e.fit(df.where(F.col(fold) != f)).transform(df.where(F.col(fold) == f)).withColumnRenamed("prediction", "p") for f in used]
            out[name] = reduce(DataFrame.unionByName, parts)
    for alike in shared.values():
        out |= cell_predict(df, alike, used, fold)
    return out


def reference_residual(df: DataFrame, estimator_of, folds: int, y: str = "y", prior: str = "prior") -> DataFrame:
    """Rows with a prior: prior plus a predicted residual; others: an absolute model. ``estimator_of(target)``."""
    known = df.where(F.col(prior).isNotNull()).withColumn("_r", F.col(y) - F.col(prior))
    resid = oof_predict(known, estimator_of("_r"), folds).withColumn("p", F.col("p") + F.col(prior)).drop("_r")
    return resid.unionByName(oof_predict(df.where(F.col(prior).isNull()), estimator_of(y), folds), allowMissingColumns=True)


def supplement_gate(base: DataFrame, extra: DataFrame, estimator, folds: int, group: str | None = None) -> dict[str, float | bool]:
    """Does training on ``extra`` too worsen neither the plain nor the weighted error (with ``group``: the pooled and
    the group-balanced one) of the held-out base rows?"""
    both = base.withColumn("_own", F.lit(True)).unionByName(extra.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    out: dict[str, float | bool] = {}
    for name, df in (("without", base), ("with", both)):
        oof = oof_predict(df, estimator, folds)
        oof = oof if name == "without" else oof.where("_own")
        m = error_metrics(oof).first()
        second = group_balanced_mae(oof, group).first().balanced_mae if group else m.weighted_mae
        out |= {f"mae_{name}": m.mae, f"second_{name}": second}
    out["deploy"] = bool(out["mae_with"] <= out["mae_without"] and out["second_with"] <= out["second_without"])
    return out


def evidence_counts(group: str, label: str) -> list[Column]:
    """The aggregates behind the gate: rows, groups, classes."""
    return [F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups"), F.count_distinct(label).alias("classes")]


def enough_evidence(rows: int = 12, groups: int = 6, classes: int = 3) -> Column:
    """Enough of each."""
    return (F.col("rows") >= rows) & (F.col("groups") >= groups) & (F.col("classes") >= classes)


def evidence_gate(df: DataFrame, group: str, label: str, rows: int = 12, groups: int = 6, classes: int = 3) -> bool:
    """Enough rows, groups and classes before any fit."""
    return df.agg(*evidence_counts(group, label)).select(enough_evidence(rows, groups, classes)).first()[0]


def paired_difference(df: DataFrame, key: str, end: str, estimator, folds: int) -> DataFrame:
    """Key, dy, dp: held-out difference of the two endpoints (``end`` in a, b), both in one fold."""
    oof = oof_predict(df, estimator, folds).groupBy(key).pivot(end, ["a", "b"]).agg(F.first("y").alias("y"), F.first("p").alias("p"))
    return oof.select(key, (F.col("b_y") - F.col("a_y")).alias("dy"), (F.col("b_p") - F.col("a_p")).alias("dp"))


def rank_classifier(df: DataFrame, truth: str, folds: int) -> DataFrame:
    """Candidates with score, the held-out probability of being the true one."""
    oof = oof_predict(df, GBTClassifier(labelCol=truth, featuresCol="features", maxIter=15, maxDepth=4, seed=SEED), folds)
    return oof.withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "p")


def form_head(df: DataFrame, truth: str):
    """Scaled logistic regression with classes balanced by weight."""
    n = {r[0]: r[1] for r in df.groupBy(truth).count().collect()}  # two classes
    total = sum(n.values())
    balanced = df.withColumn("_bw", reduce(lambda c, kv: c.when(F.col(truth) == kv[0], total / (len(n) * kv[1])), n.items(), F.when(F.lit(False), 1.0)))
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="_scaled", withMean=True), LogisticRegression(featuresCol="_scaled", labelCol=truth, weightCol="_bw", maxIter=50)]).fit(balanced)


def _scaled(rows: DataFrame, heads: DataFrame, family: str, features: list[str]) -> DataFrame:
    """``rows`` with the head of their family (where there is one) and _z: one, then the features scaled by it (0 where they don't vary)."""
    z = [F.when(F.get("scales", F.lit(i)) > 0, (F.col(c).cast("double") - F.get("means", F.lit(i))) / F.get("scales", F.lit(i))).otherwise(0.0) for i, c in enumerate(features)]
    return rows.join(heads, family, "left").withColumn("_z", F.array(F.lit(1.0), *z))


def _probability(beta: str = "beta") -> Column:
    return 1 / (1 + F.exp(-F.aggregate(F.zip_with(beta, "_z", lambda b, z: b * z), F.lit(0.0), lambda t, x: t + x)))


def form_heads(df: DataFrame, family: str, truth: str, features: list[str], train: Column, min_rows: int = 30, penalty: float = 1.0, rounds: int = 25) -> DataFrame:
    """A head per family: family, rows, status, means, scales, beta (intercept first), threshold, margin, balanced_accuracy.

    All families are fitted at once: balanced logistic regression with scaled features and ``penalty`` times half the squared
    slopes, by Newton steps whose gradients and Hessians are sums by family. Each round reads the rows once and solves one small
    system per family; rounds end when no coefficient moves by 1e-10. The threshold (D26) is that with the best balanced accuracy on
    the rows that aren't ``train``; status says why a family has no head. Rows with a null family, truth (0 or 1) or feature don't count.
    """
    rows = df.select(family, F.col(truth).cast("int").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features], train.alias("_train")).dropna()
    rows = cut(rows.where(F.col("_y").isin(0, 1)), "head-rows")
    t, y = F.col("_train"), F.col("_y")
    n = lambda c: F.count_if(c)
    own = rows.groupBy(family).agg(
        F.count(F.lit(1)).alias("rows"), n(t & (y == 1)).alias("_p"), n(t & (y == 0)).alias("_n"), n(~t & (y == 1)).alias("_tp"), n(~t & (y == 0)).alias("_tn"),
        F.array(*[F.avg(F.when(t, F.col(c))) for c in features]).alias("means"), F.array(*[F.stddev_pop(F.when(t, F.col(c))) for c in features]).alias("scales"),
    )
    some = lambda a, b: (F.col(a) > 0) | (F.col(b) > 0)
    status = (
        F.when(F.col("rows") < min_rows, "skipped_low_rows").when((F.col("_p") + F.col("_tp") == 0) | (F.col("_n") + F.col("_tn") == 0), "skipped_single_class")
        .when(~some("_p", "_n") | ~some("_tp", "_tn"), "skipped_bad_split").when((F.col("_p") == 0) | (F.col("_n") == 0), "skipped_single_class_train")
        .when((F.col("_tp") == 0) | (F.col("_tn") == 0), "skipped_single_class_test").otherwise("trained")
    )
    told = cut(own.withColumn("status", status), "head-status")
    size = len(features) + 1
    weights = [((F.col("_p") + F.col("_n")) / (2 * F.col(c))).alias(name) for c, name in (("_p", "_wp"), ("_n", "_wn"))]
    heads = told.where("status = 'trained'").select(family, "means", "scales", *weights)
    beta = heads.select(family, F.array_repeat(F.lit(0.0), size).alias("beta"))
    upper = [(i, k) for i in range(size) for k in range(i, size)]
    kind = dict(rows.dtypes)[family]

    def solve(batches):
        for b in batches:
            step = []
            for old, g, h in zip(b["beta"], b["g"], b["h"]):
                hess, old = np.zeros((size, size)), np.asarray(old)
                for (i, k), v in zip(upper, h):
                    hess[i, k] = hess[k, i] = v
                slopes = np.r_[0.0, np.full(size - 1, penalty)]
                step.append(old - np.linalg.lstsq(hess + np.diag(slopes), np.asarray(g) + slopes * old, rcond=None)[0])
            yield pd.DataFrame({family: b[family], "beta": step, "moved": [float(np.abs(s - np.asarray(o)).max()) for s, o in zip(step, b["beta"])]})

    for _ in range(rounds):
        at = _scaled(rows.where("_train"), heads.join(beta, family), family, features).where("beta is not null").withColumn("_q", _probability())
        at = at.withColumn("_w", F.when(y == 1, F.col("_wp")).otherwise(F.col("_wn")))
        z = lambda i: F.get("_z", F.lit(i))
        g = F.array(*[F.sum(F.col("_w") * (F.col("_q") - y) * z(i)) for i in range(size)])
        h = F.array(*[F.sum(F.col("_w") * F.col("_q") * (1 - F.col("_q")) * z(i) * z(k)) for i, k in upper])
        sums = at.groupBy(family).agg(F.first("beta").alias("beta"), g.alias("g"), h.alias("h"))
        moved = cut(sums.mapInPandas(solve, f"`{family}` {kind}, beta array<double>, moved double"), "head-step")
        beta = moved.select(family, "beta")
        if (moved.agg(F.max("moved")).first()[0] or 0.0) < 1e-10:
            break
    scored = _scaled(rows.where("not _train"), heads.join(beta, family), family, features).where("beta is not null").withColumn("_score", _probability())
    best = best_threshold(scored, "_score", "_y", keys=(family,))
    margin = F.greatest(F.lit(0.05), F.least(F.lit(0.2), 0.5 * F.abs(F.col("threshold") - 0.5)))
    return told.select(family, "rows", "status", "means", "scales").join(beta, family, "left").join(best, family, "left").select(family, "rows", "status", "means", "scales", "beta", "threshold", margin.alias("margin"), "balanced_accuracy")


def apply_heads(df: DataFrame, heads: DataFrame, family: str, features: list[str]) -> DataFrame:
    """``df`` with probability and call (acid_form, base_form; ambiguous within the margin of the threshold) by the head of its
    family; null where that has none or a feature is null."""
    use = heads.where("status = 'trained'").select(family, "means", "scales", "beta", F.col("threshold").alias("_threshold"), F.col("margin").alias("_margin"))
    p = F.when(F.col("beta").isNotNull() & F.forall("_z", lambda z: z.isNotNull()), _probability())
    out = _scaled(df, use, family, features).withColumn("probability", p)
    near = F.abs(F.col("probability") - F.col("_threshold")) < F.col("_margin")
    call = F.when(near, "ambiguous").when(F.col("probability") >= F.col("_threshold"), "acid_form").when(F.col("probability").isNotNull(), "base_form")
    return out.withColumn("call", call).select(*df.columns, "probability", "call")


def delta_target(df: DataFrame, observed: str, baseline: str, is_complex: str) -> DataFrame:
    """delta = observed less baseline where the row is complex, else 0."""
    return df.withColumn("delta", F.when(F.col(is_complex), F.col(observed) - F.col(baseline)).otherwise(0.0))


def token_bits(df: DataFrame, tokens: str, n: int = 2, size: int = 512, out: str = "features") -> DataFrame:
    """Hashed n-gram bits of a token array."""
    grams = NGram(n=n, inputCol=tokens, outputCol="_grams").transform(df)
    return HashingTF(numFeatures=size, binary=True, inputCol="_grams", outputCol=out).transform(grams).drop("_grams")
