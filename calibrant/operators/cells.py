"""Tree ensembles fitted on cells.

MLlib's trees see a feature as one of ``maxBins`` bins, so rows in the same bins (a cell) are alike to every tree: their sums of
weights and of targets hold all that a split by variance asks for. Rows are read to make those sums; levels of trees and rounds
of boosting work on cells, of which there are no more than rows, and for few features no more at any number of rows.

The models of all folds are fitted from one table of cells, as bins and so cells are each model's own: a cell's key tells its
model. A row is a row to fit on for each model but that of its fold, which predicts it. Estimators that read the same columns share that table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calibrant.operators import ranks
from calibrant.sources.tables import cut

AT_ONCE = 8  # fits on cells that run side by side
MOST_BINS = 1024  # MLlib samples its input above the square of maxBins
ROWS_AT_ONCE = 1 << 20  # rows whose draws a task sums before it hands them on
DRAWS_AT_ONCE = 1 << 15  # draws that stay in a processor's cache


def by_cells(estimator) -> bool:
    """Do sums by cell hold all that ``estimator`` asks of the rows?"""
    if not isinstance(estimator, (GBTClassifier, GBTRegressor, RandomForestRegressor)) or estimator.getMinInstancesPerNode() != 1:
        return False
    return isinstance(estimator, RandomForestRegressor) and estimator.getBootstrap() or not isinstance(estimator, RandomForestRegressor) and estimator.getSubsamplingRate() == 1 and not estimator.isDefined("validationIndicatorCol")


def bin_starts(rows: DataFrame, folds: list[int], fold: str, bins: int) -> dict[int, list[list[float]]]:
    """For each fold and feature the values at which the second and later bins start, from the rows (fold, _x, _w) of the other
    folds: a bin for each value if these are no more than ``bins``, else bins of equal weight. Exact, whatever the partitions."""
    seen = rows.select(fold, "_w", F.posexplode("_x").alias("i", "v")).groupBy(fold, "i", "v").agg(F.sum("_w").alias("c")).where("c > 0")
    models = F.explode(F.array(*[F.lit(f) for f in folds])).alias("f")
    own = cut(seen.select(models, fold, "i", "v", "c").where(F.col(fold) != F.col("f")).groupBy("f", "i", "v").agg(F.sum("c").alias("c")), "bin-values")
    values = own.groupBy("f", "i").agg((F.count(F.lit(1)) <= bins).alias("few"))
    t = ranks.cumulative(own, ["f", "i"], ["v"], ["c"]).join(F.broadcast(values), ["f", "i"])  # a row per fold and feature
    at = F.when(F.col("few"), F.col("upto_c")).otherwise(F.floor(bins * (F.col("upto_c") - F.col("c")) / F.col("n_c")))
    starts = t.groupBy("f", "i", at.alias("at")).agg(F.min("v").alias("v")).groupBy("f", "i").agg(F.sort_array(F.collect_list("v")).alias("starts"))
    got = {(r.f, r.i): [v for v in r.starts[1:] if v == v] for r in starts.collect()}
    return {f: [got[f, i] for i in range(1 + max(i for _, i in got))] for f in folds}


def _code(bins: list[Column], sizes: list[int]) -> Column:
    """One key of ``bins``, each below its size: a number where that fits a long, else text."""
    if math.prod(sizes) < 1 << 62:
        return sum((b.cast("long") * math.prod(sizes[i + 1 :]) for i, b in enumerate(bins)), F.lit(0).cast("long"))
    return F.concat_ws(",", *[b.cast("int").cast("string") for b in bins])


def _bins_of(code: str, sizes: list[int]) -> list[Column]:
    """The bins that :func:`_code` made ``code`` of."""
    if math.prod(sizes) < 1 << 62:
        return [F.expr(f"cast({code} div {math.prod(sizes[i + 1 :])}L % {n}L as int)") for i, n in enumerate(sizes)]
    return [F.split_part(code, F.lit(","), F.lit(i + 1)).cast("int") for i in range(len(sizes))]


def _coded(rows: DataFrame, starts: dict[int, list[list[float]]], sizes: list[int], folds: list[int]) -> tuple[DataFrame, list[Column]]:
    """``rows`` with the bins of each feature of _x, and the cell of each model; NaN has a bin of its own."""
    features = range(len(sizes) - 1)
    some = [(f, i) for f in folds for i in features if starts[f][i]]
    out = rows.select("*", *[F.get("_x", F.lit(i)).alias(f"_v{i}") for i in features])
    if some:
        splits = [[-math.inf, *starts[f][i], math.inf] for f, i in some]
        out = Bucketizer(inputCols=[f"_v{i}" for _, i in some], outputCols=[f"_u{f}_{i}" for f, i in some], splitsArray=splits, handleInvalid="keep").transform(out)
    return out, [_code([F.lit(m), *[F.col(f"_u{f}_{i}") if starts[f][i] else F.lit(0) for i in features]], sizes) for m, f in enumerate(folds)]


def _ready(estimator, cells: int, **columns):
    """``estimator`` for rows that are cells: every bin is seen, whatever their number."""
    most = max(estimator.getMaxBins(), min(MOST_BINS, math.isqrt(cells) + 1))
    return estimator.copy({getattr(estimator, k): v for k, v in ({"featuresCol": "_f", "labelCol": "_t", "weightCol": "_c", "maxBins": most} | columns).items()})


@lru_cache
def _thresholds(rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Where the Poisson counts from 1 on start in [0, 1), and the count of each 4096th of it, or -1 where two meet in one."""
    p, upto = math.exp(-rate), [0.0]
    while upto[-1] + p > upto[-1] and upto[-1] + p < 1:
        upto.append(upto[-1] + p)
        p *= rate / (len(upto) - 1)
    at, edges = np.asarray(upto[1:]), np.arange(4097) / 4096
    low, high = np.searchsorted(at, edges[:-1], "right"), np.searchsorted(at, edges[1:], "left")
    return at, np.where(low == high, low, -1).astype(np.int8)


def drawn_counts(bits: np.ndarray, rate: float) -> np.ndarray:
    """Poisson counts by the higher of 64 random ``bits``."""
    at, table = _thresholds(rate)
    counts = table[bits >> np.uint64(52)]
    unsure = np.flatnonzero(counts < 0)
    counts[unsure] = np.searchsorted(at, (bits[unsure] >> np.uint64(11)) / float(1 << 53), "right")
    return counts


def _tree_bits(keys: np.ndarray, tree: int) -> np.ndarray:
    """Other random bits for each tree, of ``keys`` that are random bits; the higher ones are well mixed (as in splitmix64)."""
    x = keys + np.uint64(0x9E3779B97F4A7C15 * (tree + 1) & (1 << 64) - 1)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x


def poisson(rows: DataFrame, key: str, rate: float, out: str) -> DataFrame:
    """``rows`` with ``out``, a Poisson count drawn by the bits of the long ``key``."""

    @F.pandas_udf("int")
    def counts(bits: pd.Series) -> pd.Series:
        return pd.Series(drawn_counts(bits.to_numpy(np.int64).view(np.uint64), rate).astype(np.int32))

    return rows.withColumn(out, counts(key))


def _drawn(fit: DataFrame, trees: int, rate: float) -> DataFrame:
    """_cell, _tree, _c and _s: the sums of weights and of targets of the rows that each tree draws, by cell. A task sums ROWS_AT_ONCE rows
    at a time, tree by tree, so that draws are never rows."""
    kind = dict(fit.dtypes)["_cell"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= ROWS_AT_ONCE:
                yield from summed(held)
                held, n = [], 0
        if n:
            yield from summed(held)

    def summed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts)
        coded = t.column("_cell").combine_chunks().dictionary_encode()
        code, cells = coded.indices.to_numpy(), coded.dictionary
        y, w, key = (t.column(c).to_numpy() for c in ("_y", "_w", "_key"))
        wy, key = w * y, key.view(np.uint64)
        for tree in range(trees):
            c, s = np.zeros(len(cells)), np.zeros(len(cells))
            for i in range(0, len(code), DRAWS_AT_ONCE):
                of = slice(i, i + DRAWS_AT_ONCE)
                k = drawn_counts(_tree_bits(key[of], tree), rate)
                c += np.bincount(code[of], k * w[of], len(cells))
                s += np.bincount(code[of], k * wy[of], len(cells))
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([cells.take(pa.array(some)), pa.array(np.full(len(some), tree, np.int32)), pa.array(c[some]), pa.array(s[some])], ["_cell", "_tree", "_c", "_s"])

    each = fit.select("_cell", "_y", "_w", "_key").mapInArrow(run, f"_cell {kind}, _tree int, _c double, _s double")
    return each.groupBy("_cell", "_tree").agg(F.sum("_c").alias("_c"), F.sum("_s").alias("_s"))


def _of(cells: DataFrame, model: int) -> DataFrame:
    return cells.where(F.col("_model") == model)


def _boosted(estimator, fit: DataFrame, cells: DataFrame, models: range) -> DataFrame:
    """Squared errors and two classes: MLlib's boosting, with a row per cell (and class). Residuals are those of the mean."""
    seen = cells.where("_c > 0")
    if isinstance(estimator, GBTClassifier):
        by = fit.groupBy("_cell", F.col("_y").alias("_t")).agg(F.sum("_w").alias("_c"))
        seen = cut(by.join(cells.select("_cell", "_model", "_f"), "_cell"), "cells")

    def predicted(m: int) -> DataFrame:
        own = _of(seen, m)
        return _ready(estimator, own.count()).fit(own).transform(_of(cells, m).select("_cell", "_f"))

    return reduce(DataFrame.unionByName, _side_by_side(predicted, models, cells))


def _boosted_absolute(estimator, fit: DataFrame, cells: DataFrame, models: range) -> DataFrame:
    """Absolute errors: as MLlib does, a tree on the target, then trees on the signs of the residuals, times the step. The signs need the
    rows: one pass a round for the models of all folds, with the cell's prediction so far."""
    sizes = {r[0]: r[1] for r in cells.where("_c > 0").groupBy("_model").count().collect()}
    shared = {k: estimator.getOrDefault(k) for k in ("maxDepth", "maxBins", "minInfoGain", "minWeightFractionPerNode", "maxMemoryInMB")}
    so_far, now = None, cells.where("_c > 0")
    for i in range(estimator.getMaxIter()):
        if i:
            sign = F.when(F.col("_y") < F.col("prediction"), -F.col("_w")).otherwise(F.col("_w"))
            signs = fit.join(so_far.select("_cell", "prediction"), "_cell").groupBy("_cell").agg(F.sum("_w").alias("_c"), F.sum(sign).alias("_s"))
            now = cut(signs.withColumn("_t", F.col("_s") / F.col("_c")).join(cells.select("_cell", "_model", "_f"), "_cell"), "cell-signs")
        trees = _side_by_side(lambda m: _ready(DecisionTreeRegressor(seed=estimator.getSeed() + i, **shared), sizes[m], predictionCol="_p").fit(_of(now, m)), models, cells)  # noqa: B023
        if so_far is None:
            parts = [tree.transform(_of(cells, m).select("_cell", "_model", "_f")).withColumnRenamed("_p", "prediction") for m, tree in zip(models, trees)]
        else:
            parts = [tree.transform(_of(so_far, m)).withColumn("prediction", F.col("prediction") + estimator.getStepSize() * F.col("_p")).drop("_p") for m, tree in zip(models, trees)]
        so_far = cut(reduce(DataFrame.unionByName, parts), "cell-predictions")
    return so_far


def _forest(estimator, fit: DataFrame, cells: DataFrame, models: range) -> DataFrame:
    """A forest whose trees draw rows with replacement: a Poisson count per row and tree, from a hash of the row's values (rows alike in all
    columns are drawn together), summed by tree and cell. Each tree then takes its features per node as in MLlib."""
    trees = estimator.getNumTrees()
    sums = _drawn(fit, trees, estimator.getSubsamplingRate()).withColumn("_t", F.col("_s") / F.col("_c"))
    placed = sums.join(cells.select("_cell", "_model", "_f"), "_cell").select("_model", "_tree", "_cell", "_f", "_c", "_t")
    drawn = cut(placed.repartitionByRange("_model", "_tree", "_cell"), "cells-drawn", by=("_model", "_tree"))
    sizes = {(r[0], r[1]): r[2] for r in drawn.groupBy("_model", "_tree").count().collect()}  # a row per tree; one that draws nothing is left out, as nothing can be fitted
    subset = estimator.getFeatureSubsetStrategy()
    subset = ("onethird" if trees > 1 else "all") if subset == "auto" else subset

    def fitted(of: tuple[int, int]):
        m, i = of
        one = _ready(estimator, sizes[of], numTrees=1, bootstrap=False, subsamplingRate=1.0, featureSubsetStrategy=subset, seed=estimator.getSeed() + i, predictionCol=f"_p{i}")
        return one.fit(_of(drawn, m).where(F.col("_tree") == i).select("_f", "_t", "_c"))

    grown = dict(zip(sorted(sizes), _side_by_side(fitted, sorted(sizes), cells)))

    def predicted(m: int) -> DataFrame:
        out, own = _of(cells, m).select("_cell", "_f"), [i for n, i in sorted(sizes) if n == m]
        for i in own:
            out = grown[m, i].transform(out)
        return out.select("_cell", (sum((F.col(f"_p{i}") for i in own), F.lit(0.0)) / len(own)).alias("prediction"))

    return reduce(DataFrame.unionByName, map(predicted, models))


def _side_by_side(run, items, df: DataFrame) -> list:
    with ThreadPool(min(AT_ONCE, len(items))) as pool:
        return pool.map(inheritable_thread_target(df.sparkSession)(run), items)


def reads(estimator) -> tuple:
    """What estimators that can share a table of cells agree in: target, weight, features, bins."""
    weight = estimator.getWeightCol() if estimator.isDefined("weightCol") else None
    return estimator.getLabelCol(), weight or None, estimator.getFeaturesCol(), estimator.getMaxBins()


def cell_predict(df: DataFrame, estimators: dict[str, object], folds: list[int], fold: str) -> dict[str, DataFrame]:
    """For each of ``estimators``, alike in what they read (:func:`reads`), ``df`` with the columns that it, fitted on the rows of the
    other folds, gives those of each of ``folds`` (prediction as p). ``df`` is read several times. Rows to fit on with a null or NaN
    target, or a null or negative weight, raise."""
    col = lambda c: F.col(f"`{c}`")
    (label, weight, features, bins), models = reads(next(iter(estimators.values()))), range(len(folds))
    y, w = col(label).cast("double"), col(weight).cast("double") if weight else F.lit(1.0)
    w = F.when(w.isNull() | F.isnan(w) | (w < 0), F.raise_error(F.lit("a weight is null, NaN or negative"))).otherwise(w)
    x = vector_to_array(col(features)).alias("_x")
    plain = [c for c, kind in df.dtypes if c != features and "map<" not in kind]
    starts = bin_starts(df.select(fold, w.alias("_w"), x), folds, fold, bins)
    sizes = [len(folds), *[max(len(s) for s in each) + 2 for each in zip(*starts.values())]]
    base = df.where(col(fold).isNotNull()).select(*map(col, df.columns), x, y.alias("_y"), w.alias("_w"))
    coded, of = _coded(base, starts, sizes, folds)
    own = reduce(lambda c, m: c.when(col(fold) == folds[m], of[m]), models, F)
    others = F.array_compact(F.array(*[F.when(col(fold) != folds[m], of[m]) for m in models]))
    rows = cut(coded.select(*map(col, df.columns), "_y", "_w", F.xxhash64(*map(col, plain), "_x").alias("_key"), own.alias("_own"), others.alias("_others")), "cell-rows")
    y = F.when(F.col("_y").isNull() | F.isnan("_y"), F.raise_error(F.lit("a target is null or NaN"))).otherwise(F.col("_y"))
    fit = cut(rows.select(F.explode("_others").alias("_cell"), y.alias("_y"), "_w", "_key").where("_w > 0"), "cell-fit")
    asked = rows.where("_own is not null").select(F.col("_own").alias("_cell"), F.lit(None).cast("double").alias("_w"), F.lit(None).cast("double").alias("_s"))
    sums = fit.select("_cell", "_w", (F.col("_w") * F.col("_y")).alias("_s")).unionByName(asked).groupBy("_cell").agg(F.sum("_w").alias("_c"), F.sum("_s").alias("_s"))
    names = [f"_b{i}" for i in range(len(sizes) - 1)]
    told = sums.select("_cell", *[c.alias(n) for c, n in zip(_bins_of("_cell", sizes), ["_model", *names])], "_c", F.try_divide("_s", "_c").alias("_t"))
    cells = cut(VectorAssembler(inputCols=names, outputCol="_f").transform(told).drop(*names), "cells")

    def predicted(name: str) -> DataFrame:
        e = estimators[name]
        how = _forest if isinstance(e, RandomForestRegressor) else _boosted_absolute if isinstance(e, GBTRegressor) and e.getLossType() == "absolute" else _boosted
        gives = ["rawPrediction", "probability"] if isinstance(e, GBTClassifier) else []
        scores = cut(how(e, fit, cells, models).select("_cell", *gives, F.col("prediction").alias("p")), "cell-scores")
        return rows.join(scores, F.col("_own") == F.col("_cell")).select(*map(col, df.columns), *gives, "p")

    return dict(zip(estimators, _side_by_side(predicted, list(estimators), df)))
