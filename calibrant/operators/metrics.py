"""Error metrics, calibration and folds.

A prediction row has y, p and, where weights count, w. Empty inputs give the defined empty result of each
operator (counts 0, measures null).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.functions.scalars import seed_of
from calibrant.operators import ranks
from calibrant.operators.states import let
from calibrant.sources.tables import cut


def _err() -> Column:
    return F.abs(F.col("y") - F.col("p"))


def metric_columns(weight: str | None = "w") -> list[Column]:
    """The sums behind :func:`error_metrics`; r2 from sums, so one pass is enough."""
    y, p, e = F.col("y"), F.col("p"), _err()
    w = F.col(weight) if weight else F.lit(1.0)
    sse, n = F.sum(e * e), F.count(F.lit(1))
    sst = F.sum(y * y) - F.sum(y) * F.sum(y) / n
    wsst = F.sum(w * y * y) - F.sum(w * y) * F.sum(w * y) / F.sum(w)
    return [
        n.alias("rows"), F.avg(e).alias("mae"), (F.sum(w * e) / F.sum(w)).alias("weighted_mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.sqrt(F.sum(w * e * e) / F.sum(w)).alias("weighted_rmse"),
        F.when(sst > 0, 1 - sse / sst).alias("r2"), F.when(wsst > 0, 1 - F.sum(w * e * e) / wsst).alias("weighted_r2"), F.avg(p - y).alias("bias"),
        F.max(e).alias("max_abs_error"),
        *[F.count_if(e > k).alias(f"over_{k}") for k in (2, 3, 5)],
    ]


def error_metrics(df: DataFrame, *keys: str, weight: str | None = "w") -> DataFrame:
    """Metrics of all rows, or of each cohort of ``keys``."""
    sums = df.groupBy(*keys).agg(*metric_columns(weight))
    q = ranks.quantiles(df.select(*keys, _err().alias("_e")), list(keys), "_e", {"median_abs_error": 0.5, "p90_abs_error": 0.9, "p95_abs_error": 0.95})
    return ranks.beside(sums, q, list(keys))


def error_strata(df: DataFrame, family: str, label: str) -> DataFrame:
    """Rows, mae, median, p90, p95 of everything, each family and each label. Equal errors of a family and label are
    counted before they are listed under the three."""
    by = df.groupBy(F.col(family).alias("_f"), F.col(label).alias("_l"), _err().alias("e")).agg(F.count(F.lit(1)).alias("c"))
    scopes = F.array(*[F.struct(F.lit(s).alias("scope"), F.coalesce(v, F.lit("")).alias("stratum")) for s, v in (("global", F.lit("")), ("family", F.col("_f")), ("label", F.col("_l")))])
    keys = ["scope", "stratum"]
    each = by.select(F.explode(scopes).alias("s"), "e", "c").groupBy("s.scope", "s.stratum", "e").agg(F.sum("c").alias("c"))
    t = ranks.cumulative(each, keys, ["e"], ["c"])
    return t.groupBy(*keys).agg(F.sum("c").alias("rows"), (F.sum(F.col("e") * F.col("c")) / F.sum("c")).alias("mae"), *[ranks.interpolated("e", "upto_c", "n_c", q).alias(n) for n, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95))])


def composite_heldout(protocols: dict[str, DataFrame], family: str, label: str) -> DataFrame:
    """:func:`error_strata` of each protocol's held-out rows and of their union ("combined"), with protocol. Each
    table has family, label, y and p; a row held out under two protocols counts once in each and twice in the union."""
    named = [df.select(family, label, "y", "p").withColumn("protocol", F.lit(name)) for name, df in protocols.items()]
    out = None
    for name, df in [*protocols.items(), ("combined", None)]:
        rows = df if df is not None else named[0]
        if df is None:
            for other in named[1:]:
                rows = rows.unionByName(other)
        part = error_strata(rows, family, label).select(F.lit(name).alias("protocol"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def group_balanced_mae(df: DataFrame, group: str) -> DataFrame:
    """Mean of the groups' means."""
    return df.groupBy(group).agg(F.avg(_err()).alias("m")).agg(F.count(F.lit(1)).alias("groups"), F.avg("m").alias("balanced_mae"))


def conformal_radius(df: DataFrame, key: str, levels: tuple[float, ...] = (0.5, 0.8, 0.9, 0.95)) -> DataFrame:
    """Key, level, radius (the k-th smallest error, k = min(n, ceil((n + 1) level))) and its empirical coverage.

    Equal errors are counted before they are ordered.
    """
    by = df.select(key, _err().alias("e")).groupBy(key, "e").agg(F.count(F.lit(1)).alias("c"))
    cum = ranks.cumulative(by, [key], ["e"], ["c"]).select(key, "e", F.col("upto_c").alias("upto"), F.col("n_c").alias("n"))
    lv = F.explode(F.array(*[F.lit(x) for x in levels]))
    k = F.least(F.col("n"), F.ceil(F.round((F.col("n") + 1) * F.col("level"), 9)))
    t = cum.withColumn("level", lv).where(F.col("upto") >= k)
    return t.groupBy(key, "level").agg(F.min("e").alias("radius"), (F.min("upto") / F.first("n")).alias("coverage"))


#: Cumulative Poisson(1) probabilities (fixed values).
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)


def _replicates(sums: DataFrame, group: str, gains: list[str], replicates: int, *keys: str) -> DataFrame:
    """keys, b and the mean of each gain (sums over n) when whole groups are drawn again, for each replicate b.

    A group's sums are weighted by a Poisson(1) count per replicate, drawn from a hash of group and
    replicate: any partitioning gives the same draws, and sums are all that is shuffled. (A multinomial draw would need
    all groups in one place.) A replicate that draws no group has no gain.
    """
    b = sums.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.col(group).cast("string"), F.col("b").cast("string")), 256), 1, 12), 16, 10).cast("double") / float(1 << 48)
    m = sum((F.when(u >= c, 1).otherwise(0) for c in POISSON[1:]), F.when(u >= POISSON[0], 1).otherwise(0))
    return b.withColumn("m", m).groupBy(*keys, "b").agg(*[F.try_divide(F.sum(F.col("m") * F.col(g)), F.sum(F.col("m") * F.col("n"))).alias(g) for g in gains])


def group_bootstrap(df: DataFrame, group: str, replicates: int = 200) -> DataFrame:
    """p05, p50, p95 of the gain in MAE of p over q when whole groups are drawn again, and P(gain > 0)."""
    sums = df.groupBy(group).agg(F.sum(F.abs(F.col("y") - F.col("q")) - F.abs(F.col("y") - F.col("p"))).alias("gain"), F.count(F.lit(1)).alias("n"))
    each = _replicates(sums, group, ["gain"], replicates)
    q = F.percentile("gain", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))  # a row per replicate
    return each.agg(q.alias("q"), F.avg((F.col("gain") > 0).cast("double")).alias("p_gain")).select(F.col("q")[0].alias("p05"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p95"), "p_gain")


def calibration_gate(df: DataFrame, key: str, group: str, replicates: int = 200) -> DataFrame:
    """Per key the point gains over zero and over the baseline q, their 5 % bootstrap bounds over groups (as
    :func:`group_bootstrap` draws them), bias, correlation (three rows or more and spread on both sides), and the scale:
    1 when both bounds are positive, 0.5 when both gains are, else 0."""
    e, z, c = _err(), F.abs("y"), F.abs(F.col("y") - F.col("q"))
    t = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(group).alias("groups"), (F.avg(z) - F.avg(e)).alias("gain_zero"), (F.avg(c) - F.avg(e)).alias("gain_baseline"), F.avg(F.col("p") - F.col("y")).alias("bias"),
        F.when((F.count(F.lit(1)) >= 3) & (F.stddev_pop("y") > 0) & (F.stddev_pop("p") > 0), F.corr("y", "p")).alias("correlation"),
    )
    sums = df.groupBy(key, group).agg(F.sum(z - e).alias("zero"), F.sum(c - e).alias("base"), F.count(F.lit(1)).alias("n"))
    drawn = _replicates(sums, group, ["zero", "base"], replicates, key).groupBy(key).agg(F.percentile("zero", F.lit(0.05)).alias("p05_zero"), F.percentile("base", F.lit(0.05)).alias("p05_baseline"))
    t = ranks.beside(t, drawn, [key])
    return t.withColumn("scale", F.when((F.col("p05_zero") > 0) & (F.col("p05_baseline") > 0), 1.0).when((F.col("gain_zero") > 0) & (F.col("gain_baseline") > 0), 0.5).otherwise(0.0))


def censored_score(df: DataFrame, *keys: str) -> DataFrame:
    """Exact rows by error; bounds by satisfaction and violation. qualifier in exact, approximate, lower_bound,
    upper_bound."""
    q, e = F.col("qualifier"), _err()
    low, high = q == "lower_bound", q == "upper_bound"
    ok = F.when(low, F.col("p") > F.col("y")).when(high, F.col("p") < F.col("y"))
    over = F.when(low, F.greatest(F.lit(0.0), F.col("y") - F.col("p"))).when(high, F.greatest(F.lit(0.0), F.col("p") - F.col("y")))
    return df.groupBy(*keys).agg(
        F.count_if(q == "exact").alias("n_exact"), F.avg(F.when(q == "exact", e)).alias("exact_mae"), F.avg(F.when(q == "approximate", e)).alias("approximate_mae"),
        F.avg(ok.cast("double")).alias("bounds_satisfied"), F.avg(F.when(low, over)).alias("lower_violation"), F.avg(F.when(high, over)).alias("upper_violation"),
    )


def portability_block(df: DataFrame, predictors: list[str], *keys: str) -> DataFrame:
    """Mae, rmse, bias, p90 of several predictor columns, one row each and key."""
    long = df.select(*keys, "y", F.explode(F.map_from_arrays(F.array(*map(F.lit, predictors)), F.array(*predictors))).alias("predictor", "p"))
    return long.groupBy(*keys, "predictor").agg(F.count(F.lit(1)).alias("rows"), F.avg(_err()).alias("mae"), F.sqrt(F.avg(_err() * _err())).alias("rmse"), F.avg(F.col("p") - F.col("y")).alias("bias")).transform(lambda t: ranks.beside(t, ranks.quantiles(long.select(*keys, "predictor", _err().alias("_e")), [*keys, "predictor"], "_e", {"p90": 0.9}), [*keys, "predictor"]))


def portability_report(df: DataFrame, predictors: list[str], reference: str, low: str, high: str, group: str, subset: Column, nominal: float = 0.9) -> DataFrame:
    """Scope (overall, group or disjoint), name (the group's), predictor, rows, mae, rmse, bias, p90, gain (the reference's mae less its
    own), nominal and coverage (the share of rows whose ``low`` to ``high`` holds y) for several predictor columns of y; ``subset`` tells the disjoint rows. A
    scope without rows has no row."""
    scopes = F.array(F.struct(F.lit("overall").alias("scope"), F.lit("").alias("name")), F.struct(F.lit("group").alias("scope"), F.col(group).cast("string").alias("name")), F.when(subset, F.struct(F.lit("disjoint").alias("scope"), F.lit("").alias("name"))))
    inside = ((F.col(low) <= F.col("y")) & (F.col("y") <= F.col(high))).cast("double")
    named = F.map_from_arrays(F.array(*map(F.lit, predictors)), F.array(*[F.col(c).cast("double") for c in predictors]))
    long = df.select("y", inside.alias("_in"), F.explode(F.filter(scopes, lambda x: x.isNotNull())).alias("s"), named.alias("_p")).select("s.*", "y", "_in", F.explode("_p").alias("predictor", "p"))
    on = ["scope", "name", "predictor"]
    sums = long.groupBy(*on).agg(F.count(F.lit(1)).alias("rows"), F.avg(_err()).alias("mae"), F.sqrt(F.avg(_err() * _err())).alias("rmse"), F.avg(F.col("p") - F.col("y")).alias("bias"), F.avg("_in").alias("coverage"))
    t = ranks.beside(sums, ranks.quantiles(long.select(*on, _err().alias("_e")), on, "_e", {"p90": 0.9}), on)
    base = t.where(F.col("predictor") == reference).select("scope", "name", F.col("mae").alias("_base"))
    t = ranks.beside(t, base, ["scope", "name"])
    return t.select(*on, "rows", "mae", "rmse", "bias", "p90", (F.col("_base") - F.col("mae")).alias("gain"), F.lit(nominal).alias("nominal"), "coverage")


def distribution_summary(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """D29."""
    q = ranks.quantiles(df.select(*keys, F.col(x).alias("_v")), list(keys), "_v", {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    return ranks.beside(df.groupBy(*keys).agg(F.count(x).alias("n"), F.max(x).alias("max")), q, list(keys)).select(*keys, "n", "median", "p90", "p95", "p99", "max")


def topk_hit_rate(df: DataFrame, group: str, score: str, truth: Column, order: list[str], k: int) -> DataFrame:
    """Groups and the share whose k best by score (ties by ``order``) hold a true row; no groups: 0."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), *order)
    hit = df.withColumn("_t", truth).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).groupBy(group).agg(F.max(F.col("_t").cast("int")).alias("hit"))
    return hit.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.avg("hit"), F.lit(0.0)).alias("hit_rate"))


def best_threshold(df: DataFrame, score: str, truth: str, low: float = 0.1, high: float = 0.9, steps: int = 33, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys,) threshold and balanced_accuracy: the first threshold of the grid with the best balanced accuracy, of all
    rows or of each group. Scores are counted on the grid first: the shuffle holds a row per step and group, whatever the input."""
    width = (high - low) / (steps - 1)
    at = F.floor(F.round((F.col(score) - low) / width, 9)).cast("int")  # thresholds 0..at are reached
    by = df.groupBy(*keys, F.greatest(F.lit(-1), F.least(F.lit(steps - 1), at)).alias("at")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    grid = by.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"), "at", "pos", "neg")
    t = grid.groupBy(*keys, "i").agg(F.sum(F.when(F.col("at") >= F.col("i"), F.col("pos")).otherwise(0)).alias("tp"), F.sum("pos").alias("p"), F.sum(F.when(F.col("at") < F.col("i"), F.col("neg")).otherwise(0)).alias("tn"), F.sum("neg").alias("n"))
    ba = F.round((F.col("tp") / F.col("p") + F.col("tn") / F.col("n")) / 2, 12)
    return t.groupBy(*keys).agg(F.max_by(F.struct((low + F.col("i") * width).alias("threshold"), ba.alias("balanced_accuracy")), F.struct(ba, -F.col("i"))).alias("b")).select(*keys, "b.*")


def threshold_margin_sweep(df: DataFrame, score: str, current: str, truth: str, subgroup: str, thresholds: int = 29, margins: int = 9) -> DataFrame:
    """Over a grid of thresholds and margins the one with the best accuracy, then subgroup accuracy, then fewest
    changes (ties: lower threshold, lower margin). Scores are rounded to 3 places and counted first."""
    by = df.groupBy(F.round(score, 3).alias("s"), F.col(current).alias("c"), F.col(truth).alias("t"), F.col(subgroup).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    grid = by.select("*", F.explode(F.sequence(F.lit(0), F.lit(thresholds - 1))).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.lit(margins - 1))).alias("j"))
    th, mg = F.round(0.15 + F.col("i") * 0.025, 3), F.round(F.col("j") * 0.025, 3)
    call = F.when(F.round(F.abs(F.col("s") - th), 9) >= mg, (F.col("s") >= th).cast("int")).otherwise(F.col("c"))
    n, right = F.col("n"), call == F.col("t")
    agg = grid.groupBy("i", "j").agg((F.sum(F.when(right, n).otherwise(0)) / F.sum(n)).alias("accuracy"), (F.sum(F.when(right & F.col("g"), n).otherwise(0)) / F.sum(F.when(F.col("g"), n).otherwise(0))).alias("subgroup_accuracy"), F.sum(F.when(call != F.col("c"), n).otherwise(0)).alias("changed"))
    best = F.max_by(F.struct(th.alias("threshold"), mg.alias("margin"), "accuracy", "subgroup_accuracy", "changed"), F.struct(F.round("accuracy", 12), F.round("subgroup_accuracy", 12), -F.col("changed"), -F.col("i"), -F.col("j")))
    return agg.agg(best.alias("b")).select("b.*")


def binary_metrics(df: DataFrame, score: str, truth: str, threshold: float = 0.5) -> DataFrame:
    """Rows, accuracy, balanced accuracy, roc_auc (null with one class), average_precision.

    Scores are counted per distinct value first; the running sums go over those values, ties sharing a rank.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("pos"), F.count_if(F.col(truth) == 0).alias("neg"))
    total = by.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    # Running sums over score ranges: ranges are summed first, so that no task sorts all scores.
    lo_hi = by.agg(F.min("s").alias("a"), F.max("s").alias("z"))
    b = by.crossJoin(F.broadcast(lo_hi)).withColumn("k", F.floor(999 * (F.col("s") - F.col("a")) / F.greatest(F.col("z") - F.col("a"), F.lit(1e-300))))
    ks = b.groupBy("k").agg(F.sum("pos").alias("kp"), F.sum("neg").alias("kn"))
    above = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, -1)  # 1000 rows at most
    ks = ks.select("k", F.coalesce(F.sum("kp").over(above), F.lit(0)).alias("p0"), F.coalesce(F.sum("kn").over(above), F.lit(0)).alias("n0"))
    w = Window.partitionBy("k").orderBy(F.col("s").desc())
    t = b.join(F.broadcast(ks), "k").withColumn("tp", F.col("p0") + F.sum("pos").over(w)).withColumn("fp", F.col("n0") + F.sum("neg").over(w))
    t = t.crossJoin(F.broadcast(total))
    auc = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    tpr = F.sum(F.when(F.col("s") >= threshold, F.col("pos")).otherwise(0))
    tnr = F.sum(F.when(F.col("s") < threshold, F.col("neg")).otherwise(0))
    P, N = F.max("P"), F.max("N")
    return t.agg((P + N).alias("rows"), ((tpr + tnr) / (P + N)).alias("accuracy"), F.when((P > 0) & (N > 0), (tpr / P + tnr / N) / 2).alias("balanced_accuracy"), F.when((P > 0) & (N > 0), auc / (P * N)).alias("roc_auc"), F.when(P > 0, ap / P).alias("average_precision"))


def hierarchical_calibration(calls: DataFrame, residuals: DataFrame, label: str, family: str, k_family: float = 40, k_label: float = 20) -> DataFrame:
    """``calls`` (id, label, family, p, level) with prob (of an observed value at or above the level), low and high
    (5 % and 95 % of the weighted residual mixture around p).

    ``residuals`` has label, family, r. Pools of a label and family lean to the global pool by n / (n + k); tail
    probabilities have half counts. Residuals and the calls' thresholds are rounded to 6 places, counted and dealt out by
    ranges of the value. Each pool is summed per range, so that tails are running counts within a range, and a mixture's
    quantile is looked for in the one range where the pools' sums reach it: no pool is held by a row or a task.
    """
    no_pool = F.lit(None).cast("string")
    c = calls.withColumnRenamed(label, "L").withColumnRenamed(family, "F").withColumn("_at", F.round(F.col("level") - F.col("p"), 6))
    r = residuals.where("r is not null").select(F.col(label).alias("L"), F.col(family).alias("F"), F.round("r", 6).alias("x"), F.lit(1).alias("z"), F.lit(1).cast("long").alias("c"))
    asked = c.select("L", "F", F.col("_at").alias("x"), F.lit(0).alias("z"), F.lit(0).cast("long").alias("c")).distinct()
    events = asked.unionByName(r.groupBy("L", "F", "x", "z").agg(F.sum("c").alias("c")))
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(events.repartitionByRange(parts, "x", "z").withColumn("part", F.spark_partition_id()), "residual-ranges")
    pools = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in (("L", F.col("L")), ("F", F.col("F")), ("G", no_pool))])
    pool = ["kind", "key"]
    each = placed.select(F.explode(pools).alias("g"), "part", "x", "z", "c").groupBy("g.kind", "g.key", "part", "x", "z").agg(F.sum("c").alias("c"))
    each = cut(each.withColumn("key", F.coalesce("key", F.lit(""))), "residual-pools")
    sums = each.groupBy(*pool, "part").agg(F.sum("c").alias("s"))
    line = Window.partitionBy(*pool).orderBy("part")  # a row per range
    sums = cut(sums.select(*pool, "part", F.sum("s").over(line).alias("end"), (F.sum("s").over(line) - F.col("s")).alias("before"), F.sum("s").over(Window.partitionBy(*pool)).alias("n")), "residual-sums")
    inside = Window.partitionBy(*pool, "part").orderBy("x", "z").rowsBetween(Window.unboundedPreceding, 0)
    below = each.join(sums, [*pool, "part"]).select(*pool, "x", "z", (F.col("before") + F.sum("c").over(inside)).alias("below"), "n").where("z = 0")
    # tails: residuals at or above the threshold
    told = c.withColumn("L", F.coalesce("L", F.lit(""))).withColumn("F", F.coalesce("F", F.lit("")))
    for kind, key in (("L", F.col("L")), ("F", F.col("F")), ("G", F.lit(""))):
        own = below.where(F.col("kind") == kind).select(F.col("key").alias("_k"), F.col("x").alias("_at"), ((F.col("n") - F.col("below") + 0.5) / (F.col("n") + 1)).alias(f"tail_{kind}"), F.col("n").alias(f"n_{kind}"))
        told = told.withColumn("_k", key).join(own, ["_k", "_at"], "left").drop("_k")
    wl, wf = F.col("n_L") / (F.col("n_L") + k_label), F.col("n_F") / (F.col("n_F") + k_family)
    told = told.withColumn("w_L", wl).withColumn("w_F", (1 - wl) * wf).withColumn("w_G", (1 - wl) * (1 - wf))
    # mixtures: one per label and family of the calls
    mixes = cut(told.groupBy("L", "F").agg(*[F.first(f"{v}_{k}").alias(f"{v}_{k}") for k in "LFG" for v in "wn"]), "residual-mixtures")
    share = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key"), F.try_divide(F.col(f"w_{k}"), F.col(f"n_{k}")).alias("w")) for k, v in (("L", F.col("L")), ("F", F.col("F")), ("G", F.lit("")))]))
    weights = mixes.select("L", "F", share.alias("s")).select("L", "F", "s.*").where("w is not null")
    ranges = weights.join(sums, pool).select("L", "F", "part", (F.col("w") * (F.col("end") - F.col("before"))).alias("m")).groupBy("L", "F", "part").agg(F.sum("m").alias("m"))
    up = Window.partitionBy("L", "F").orderBy("part")  # a row per range
    levels = F.explode(F.array(F.lit(0.05), F.lit(0.95))).alias("q")
    ends = ranges.select("L", "F", "part", F.sum("m").over(up).alias("end"), "m").select("*", levels).where(F.round("end", 12) >= F.col("q"))
    spot = ends.groupBy("L", "F", "q").agg(F.min_by(F.struct("part", (F.col("end") - F.col("m")).alias("before")), "part").alias("t")).select("L", "F", "q", "t.part", "t.before")
    values = spot.join(weights, ["L", "F"]).join(each.where("z = 1"), [*pool, "part"]).groupBy("L", "F", "q", "before", "x").agg(F.sum(F.col("w") * F.col("c")).alias("m"))
    run = Window.partitionBy("L", "F", "q").orderBy("x")  # the values of one range
    found = values.withColumn("upto", F.col("before") + F.sum("m").over(run)).where(F.round("upto", 12) >= F.col("q")).groupBy("L", "F").agg(F.min(F.when(F.col("q") < 0.5, F.col("x"))).alias("_low"), F.min(F.when(F.col("q") > 0.5, F.col("x"))).alias("_high"))
    prob = sum((F.coalesce(F.col(f"w_{k}") * F.col(f"tail_{k}"), F.lit(0.0)) for k in "LF"), F.col("w_G") * F.col("tail_G"))
    return told.join(found, ["L", "F"], "left").select("id", F.col("L").alias(label), F.col("F").alias(family), "p", prob.alias("prob"), (F.col("p") + F.col("_low")).alias("low"), (F.col("p") + F.col("_high")).alias("high"))


# Folds and splits


def random_group_split(df: DataFrame, key: str, fraction: float, seed: int = 17) -> DataFrame:
    """``df`` with is_test: whole keys by a hash of seed and key (a numpy shuffle is not reproduced)."""
    at = seed_of(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))) / float(1 << 32)
    return df.withColumn("is_test", at < fraction)


def rarest_first_split(groups: DataFrame, group: str, size: str, fraction: float) -> DataFrame:
    """Group, size, is_test: the smallest groups go to test until the target is reached.

    Sizes are counted first, and only groups of the size at the boundary are ranked.
    """
    sizes = groups.groupBy(F.col(size).alias("z")).agg(F.count(F.lit(1)).alias("c"), F.sum(size).alias("s"))
    before = F.coalesce(F.sum("s").over(Window.orderBy("z").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per distinct size
    total = groups.agg(F.greatest(F.lit(1), F.floor(F.sum(size) * fraction)).alias("target"))
    plan = sizes.withColumn("before", before).crossJoin(F.broadcast(total)).select("z", "before", "target", F.greatest(F.lit(0), F.least(F.col("c"), F.ceil((F.col("target") - F.col("before")) / F.col("z")))).alias("take"), "c")
    t = groups.join(plan, F.col(size) == F.col("z"))
    edge = t.where("take > 0 and take < c").withColumn("_r", F.row_number().over(Window.partitionBy("z").orderBy(group))).withColumn("is_test", F.col("_r") <= F.col("take")).drop("_r")
    rest = t.where("not (take > 0 and take < c)").withColumn("is_test", F.col("take") > 0)
    return edge.unionByName(rest).select(group, size, "is_test")


def group_kfold(groups: DataFrame, group: str, size: str, k: int) -> DataFrame:
    """Group, size, fold: folds alternate forwards and backwards over groups from large to small. The rank is that
    among groups of a size plus the groups of larger sizes, so the window's rows are groups of one size."""
    by = groups.groupBy(F.col(size).alias("z")).agg(F.count(F.lit(1)).alias("c"))
    before = by.select("z", F.coalesce(F.sum("c").over(Window.orderBy(F.col("z").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))
    r = groups.join(before, F.col(size) == F.col("z")).withColumn("r", F.col("b") + F.row_number().over(Window.partitionBy("z").orderBy(group)) - 1)
    lap, at = F.floor(F.col("r") / k), F.col("r") % k
    return r.select(group, size, F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("long").alias("fold"))


def label_folds(df: DataFrame, label: str, row: str, k: int) -> DataFrame:
    """``df`` with fold: per label in hash order, round robin from an offset that the label's SHA-256 gives."""
    one = df.select(F.col(label).alias("_l"), F.sha2(F.col(row).cast("string"), 256).alias("_h"), F.col(row).alias("_row")).groupBy("_l", "_h", "_row").agg(F.count(F.lit(1)).alias("_c"))
    at = ranks.cumulative(one, ["_l"], ["_h", "_row"], ["_c"]).select("_l", "_row", (F.col("upto__c") - F.col("_c")).alias("_before"))
    again = Window.partitionBy(label, row).orderBy(row)  # rows alike are told apart among themselves only
    placed = df.join(at, F.col(label).eqNullSafe(F.col("_l")) & F.col(row).eqNullSafe(F.col("_row")))
    return placed.withColumn("fold", ((seed_of(label) % k) + F.col("_before") + F.row_number().over(again) - 1) % k).drop("_l", "_row", "_before")


def split_manifest(df: DataFrame, key: str, split: str) -> DataFrame:
    """Key, n, splits (sorted), leaks: whether the key lies in more than one split."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(split)), "|").alias("splits"), (F.count_distinct(split) > 1).alias("leaks"))


def split_errors(df: DataFrame, row: str, key: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """Kind and id (as text) of what is wrong with a split given as row ids: ``overlap`` (a row in both), ``range`` (an id that
    no row has), ``leak`` (a key whose rows lie in both). No rows: the split is sound."""
    ids = train.select(F.col(row).alias("_i"), F.lit(1).alias("s")).unionByName(test.select(F.col(row).alias("_i"), F.lit(2).alias("s"))).distinct()
    sides = ids.groupBy("_i").agg(F.sum("s").alias("s"))
    rows = sides.join(df.select(F.col(row).alias("_r"), F.col(key).alias("_k")), F.col("_i") == F.col("_r"), "left")
    leaks = rows.where("_r is not null").groupBy("_k").agg(F.bit_or("s").alias("s")).where("s = 3")
    pick = lambda t, kind, c: t.select(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"))
    return pick(sides.where("s = 3"), "overlap", "_i").unionByName(pick(rows.where("_r is null"), "range", "_i")).unionByName(pick(leaks, "leak", "_k"))


def fold_support(df: DataFrame, label: str, group: str, fold: str) -> DataFrame:
    """Label, fold, rows_elsewhere, groups_elsewhere, zero_shot. A group lies in one fold, so distinct groups
    subtract as rows do."""
    by = df.groupBy(label, fold).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("g"))
    w = Window.partitionBy(label)
    return by.select(label, fold, (F.sum("n").over(w) - F.col("n")).alias("rows_elsewhere"), (F.sum("g").over(w) - F.col("g")).alias("groups_elsewhere")).withColumn("zero_shot", F.col("rows_elsewhere") == 0)


def leave_fold_out_median(df: DataFrame, key: str, fold: str, x: str, folds: int) -> DataFrame:
    """Key, fold, baseline: the key's median over the other folds, else the median of all of them.

    Values are counted once with a column per fold; a fold's rank is the whole one less its own.
    """
    rest = [f"rest{f}" for f in range(folds)]
    counts = [F.count_if(F.col(fold) != f).alias(c) for f, c in enumerate(rest)]

    def each(keys: list[str]) -> DataFrame:
        by = df.where(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("_x")).agg(*counts)
        small = lambda t: t.groupBy(*keys).agg(*[F.percentile("_x", 0.5, F.col(c)).alias(c) for c in rest])
        large = lambda t: ranks.cumulative(t, keys, ["_x"], rest).groupBy(*keys).agg(*[ranks.interpolated("_x", f"upto_{c}", f"n_{c}", 0.5).alias(c) for c in rest])
        wide = ranks.by_size(cut(by, "counted"), keys, small, large)
        return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(f).alias(fold), F.col(c).alias("m")) for f, c in enumerate(rest)])).alias("s")).select(*keys, f"s.{fold}", "s.m")

    asked = df.select(key, fold).distinct()
    own, every = each([key]).withColumnRenamed("m", "_own"), each([]).withColumnRenamed("m", "_all")
    return asked.join(own, [key, fold], "left").join(F.broadcast(every), fold, "left").select(key, fold, F.coalesce("_own", "_all").alias("baseline"))


def one_se_select(scores: DataFrame, name: str, score: str, tail: str, simplicity: str) -> DataFrame:
    """of the candidates within one standard error of the best mean the simplest, then the lowest tail."""
    by = scores.groupBy(name, simplicity).agg(F.avg(score).alias("mean"), F.stddev_samp(score).alias("sd"), F.avg(tail).alias("tail"), F.count(F.lit(1)).alias("k"))
    best = by.agg(F.min_by(F.struct("mean", "sd", "k"), F.struct("mean", "tail", name)).alias("b")).select((F.col("b.mean") + F.coalesce("b.sd", F.lit(0.0)) / F.sqrt("b.k")).alias("limit"))
    ok = by.crossJoin(F.broadcast(best)).where(F.col("mean") <= F.col("limit"))
    return ok.agg(F.min_by(F.struct(name, "mean", "limit"), F.struct(simplicity, "tail", name)).alias("s")).select("s.*")


def rank_gap(df: DataFrame, group: str, score: str, order: list[str]) -> DataFrame:
    """``df`` with rank, top, second (0 if none), gap, gap_ratio and confidence (gap ratio over rank)."""
    w, every = Window.partitionBy(group).orderBy(F.col(score).desc(), *order), Window.partitionBy(group)
    t = df.withColumn("rank", F.row_number().over(w))
    t = t.withColumn("top", F.max(score).over(every)).withColumn("second", F.coalesce(F.max(F.when(F.col("rank") == 2, F.col(score))).over(every), F.lit(0.0)))
    t = t.withColumn("gap", F.col("top") - F.col("second"))
    return t.withColumn("gap_ratio", F.when(F.col("top") != 0, F.col("gap") / F.col("top")).otherwise(0.0)).withColumn("confidence", F.col("gap_ratio") / F.col("rank"))


def support_gate(df: DataFrame, group: str, least: int, delta: str, priority: list[str]) -> DataFrame:
    """Delta of groups with ``least`` rows or in ``priority``, else 0."""
    ok = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).withColumn("supported", (F.col("_n") >= least) | F.col(group).isin(*priority)).drop("_n")
    return df.join(ok, group).withColumn("gated", F.when(F.col("supported"), F.col(delta)).otherwise(0.0))


def context_stats(df: DataFrame, group: str, item: str, x: str) -> DataFrame:
    """Of the other members of the group: n, min, max, mean, closest gap, how many are higher and lower; zeros when
    alone. Sums and extremes come from windows, the gap from neighbours in order: no self-join, and one sort."""
    w = Window.partitionBy(group)
    o, same = w.orderBy(x, item), w.orderBy(x)  # the sort of the first serves all
    before, after = F.col("_before"), F.col("_after")
    t = df.select(group, item, x, F.lag(x).over(o).alias("_before"), F.lead(x).over(o).alias("_after"), F.row_number().over(o).alias("_at"))
    t = t.select("*", (F.rank().over(same) - 1).alias("lower"), F.count(F.lit(1)).over(same.rangeBetween(Window.currentRow, Window.currentRow)).alias("_peers"))
    t = t.select("*", (F.count(F.lit(1)).over(w) - 1).alias("n"), F.min(x).over(w).alias("_low"), F.max(x).over(w).alias("_high"), F.sum(x).over(w).alias("_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    n = F.col("n")
    lo, hi = F.when(F.col("_at") == 1, after).otherwise(F.col("_low")), F.when(F.col("_at") == n + 1, before).otherwise(F.col("_high"))
    return t.select(
        group, item, "n", zero(lo).alias("low"), zero(hi).alias("high"), zero((F.col("_sum") - F.col(x)) / F.when(n > 0, n)).alias("mean"),
        zero(F.least(F.col(x) - before, after - F.col(x))).alias("closest"), "lower", (n - F.col("lower") - (F.col("_peers") - 1)).alias("higher"),
    )


def soft_assign(df: DataFrame, measure: str, value: str, target: str, temperature: float = 2.0, total: float = 0.2) -> DataFrame:
    """``df`` (a row per measurement and candidate) with weight: exp(-|d| / T) normalised per measurement, times
    ``total``; incomplete rows are for the caller's blocked ledger."""
    e = F.exp(-F.abs(F.col(value) - F.col(target)) / max(0.25, temperature))
    return df.withColumn("_e", e).withColumn("weight", total * F.col("_e") / F.sum("_e").over(Window.partitionBy(measure))).drop("_e")


def set_match_cost(observed: Column, ladder: Column) -> Column:
    """Least cost of matching each observed value to a ladder value of its own (both arrays): a dynamic programme
    over the sorted arrays, since a one-dimensional match keeps order. Null when more are observed than there are steps."""
    o, p = F.array_sort(observed), F.array_sort(ladder)
    js = F.sequence(F.lit(0), F.size(p))
    start = F.transform(js, lambda j: F.lit(0.0))
    step = lambda st, x: F.transform(js, lambda j: F.when(j == 0, F.lit(1e18)).otherwise(F.array_min(F.transform(F.sequence(F.lit(1), j), lambda m: F.get(st, m - 1) + F.abs(x - F.get(p, m - 1))))))
    return F.when(F.size(o) <= F.size(p), F.element_at(F.aggregate(o, start, step), -1))


def set_match_pairs(observed: Column, ladder: Column) -> Column:
    """Array of (o, p), places from 0 in both sorted arrays: the match of every observed value to a ladder value of its
    own with the least total distance (of equal ones that of lower steps, from the last value on). Null when more are
    observed than there are steps.

    The programme's row for the i-th value holds the least cost within the first j steps and whether step j is taken; the
    match is read back from the last row along those marks.
    """
    line = "struct<cost:array<double>,took:array<array<boolean>>>"
    js = F.sequence(F.lit(1), F.size(ladder))

    def row(st: Column, x: Column) -> Column:
        def put(r: Column, j: Column) -> Column:
            skip, take = F.element_at(r["c"], -1), F.get(st["cost"], j - 1) + F.abs(x - F.get(ladder, j - 1))
            return F.struct(F.array_append(r["c"], F.least(skip, take)).alias("c"), F.array_append(r["t"], take < skip).alias("t"))

        start = F.struct(F.array(F.lit(1e300)).alias("c"), F.array(F.lit(False)).alias("t"))
        return let(F.aggregate(js, start, put), lambda r: F.struct(r["c"].alias("cost"), F.array_append(st["took"], r["t"]).alias("took")))

    first = F.struct(F.array_repeat(F.lit(0.0), F.size(ladder) + 1).alias("cost"), F.array().cast("array<array<boolean>>").alias("took")).cast(line)
    rows = F.aggregate(observed, first, row)

    def back(s: Column, i: Column, took: Column) -> Column:
        at = F.array_max(F.filter(F.sequence(F.lit(1), s["j"]), lambda j: F.get(F.get(took, i - 1), j)))
        return let(at, lambda j: F.struct((j - 1).alias("j"), F.array_append(s["out"], F.struct((i - 1).alias("o"), (j - 1).alias("p"))).alias("out")))

    none = F.array().cast("array<struct<o:int,p:int>>")
    steps = lambda r: F.aggregate(F.sequence(F.size(observed), F.lit(1), F.lit(-1)), F.struct(F.size(ladder).alias("j"), none.alias("out")), lambda s, i: back(s, i, r["took"]))["out"]
    return F.when(F.size(observed) == 0, none).when(F.size(observed) <= F.size(ladder), F.reverse(let(rows, steps)))


def set_match(df: DataFrame, key: str, observed: str, ladder: str) -> DataFrame:
    """Key, observed, step, predicted, status: a row per distinct observed value (array ``observed``) with the step of the
    ``ladder`` (array of value, step) that it is matched to; a set larger than its ladder is one blocked row with a reason. Nulls
    are no values; a key with nothing observed has no row. A ladder fits in a row."""
    o = F.array_sort(F.array_distinct(F.transform(F.filter(observed, lambda x: x.isNotNull()), lambda x: F.round(x.cast("double"), 6))))
    p = F.array_sort(F.transform(F.filter(ladder, lambda x: x["value"].isNotNull()), lambda x: F.struct(x["value"].cast("double").alias("value"), x["step"].alias("step"))))
    t = df.select(key, F.coalesce(o, F.array().cast("array<double>")).alias("_o"), F.coalesce(p, F.filter(p, lambda x: F.lit(False))).alias("_p")).where(F.size("_o") > 0)
    t = t.withColumn("_v", F.transform("_p", lambda x: x["value"]))
    none = F.lit(None).cast("double")
    blocked = t.where(F.size("_o") > F.coalesce(F.size("_p"), F.lit(0))).select(key, none.alias("observed"), F.lit(None).alias("step"), none.alias("predicted"), F.lit("set_larger_than_ladder").alias("status"))
    free = t.where(F.size("_o") <= F.size("_p"))
    pair = free.select(key, "_o", "_p", F.explode(set_match_pairs(F.col("_o"), F.col("_v"))).alias("m"))
    matched = pair.select(key, F.get("_o", F.col("m.o")).alias("observed"), F.get("_p", F.col("m.p"))["step"].alias("step"), F.get("_p", F.col("m.p"))["value"].alias("predicted"), F.lit("matched").alias("status"))
    return matched.unionByName(blocked.withColumn("step", F.col("step").cast(matched.schema["step"].dataType)))


def cluster_1d(values: Column, gap: float = 1.0, span: float = 2.0) -> Column:
    """Array of clusters (sorted arrays) of the distinct values: a new one where the gap to the last or the span
    from the first would be exceeded."""
    sorted_ = F.array_sort(F.array_distinct(F.filter(values, lambda v: v.isNotNull())))
    empty = F.struct(F.array().cast("array<array<double>>").alias("done"), F.array().cast("array<double>").alias("now"))

    def put(s: Column, v: Column) -> Column:
        fits = F.when(F.size(s["now"]) == 0, True).otherwise((F.round(v - F.try_element_at(s["now"], F.lit(-1)), 9) <= gap) & (F.round(v - F.try_element_at(s["now"], F.lit(1)), 9) <= span))
        return F.when(fits, F.struct(s["done"].alias("done"), F.array_append(s["now"], v).alias("now"))).otherwise(F.struct(F.array_append(s["done"], s["now"]).alias("done"), F.array(v).alias("now")))

    return F.aggregate(sorted_, empty, put, lambda s: F.when(F.size(s["now"]) > 0, F.array_append(s["done"], s["now"])).otherwise(s["done"]))


def clusters_with_medians(values: Column, gap: float = 1.0, span: float = 2.0) -> Column:
    """Array of (low, high, n, median) of the clusters of :func:`cluster_1d`; n and median are of the distinct values."""
    at = lambda c, i: F.get(c, i.cast("int"))
    middle = lambda c: (at(c, F.floor((F.size(c) - 1) / 2)) + at(c, F.floor(F.size(c) / 2))) / 2
    return F.transform(cluster_1d(values, gap, span), lambda c: F.struct(F.element_at(c, 1).alias("low"), F.element_at(c, -1).alias("high"), F.size(c).alias("n"), middle(c).alias("median")))


def top1_summary(df: DataFrame, entity: str, best: list[Column], label: Column, form: Column, subset: Column, confidence: str) -> DataFrame:
    """One row over the best row of each entity (the largest by ``best``): entities, label_accuracy, pair_rows (of the ``subset``),
    pair_accuracy (of ``form`` in it) and mean_confidence; an empty set has zeros."""
    row = F.struct(label.cast("double").alias("l"), F.when(subset, form.cast("double")).alias("f"), subset.alias("s"), F.col(confidence).cast("double").alias("c"))
    top = df.groupBy(entity).agg(F.max_by(row, F.struct(*best)).alias("t"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return top.agg(F.count(F.lit(1)).alias("entities"), zero(F.avg("t.l")).alias("label_accuracy"), F.count_if("t.s").alias("pair_rows"), zero(F.avg("t.f")).alias("pair_accuracy"), zero(F.avg("t.c")).alias("mean_confidence"))


def dataset_manifest(df: DataFrame, dataset: str, entity: str, label: str, flags: dict[str, Column], roles: list[tuple[str, str]], top: int = 5) -> DataFrame:
    """A row per dataset: role (that of the first of ``roles``, patterns and names, which its name matches; else "other"), rows, entities, a
    count and rate per flag (0 where there are no rows) and top_labels, a JSON object of its most frequent labels (ties by name)."""
    role = F.coalesce(*[F.when(F.col(dataset).rlike(pattern), name) for pattern, name in roles], F.lit("other"))
    counts = [x for name, c in flags.items() for x in (F.count_if(c).alias(name), F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0)).alias(f"{name}_rate"))]
    sums = df.groupBy(dataset).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(entity).alias("entities"), *counts)
    n = df.where(F.col(label).isNotNull()).groupBy(dataset, F.col(label).cast("string").alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    first = n.withColumn("_r", F.row_number().over(Window.partitionBy(dataset).orderBy(F.col("_n").desc(), "_l"))).where(F.col("_r") <= top)
    pair = F.transform(F.sort_array(F.collect_list(F.struct("_r", "_l", "_n"))), lambda x: F.struct(x["_l"], x["_n"]))
    tops = first.groupBy(dataset).agg(F.to_json(F.map_from_entries(pair)).alias("top_labels"))
    return ranks.beside(sums, tops, [dataset]).withColumn("top_labels", F.coalesce("top_labels", F.lit("{}"))).withColumn("role", role)
