"""Metric, calibration and fold queries: an order's price is predicted from the other folds' orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibrant.operators import metrics as m
from calibrant.plans.common import NUMBERED, numbered, r6, read

FOLDS = 5


def _oof(spark, d, unit="o_custkey"):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("family"), (F.col("o_totalprice").cast("double") / 10000).alias("y"), (F.col(unit) % FOLDS).cast("int").alias("fold"), (1.0 + F.col("o_orderkey") % 3).alias("w"))
    base = m.leave_fold_out_median(o, "label", "fold", "y", FOLDS)
    return o.join(base, ["label", "fold"]).withColumn("p", F.col("baseline") + F.col("o_orderkey") % 5 - 2).withColumnRenamed("baseline", "q")


def _r(df, *keep, places=6):
    return df.select(*[F.round(c, places).alias(c) if dict(df.dtypes)[c] == "double" else F.col(c) for c in df.columns])


def leave_fold_out_baseline(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), (F.col("o_custkey") % FOLDS).cast("int").alias("fold"), (F.col("o_totalprice").cast("double") / 10000).alias("y"))
    return _r(m.leave_fold_out_median(o, "label", "fold", "y", FOLDS))


def error_metrics(spark, d):
    return _r(m.error_metrics(_oof(spark, d), "label"))


def error_strata(spark, d):
    return _r(m.error_strata(_oof(spark, d), "family", "label"))


def composite_heldout(spark, d):
    return _r(m.composite_heldout({"customer": _oof(spark, d), "order": _oof(spark, d, "o_orderkey")}, "family", "label"))


def group_balanced_mae(spark, d):
    return _r(m.group_balanced_mae(_oof(spark, d), "o_custkey"))


def conformal_radius(spark, d):
    t = m.conformal_radius(_oof(spark, d).withColumn("p", F.round("p", 6)).withColumn("y", F.round("y", 6)), "label")
    return t.select("label", F.col("level").cast("double").alias("level"), r6("radius").alias("radius"), r6("coverage").alias("coverage"))


def group_bootstrap(spark, d):
    return _r(m.group_bootstrap(_oof(spark, d), "o_custkey"))


def calibration_gate(spark, d):
    o = _oof(spark, d)
    return _r(m.calibration_gate(o.withColumn("y", F.col("y") - 15).withColumn("p", F.col("p") - 15).withColumn("q", F.col("q") - 15), "label", "o_custkey"))


def censored_score(spark, d):
    o = _oof(spark, d).withColumn("qualifier", F.when(F.col("o_orderkey") % 4 == 0, "lower_bound").when(F.col("o_orderkey") % 4 == 1, "upper_bound").when(F.col("o_orderkey") % 4 == 2, "approximate").otherwise("exact"))
    return _r(m.censored_score(o, "label"))


def portability_block(spark, d):
    return _r(m.portability_block(_oof(spark, d), ["p", "q"], "family"))


def distribution_summary(spark, d):
    return _r(m.distribution_summary(_oof(spark, d), "y", "label"))


def hierarchical_calibration(spark, d):
    o = _oof(spark, d)
    calls = o.select(F.col("o_orderkey").alias("id"), "label", "family", F.round("p", 6).alias("p"), F.lit(15.0).alias("level"))
    res = o.select("label", "family", F.round(F.round("y", 6) - F.round("p", 6), 6).alias("r"))
    return _r(m.hierarchical_calibration(calls, res, "label", "family"))


def rank_gap(spark, d):
    t = m.rank_gap(numbered(read(spark, d, "lineitem")).select("l_orderkey", "rn", F.col("l_extendedprice").cast("double").alias("x")), "l_orderkey", "x", ["rn"])
    return t.select("l_orderkey", F.col("rn").cast("long").alias("rn"), F.col("rank").cast("long").alias("rank"), r6("gap").alias("gap"), r6("gap_ratio").alias("gap_ratio"), r6("confidence").alias("confidence"))


def topk_hit_rate(spark, d):
    t = m.topk_hit_rate(numbered(read(spark, d, "lineitem")), "l_orderkey", "l_extendedprice", F.col("l_returnflag") == "R", ["rn"], 2)
    return _r(t)


def _scored(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.least(F.lit(1.0), F.char_length(F.coalesce("text", F.lit(""))) / 5000).alias("s"), "lang")
    return docs.join(read(spark, d, "labels"), "doc_id")


def best_threshold(spark, d):
    return _r(m.best_threshold(_scored(spark, d), "s", "quality"))


def threshold_margin_sweep(spark, d):
    t = _scored(spark, d).withColumn("current", (F.col("doc_id") % 2).cast("int")).withColumn("sub", F.col("lang") == "en")
    return _r(m.threshold_margin_sweep(t, "s", "current", "quality", "sub"))


def binary_metrics(spark, d):
    return _r(m.binary_metrics(_scored(spark, d), "s", "quality"))


def random_group_split(spark, d):
    return m.random_group_split(read(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 0.2)


def _sizes(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


def rarest_first_split(spark, d):
    return m.rarest_first_split(_sizes(spark, d), "o_custkey", "n", 0.2)


def group_kfold(spark, d):
    return m.group_kfold(_sizes(spark, d), "o_custkey", "n", 5)


def label_folds(spark, d):
    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation"))
    return m.label_folds(c, "nation", "c_custkey", 5).select("c_custkey", "nation", F.col("fold").cast("long").alias("fold"))


def split_manifest(spark, d):
    docs = read(spark, d, "documents").select("source", F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train").alias("split"))
    return m.split_manifest(docs, "source", "split")


def fold_support(spark, d):
    o = read(spark, d, "orders").select("o_custkey", F.col("o_orderpriority").alias("label"), (F.col("o_custkey") % FOLDS).alias("fold"))
    return m.fold_support(o, "label", "o_custkey", "fold")


def one_se_select(spark, d):
    t = read(spark, d, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") % 4).alias("split")).agg(F.avg(F.col("l_discount").cast("double")).alias("mae"), F.max(F.col("l_tax").cast("double")).alias("p95"))
    return _r(m.one_se_select(t.withColumn("rank", F.col("l_suppkey") % 10), "l_suppkey", "mae", "p95", "rank"))


def support_gate(spark, d):
    o = _oof(spark, d).withColumn("delta", F.col("p") - F.col("q"))
    return _r(m.support_gate(o, "o_custkey", 12, "delta", []).select("o_orderkey", "supported", "gated"))


def context_stats(spark, d):
    t = m.context_stats(numbered(read(spark, d, "lineitem")).select("l_orderkey", "rn", F.col("l_extendedprice").cast("double").alias("x")), "l_orderkey", "rn", "x")
    return t.select("l_orderkey", F.col("rn").cast("long").alias("rn"), "n", *[r6(c).alias(c) for c in ("low", "high", "mean", "closest")], F.col("lower").cast("long").alias("lower"), F.col("higher").cast("long").alias("higher"))


def soft_assign(spark, d):
    lines = numbered(read(spark, d, "lineitem")).select("l_orderkey", "rn", (F.col("l_extendedprice").cast("double") / 10000).alias("t"))
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_totalprice").cast("double") / 40000).alias("v"))
    t = m.soft_assign(lines.join(o, "l_orderkey"), "l_orderkey", "v", "t")
    return t.select("l_orderkey", F.col("rn").cast("long").alias("rn"), F.round("weight", 9).alias("weight"))


def set_match(spark, d):
    lines = numbered(read(spark, d, "lineitem"))
    g = lines.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("rn") <= 2, F.col("l_quantity").cast("double"))).alias("obs"), F.collect_list(F.when(F.col("rn") > 2, F.col("l_extendedprice").cast("double") / 1000)).alias("steps"))
    return g.select("l_orderkey", r6(m.set_match_cost(F.col("obs"), F.col("steps"))).alias("cost"))


def set_match_rows(spark, d):
    """The first three lines' quantities of each order matched to the other lines' prices, the steps of a ladder."""
    lines = numbered(read(spark, d, "lineitem"))
    step = F.struct((F.col("l_extendedprice").cast("double") / 1000).alias("value"), F.col("rn").cast("long").alias("step"))
    g = lines.groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("rn") <= 3, F.col("l_quantity").cast("double"))).alias("obs"), F.collect_list(F.when(F.col("rn") > 3, step)).alias("ladder"))
    t = m.set_match(g, "l_orderkey", "obs", "ladder")
    return t.select("l_orderkey", r6("observed").alias("observed"), "step", r6("predicted").alias("predicted"), "status")


def cluster_1d(spark, d):
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double") / 5).alias("v"))
    c = m.cluster_1d(F.col("v"))
    return g.select("l_orderkey", F.explode(c).alias("c")).select("l_orderkey", F.element_at("c", 1).alias("first"), F.element_at("c", -1).alias("last"), F.size("c").cast("long").alias("n"))


QUERIES = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_FOLDED = """o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS label, o_orderstatus AS family, o_totalprice::DOUBLE / 10000 AS y, ({unit} % 5)::INT AS fold, 1.0::DOUBLE + o_orderkey % 3 AS w FROM orders),
b AS (SELECT label, f.fold, median(y) AS q FROM o, (SELECT unnest(range(5)) AS fold) f WHERE o.fold <> f.fold GROUP BY ALL),
x AS (SELECT o.*, q, q + o_orderkey % 5 - 2 AS p, abs(y - (q + o_orderkey % 5 - 2)) AS e FROM o JOIN b ON o.label = b.label AND o.fold = b.fold)"""
_OOF = _FOLDED.format(unit="o_custkey")
_SIZES = "z AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"
_SC = "s AS (SELECT d.doc_id, least(1.0, length(coalesce(text, '')) / 5000)::DOUBLE AS s, lang, quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_DRAWN = " + ".join(f"(u >= {c})::INT" for c in m.POISSON)
_STRATA = "SELECT 'global' AS scope, '' AS stratum, e FROM {t} UNION ALL SELECT 'family', family, e FROM {t} UNION ALL SELECT 'label', label, e FROM {t}"

SQL = {
    "composite_heldout": f"""WITH c AS (WITH {_OOF} SELECT family, label, e FROM x), k AS (WITH {_FOLDED.format(unit="o_orderkey")} SELECT family, label, e FROM x), a AS (SELECT * FROM c UNION ALL SELECT * FROM k),
        u AS (SELECT 'customer' AS protocol, * FROM ({_STRATA.format(t="c")}) UNION ALL SELECT 'order', * FROM ({_STRATA.format(t="k")}) UNION ALL SELECT 'combined', * FROM ({_STRATA.format(t="a")}))
        SELECT protocol, scope, stratum, count(*) AS rows, round(avg(e), 6) AS mae, round(median(e), 6) AS median, round(quantile_cont(e, 0.9), 6) AS p90, round(quantile_cont(e, 0.95), 6) AS p95 FROM u GROUP BY ALL""",
    "leave_fold_out_baseline": f"WITH {_OOF} SELECT DISTINCT label, fold, round(q, 6) AS baseline FROM x",
    "error_metrics": f"""WITH {_OOF} SELECT label, count(*) AS rows, round(avg(e), 6) AS mae, round(sum(w * e) / sum(w), 6) AS weighted_mae, round(sqrt(avg(e * e)), 6) AS rmse, round(sqrt(sum(w * e * e) / sum(w)), 6) AS weighted_rmse,
        round(1 - sum(e * e) / (sum(y * y) - sum(y) * sum(y) / count(*)), 6) AS r2, round(1 - sum(w * e * e) / (sum(w * y * y) - sum(w * y) * sum(w * y) / sum(w)), 6) AS weighted_r2, round(avg(p - y), 6) AS bias,
        round(median(e), 6) AS median_abs_error, round(quantile_cont(e, 0.9), 6) AS p90_abs_error, round(quantile_cont(e, 0.95), 6) AS p95_abs_error, round(max(e), 6) AS max_abs_error, count(*) FILTER (e > 2) AS over_2, count(*) FILTER (e > 3) AS over_3, count(*) FILTER (e > 5) AS over_5 FROM x GROUP BY label""",
    "error_strata": f"WITH {_OOF}, u AS (SELECT 'global' AS scope, '' AS stratum, e FROM x UNION ALL SELECT 'family', family, e FROM x UNION ALL SELECT 'label', label, e FROM x) SELECT scope, stratum, count(*) AS rows, round(avg(e), 6) AS mae, round(median(e), 6) AS median, round(quantile_cont(e, 0.9), 6) AS p90, round(quantile_cont(e, 0.95), 6) AS p95 FROM u GROUP BY ALL",
    "group_balanced_mae": f"WITH {_OOF}, g AS (SELECT o_custkey, avg(e) AS m FROM x GROUP BY 1) SELECT count(*) AS groups, round(avg(m), 6) AS balanced_mae FROM g",
    "conformal_radius": f"WITH {_OOF}, r AS (SELECT label, abs(round(y, 6) - round(p, 6)) AS e, row_number() OVER (PARTITION BY label ORDER BY abs(round(y, 6) - round(p, 6))) AS k, count(*) OVER (PARTITION BY label) AS n FROM x), l AS (SELECT unnest([0.5, 0.8, 0.9, 0.95])::DOUBLE AS level), c AS (SELECT label, level, e AS radius FROM r, l WHERE k = least(n, ceil(round((n + 1) * level, 9)))) SELECT c.label, level, round(radius, 6) + 0.0 AS radius, round(count(*) FILTER (r.e <= radius) / count(*), 6) + 0.0 AS coverage FROM c JOIN r ON c.label = r.label GROUP BY c.label, level, radius",
    "group_bootstrap": f"""WITH {_OOF},g AS (SELECT o_custkey, sum(abs(y - q) - e) AS g, count(*) AS n FROM x GROUP BY 1), bb AS (SELECT *, ('0x' || substr(sha256(o_custkey || ':' || b), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM g, (SELECT unnest(range(1, 201)) AS b)),
        m AS (SELECT *, {_DRAWN} AS m FROM bb),
        t AS (SELECT b, sum(m * g) / sum(m * n) AS gain FROM m GROUP BY b) SELECT round(quantile_cont(gain, 0.05), 6) AS p05, round(quantile_cont(gain, 0.5), 6) AS p50, round(quantile_cont(gain, 0.95), 6) AS p95, round(avg((gain > 0)::INT), 6) AS p_gain FROM t""",
    "calibration_gate": f"""WITH {_OOF}, c AS (SELECT label, o_custkey, y - 15 AS y, p - 15 AS p, q - 15 AS q FROM x), t AS (SELECT label, count(*) AS rows, count(DISTINCT o_custkey) AS groups, avg(abs(y)) - avg(abs(y - p)) AS gz, avg(abs(y - q)) - avg(abs(y - p)) AS gb, avg(p - y) AS bias, corr(y, p) AS c FROM c GROUP BY 1)
        , g AS (SELECT label, o_custkey, sum(abs(y) - abs(y - p)) AS z, sum(abs(y - q) - abs(y - p)) AS k, count(*) AS n FROM c GROUP BY ALL), bb AS (SELECT *, ('0x' || substr(sha256(o_custkey || ':' || b), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM g, (SELECT unnest(range(1, 201)) AS b)),
        m AS (SELECT *, {_DRAWN} AS m FROM bb), v AS (SELECT label, b, sum(m * z) / sum(m * n) AS z, sum(m * k) / sum(m * n) AS k FROM m GROUP BY label, b), e AS (SELECT label, quantile_cont(z, 0.05) AS pz, quantile_cont(k, 0.05) AS pk FROM v GROUP BY label)
        SELECT label, rows, groups, round(gz, 6) AS gain_zero, round(gb, 6) AS gain_baseline, round(bias, 6) AS bias, round(c, 6) AS correlation, round(pz, 6) AS p05_zero, round(pk, 6) AS p05_baseline, CASE WHEN pz > 0 AND pk > 0 THEN 1.0 WHEN gz > 0 AND gb > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS scale FROM t JOIN e USING (label)""",
    "censored_score": f"""WITH {_OOF}, k AS (SELECT *, o_orderkey % 4 AS k FROM x) SELECT label, count(*) FILTER (k = 3) AS n_exact, round(avg(e) FILTER (k = 3), 6) AS exact_mae, round(avg(e) FILTER (k = 2), 6) AS approximate_mae, round(avg(CASE WHEN k = 0 THEN (p > y)::INT WHEN k = 1 THEN (p < y)::INT END), 6) AS bounds_satisfied,
        round(avg(CASE WHEN k = 0 THEN greatest(0, y - p) END), 6) AS lower_violation, round(avg(CASE WHEN k = 1 THEN greatest(0, p - y) END), 6) AS upper_violation FROM k GROUP BY label""",
    "portability_block": f"WITH {_OOF}, u AS (SELECT family, y, 'p' AS predictor, p FROM x UNION ALL SELECT family, y, 'q', q FROM x) SELECT family, predictor, count(*) AS rows, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(p - y), 6) AS bias, round(quantile_cont(abs(y - p), 0.9), 6) AS p90 FROM u GROUP BY ALL",
    "distribution_summary": f"WITH {_OOF} SELECT label, count(*) AS n, round(median(y), 6) AS median, round(quantile_cont(y, 0.9), 6) AS p90, round(quantile_cont(y, 0.95), 6) AS p95, round(quantile_cont(y, 0.99), 6) AS p99, round(max(y), 6) AS max FROM x GROUP BY 1",
    "hierarchical_calibration": f"""WITH {_OOF}, r AS (SELECT label, family, round(round(y, 6) - round(p, 6), 6) AS r FROM x), c AS (SELECT o_orderkey AS id, label, family, round(p, 6) AS p, round(15.0 - round(p, 6), 6) AS t FROM x),
        ln AS (SELECT label, count(*) AS n FROM r GROUP BY 1), fn AS (SELECT family, count(*) AS n FROM r GROUP BY 1), gn AS (SELECT count(*) AS n FROM r),
        w AS (SELECT label, family, ln.n AS ln, fn.n AS fn, gn.n AS gn, ln.n / (ln.n + 20) AS wl, (1 - ln.n / (ln.n + 20)) * fn.n / (fn.n + 40) AS wf, (1 - ln.n / (ln.n + 20)) * (1 - fn.n / (fn.n + 40)) AS wg FROM ln, fn, gn),
        tl AS (SELECT c.label, c.t, count(*) FILTER (r.r >= c.t) AS k FROM (SELECT DISTINCT label, t FROM c) c JOIN r ON c.label = r.label GROUP BY ALL), tf AS (SELECT c.family, c.t, count(*) FILTER (r.r >= c.t) AS k FROM (SELECT DISTINCT family, t FROM c) c JOIN r ON c.family = r.family GROUP BY ALL), tg AS (SELECT c.t, count(*) FILTER (r.r >= c.t) AS k FROM (SELECT DISTINCT t FROM c) c, r GROUP BY ALL),
        pl AS (SELECT w.label, w.family, r.r, wl / ln AS w FROM w JOIN r ON w.label = r.label UNION ALL SELECT w.label, w.family, r.r, wf / fn FROM w JOIN r ON w.family = r.family UNION ALL SELECT w.label, w.family, r.r, wg / gn FROM w, r),
        pv AS (SELECT label, family, r, sum(w) AS w FROM pl GROUP BY ALL), cum AS (SELECT label, family, r, round(sum(w) OVER (PARTITION BY label, family ORDER BY r), 12) AS c FROM pv), q AS (SELECT label, family, min(r) FILTER (c >= 0.05) AS lo, min(r) FILTER (c >= 0.95) AS hi FROM cum GROUP BY ALL)
        SELECT c.id, c.label, c.family, c.p, round(wl * (tl.k + 0.5) / (ln + 1) + wf * (tf.k + 0.5) / (fn + 1) + wg * (tg.k + 0.5) / (gn + 1), 6) AS prob, round(c.p + lo, 6) AS low, round(c.p + hi, 6) AS high
        FROM c JOIN w ON c.label = w.label AND c.family = w.family JOIN q ON c.label = q.label AND c.family = q.family JOIN tl ON c.label = tl.label AND c.t = tl.t JOIN tf ON c.family = tf.family AND c.t = tf.t JOIN tg ON c.t = tg.t""",
    "rank_gap": f"WITH r AS (SELECT l_orderkey, rn, l_extendedprice::DOUBLE AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, rn) AS rank FROM {NUMBERED}), t AS (SELECT *, max(x) OVER w AS top, coalesce(max(CASE WHEN rank = 2 THEN x END) OVER w, 0) AS second FROM r WINDOW w AS (PARTITION BY l_orderkey)) SELECT l_orderkey, rn, rank, round(top - second, 6) + 0.0 AS gap, round((top - second) / top, 6) + 0.0 AS gap_ratio, round((top - second) / top / rank, 6) + 0.0 AS confidence FROM t",
    "topk_hit_rate": f"WITH r AS (SELECT l_orderkey, l_returnflag = 'R' AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, rn) AS k FROM {NUMBERED}), h AS (SELECT l_orderkey, max(t::INT) AS hit FROM r WHERE k <= 2 GROUP BY 1) SELECT count(*) AS groups, round(avg(hit), 6) AS hit_rate FROM h",
    "best_threshold": f"WITH {_SC}, g AS (SELECT unnest(range(33)) AS i), t AS (SELECT i, avg((round((s - 0.1) / 0.025, 9) >= i)::INT) FILTER (quality = 1) AS tpr, avg((round((s - 0.1) / 0.025, 9) < i)::INT) FILTER (quality = 0) AS tnr FROM g, s GROUP BY i) SELECT round(0.1 + i * 0.025, 6)::DOUBLE AS threshold, round((tpr + tnr) / 2, 6) AS balanced_accuracy FROM t ORDER BY round((tpr + tnr) / 2, 12) DESC, i LIMIT 1",
    "threshold_margin_sweep": f"""WITH {_SC}, v AS (SELECT round(s, 3) AS s, (doc_id % 2)::INT AS c, quality AS t, lang = 'en' AS g FROM s), gr AS (SELECT i, j, round(0.15 + i * 0.025, 3)::DOUBLE AS th, round(j * 0.025, 3)::DOUBLE AS mg FROM (SELECT unnest(range(29)) AS i), (SELECT unnest(range(9)) AS j)),
        k AS (SELECT i, j, th, mg, t, g, c, CASE WHEN round(abs(s - th), 9) >= mg THEN (s >= th)::INT ELSE c END AS call FROM v, gr), a AS (SELECT i, j, th, mg, avg((call = t)::INT) AS acc, avg((call = t)::INT) FILTER (g) AS sub, count(*) FILTER (call <> c) AS ch FROM k GROUP BY ALL)
        SELECT th AS threshold, mg AS margin, round(acc, 6) AS accuracy, round(sub, 6) AS subgroup_accuracy, ch AS changed FROM a ORDER BY round(acc, 12) DESC, round(sub, 12) DESC, ch, i, j LIMIT 1""",
    "binary_metrics": f"""WITH {_SC}, v AS (SELECT s, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg FROM s GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY s DESC) AS tp, sum(neg) OVER (ORDER BY s DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM v)
        SELECT (max(p) + max(n))::BIGINT AS rows, round((sum(pos) FILTER (s >= 0.5) + sum(neg) FILTER (s < 0.5)) / (max(p) + max(n)), 6) AS accuracy, round((sum(pos) FILTER (s >= 0.5) / max(p) + sum(neg) FILTER (s < 0.5) / max(n)) / 2, 6) AS balanced_accuracy, round(sum(neg * (tp - pos / 2)) / (max(p) * max(n)), 6) AS roc_auc, round(sum(pos * tp / (tp + fp)) / max(p), 6) AS average_precision FROM c""",
    "random_group_split": "SELECT o_orderkey, o_custkey, ('0x' || substr(sha256('17:' || o_custkey), 1, 8))::BIGINT / 4294967296 < 0.2 AS is_test FROM orders",
    "rarest_first_split": f"WITH {_SIZES}, c AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z) SELECT o_custkey, n, before < (SELECT greatest(1, floor(sum(n) * 0.2)) FROM z) AS is_test FROM c",
    "group_kfold": f"WITH {_SIZES}, r AS (SELECT *, row_number() OVER (ORDER BY n DESC, o_custkey) - 1 AS r FROM z) SELECT o_custkey, n, CASE WHEN (r // 5) % 2 = 0 THEN r % 5 ELSE 4 - r % 5 END AS fold FROM r",
    "label_folds": "WITH c AS (SELECT c_custkey, c_nationkey::VARCHAR AS nation FROM customer) SELECT c_custkey, nation, (('0x' || substr(sha256(nation), 1, 8))::BIGINT % 5 + row_number() OVER (PARTITION BY nation ORDER BY sha256(c_custkey::VARCHAR), c_custkey) - 1) % 5 AS fold FROM c",
    "split_manifest": "WITH s AS (SELECT source, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM documents) SELECT source, count(*) AS n, string_agg(DISTINCT split, '|' ORDER BY split) AS splits, count(DISTINCT split) > 1 AS leaks FROM s GROUP BY 1",
    "fold_support": "WITH o AS (SELECT o_custkey, o_orderpriority AS label, o_custkey % 5 AS fold FROM orders), k AS (SELECT DISTINCT label, fold FROM o), j AS (SELECT k.label, k.fold, count(o.o_custkey) AS r, count(DISTINCT o.o_custkey) AS g FROM k LEFT JOIN o ON k.label = o.label AND k.fold <> o.fold GROUP BY ALL) SELECT label, fold, r AS rows_elsewhere, g AS groups_elsewhere, r = 0 AS zero_shot FROM j",
    "one_se_select": "WITH t AS (SELECT l_suppkey, l_orderkey % 4 AS split, avg(l_discount::DOUBLE) AS mae, max(l_tax::DOUBLE) AS p95 FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey, l_suppkey % 10 AS rank, avg(mae) AS mean, stddev_samp(mae) AS sd, avg(p95) AS tail, count(*) AS k FROM t GROUP BY 1, 2), l AS (SELECT mean + coalesce(sd, 0) / sqrt(k) AS lim FROM b ORDER BY mean, tail, l_suppkey LIMIT 1) SELECT l_suppkey, round(mean, 6) AS mean, round(lim, 6) AS \"limit\" FROM b, l WHERE mean <= lim ORDER BY rank, tail, l_suppkey LIMIT 1",
    "support_gate": f"WITH {_OOF} SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) >= 12 AS supported, round(CASE WHEN count(*) OVER (PARTITION BY o_custkey) >= 12 THEN p - q ELSE 0 END, 6) AS gated FROM x",
    "context_stats": f"""WITH x AS (SELECT l_orderkey, rn, l_extendedprice::DOUBLE AS x FROM {NUMBERED}) SELECT a.l_orderkey, a.rn, count(b.x) AS n, round(coalesce(min(b.x), 0), 6) + 0.0 AS low, round(coalesce(max(b.x), 0), 6) + 0.0 AS high, round(coalesce(avg(b.x), 0), 6) + 0.0 AS mean, round(coalesce(min(abs(a.x - b.x)), 0), 6) + 0.0 AS closest, count(*) FILTER (b.x < a.x) AS lower, count(*) FILTER (b.x > a.x) AS higher
        FROM x a LEFT JOIN x b ON a.l_orderkey = b.l_orderkey AND a.rn <> b.rn GROUP BY a.l_orderkey, a.rn, a.x""",
    "soft_assign": f"WITH x AS (SELECT l_orderkey, rn, exp(-abs(o_totalprice::DOUBLE / 40000 - l_extendedprice::DOUBLE / 10000) / 2) AS e FROM {NUMBERED} JOIN orders ON l_orderkey = o_orderkey) SELECT l_orderkey, rn, round(0.2 * e / sum(e) OVER (PARTITION BY l_orderkey), 9) AS weight FROM x",
    # each order's first two lines against the others, every pair of different steps tried
    "set_match": f"""WITH x AS (SELECT l_orderkey, rn, l_quantity::DOUBLE AS o, l_extendedprice::DOUBLE / 1000 AS p FROM {NUMBERED}),
        c AS (SELECT a.l_orderkey, min(abs(a.o - s.p) + abs(b.o - t.p)) AS cost FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.rn = 1 AND b.rn = 2 JOIN x s ON s.l_orderkey = a.l_orderkey AND s.rn > 2 JOIN x t ON t.l_orderkey = a.l_orderkey AND t.rn > 2 AND t.rn <> s.rn GROUP BY 1)
        SELECT l_orderkey, round(cost, 6) + 0.0 AS cost FROM (SELECT DISTINCT l_orderkey FROM x) LEFT JOIN c USING (l_orderkey)""",
    # all increasing choices of steps for one, two or three distinct values
    "set_match_rows": f"""WITH x AS (SELECT l_orderkey, rn, l_quantity::DOUBLE AS o, l_extendedprice::DOUBLE / 1000 AS p FROM {NUMBERED}),
        o AS (SELECT l_orderkey, o, row_number() OVER (PARTITION BY l_orderkey ORDER BY o) AS i, count(*) OVER (PARTITION BY l_orderkey) AS k FROM (SELECT DISTINCT l_orderkey, o FROM x WHERE rn <= 3)),
        s AS (SELECT l_orderkey, p, rn, row_number() OVER (PARTITION BY l_orderkey ORDER BY p, rn) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM x WHERE rn > 3),
        w AS (SELECT l_orderkey, max(o) FILTER (i = 1) AS a, max(o) FILTER (i = 2) AS b, max(o) FILTER (i = 3) AS c, any_value(k) AS k FROM o GROUP BY 1),
        z AS (SELECT w.*, coalesce(n, 0) AS n FROM w LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM s GROUP BY 1) USING (l_orderkey)),
        c1 AS (SELECT z.l_orderkey, k, z.n, a, b, c, s.i AS i1, NULL::BIGINT AS i2, NULL::BIGINT AS i3, abs(a - s.p) AS cost FROM z JOIN s ON z.l_orderkey = s.l_orderkey WHERE k <= z.n),
        c2 AS (SELECT c1.* REPLACE (s.i AS i2, cost + abs(b - s.p) AS cost) FROM c1 JOIN s ON s.l_orderkey = c1.l_orderkey AND s.i > i1 WHERE k >= 2),
        c3 AS (SELECT c2.* REPLACE (s.i AS i3, cost + abs(c - s.p) AS cost) FROM c2 JOIN s ON s.l_orderkey = c2.l_orderkey AND s.i > i2 WHERE k = 3),
        best AS (SELECT * FROM (SELECT * FROM c1 WHERE k = 1 UNION ALL SELECT * FROM c2 WHERE k = 2 UNION ALL SELECT * FROM c3) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY cost, i3, i2, i1) = 1),
        m AS (SELECT l_orderkey, a AS o, i1 AS i FROM best UNION ALL SELECT l_orderkey, b, i2 FROM best WHERE k >= 2 UNION ALL SELECT l_orderkey, c, i3 FROM best WHERE k = 3)
        SELECT m.l_orderkey, round(o, 6) + 0.0 AS observed, s.rn AS step, round(s.p, 6) + 0.0 AS predicted, 'matched' AS status FROM m JOIN s ON s.l_orderkey = m.l_orderkey AND s.i = m.i
        UNION ALL SELECT l_orderkey, NULL, NULL, NULL, 'set_larger_than_ladder' FROM z WHERE k > n""",
    "cluster_1d": """WITH RECURSIVE v AS (SELECT l_orderkey, x, row_number() OVER (PARTITION BY l_orderkey ORDER BY x) AS k FROM (SELECT DISTINCT l_orderkey, l_quantity::DOUBLE / 5 AS x FROM lineitem)),
        r AS (SELECT l_orderkey, k, x, x AS first, 1 AS c FROM v WHERE k = 1 UNION ALL SELECT v.l_orderkey, v.k, v.x, CASE WHEN round(v.x - r.x, 9) <= 1 AND round(v.x - first, 9) <= 2 THEN first ELSE v.x END, CASE WHEN round(v.x - r.x, 9) <= 1 AND round(v.x - first, 9) <= 2 THEN c ELSE c + 1 END FROM r JOIN v ON v.l_orderkey = r.l_orderkey AND v.k = r.k + 1)
        SELECT l_orderkey, min(x) AS first, max(x) AS last, count(*) AS n FROM r GROUP BY l_orderkey, c""",
}
