"""Model queries. Fitted trees have no SQL; linear models have their normal equations, logistic ones Newton's steps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.operators import metrics as m
from calibrant.operators import models as md
from calibrant.functions import scalars as s
from calibrant.plans.common import r6, read
from calibrant.plans import metrics as m_plans
from calibrant.plans import states as st_plans
from calibrant.plans.states import coupling_effect, interval_marginals

FOLDS = 3


def _orders(spark, d):
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("double")).alias("qty"), F.avg(F.col("l_discount").cast("double")).alias("disc"))
    o = read(spark, d, "orders").join(lines, "o_orderkey").select("o_orderkey", "o_custkey", "o_orderpriority", "n", "qty", "disc", (F.col("o_totalprice").cast("double") / 10000).alias("y"), (1.0 + F.col("o_orderkey") % 3).alias("w"), (F.col("o_custkey") % FOLDS).cast("int").alias("fold"))
    return md.assemble(o, ["n", "qty", "disc"])


def oof_regression(spark, d):
    oof = md.oof_predict(_orders(spark, d), md.candidates()["gbt_squared"], FOLDS)
    return oof.select("o_orderkey", "fold", r6("y").alias("y"), r6("p").alias("p"))


def candidate_scores(spark, d):
    """Each candidate's held-out errors and the one that the one-standard-error rule takes."""
    rank = {name: i for i, name in enumerate(sorted(md.candidates(), key=lambda c: (c != "linear", c)))}  # simplest first
    oof = md.oof_predict_each(_orders(spark, d), md.candidates(), FOLDS)
    each = [t.select(F.lit(name).alias("candidate"), F.lit(rank[name]).alias("rank"), "fold", "y", "w", "p") for name, t in oof.items()]
    out = m.error_metrics(reduce(DataFrame.unionByName, each), "candidate", "rank", "fold").select("candidate", "rank", "mae", F.col("p95_abs_error").alias("p95"))
    return m.one_se_select(out, "candidate", "mae", "p95", "rank").select("candidate", r6("mean").alias("mean"))


def supplement_gate(spark, d):
    o = _orders(spark, d)
    got = md.supplement_gate(o.where("o_custkey % 2 = 0"), o.where("o_custkey % 2 = 1"), md.candidates()["linear"], FOLDS)
    return spark.createDataFrame([(round(float(got["mae_without"]), 6), round(float(got["mae_with"]), 6), bool(got["deploy"]))], "mae_without double, mae_with double, deploy boolean")


def rank_classifier(spark, d):
    """Lines ranked by a classifier; the share of orders whose best line is a returned one."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").cast("int").alias("t"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("c"), F.datediff("l_shipdate", F.lit("1992-01-01")).alias("day"), (F.col("l_orderkey") % FOLDS).cast("int").alias("fold"))
    scored = md.rank_classifier(md.assemble(lines, ["q", "c", "day"]), "t", FOLDS)
    t = m.topk_hit_rate(scored.withColumn("score", F.round("score", 9)), "l_orderkey", "score", F.col("t") == 1, ["l_linenumber", "day", "q"], 1)
    return t.select("groups", r6("hit_rate").alias("hit_rate"))


def form_head(spark, d):
    """Quality from hashed token pairs, with a balanced logistic head."""
    docs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select("doc_id", "quality", F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+").alias("tokens"))
    bits = md.token_bits(docs, "tokens")
    out = md.form_head(bits.where("doc_id % 2 = 0"), "quality").transform(bits.where("doc_id % 2 = 1"))
    return out.select("doc_id", "quality", F.col("prediction").cast("int").alias("predicted"))


def _head_rows(spark, d):
    n = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).cast("double").alias("lines"))
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("acid"), (F.col("o_totalprice").cast("double") / 100000).alias("price"))
    return o.join(n, "o_orderkey")


def form_heads(spark, d):
    """A head per priority for an order's status, from its price and number of lines; every fifth customer is held out."""
    t = md.form_heads(_head_rows(spark, d), "o_orderpriority", "acid", ["price", "lines"], F.col("o_custkey") % 5 != 0)
    beta = [F.round(F.get("beta", F.lit(i)), 4).alias(f"b{i}") for i in range(3)]
    return t.select("o_orderpriority", "rows", "status", *beta, F.round("threshold", 6).alias("threshold"), F.round("margin", 6).alias("margin"), F.round("balanced_accuracy", 6).alias("balanced_accuracy"))


def form_calls(spark, d):
    """Those heads applied to every order."""
    rows = _head_rows(spark, d)
    heads = md.form_heads(rows, "o_orderpriority", "acid", ["price", "lines"], F.col("o_custkey") % 5 != 0)
    return md.apply_heads(rows, heads, "o_orderpriority", ["price", "lines"]).select("o_orderkey", F.round("probability", 4).alias("probability"))


def batch_score(spark, d):
    """The batch call as one plan. Per site the call at the level; confidence from the interval scenarios (D47), the
    calibrated probability of the order (D45), its label's support in other folds (D53) and what couplings change (D48)."""
    at = lambda name: F.max(F.when(F.col("scenario") == name, F.col("p_acid")))
    sites = interval_marginals(spark, d).groupBy("graph_id", "site_id").agg(at("low").alias("low"), at("mid").alias("p"), at("high").alias("high"), F.lit(True).alias("complete"))
    order = read(spark, d, "orders").select(F.col("o_orderkey").alias("graph_id"), F.col("o_orderpriority").alias("label"), (F.col("o_custkey") % m_plans.FOLDS).alias("fold"))
    fits = m_plans.fold_support(spark, d).select("label", "fold", F.when(F.col("zero_shot"), "none").when(F.col("groups_elsewhere") >= 1000, "high").when(F.col("groups_elsewhere") >= 100, "medium").otherwise("low").alias("support"))
    calibrated = m_plans.hierarchical_calibration(spark, d).select(F.col("id").alias("graph_id"), F.greatest(F.col("prob"), 1 - F.col("prob")).alias("empirical"))
    gaps = coupling_effect(spark, d).select("graph_id", F.col("largest").alias("gap"), F.when(F.col("largest") > 0, "screened_coupling").otherwise("direct").alias("kind"))
    t = sites.join(order, "graph_id").join(fits, ["label", "fold"]).join(calibrated, "graph_id").join(gaps, "graph_id")
    conf = s.site_confidence("p", s.interval_confidence(F.least("low", "high"), F.greatest("low", "high")), "empirical", "support", "gap", "complete", "kind")
    return t.select("graph_id", "site_id", s.state_call("p").alias("call"), r6(conf).alias("confidence"), s.confidence_tier(F.round(conf, 9)).alias("tier"), "support")


QUERIES = {f.__name__: f for f in (oof_regression, candidate_scores, supplement_gate, rank_classifier, form_head, form_heads, form_calls, batch_score)}

_TIER = "CASE WHEN round(c, 9) >= 0.7 THEN 'high' WHEN round(c, 9) >= 0.4 THEN 'medium' WHEN round(c, 9) >= 0.1 THEN 'low' ELSE 'very_low' END"


def _det(*m: str) -> str:
    """Determinant of a matrix of three rows."""
    a, b, c, d, e, f, g, h, i = m
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


#: Newton's method unrolled: sums by family, then the three equations by Cramer's rule.
_H = ("h00", "h01", "h02", "h01", "(h11 + 1)", "h12", "h02", "h12", "(h22 + 1)")
_G = ("g0", "(g1 + b1)", "(g2 + b2)")
_STEP = ", ".join(f"b{k} - {_det(*[_G[i // 3] if i % 3 == k else _H[i] for i in range(9)])} / {_det(*_H)} AS b{k}" for k in range(3))
_HEADS = """n AS (SELECT l_orderkey, count(*)::DOUBLE AS x2 FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, o_orderpriority AS f, (o_orderstatus = 'F')::INT AS y, o_totalprice::DOUBLE / 100000 AS x1, x2, o_custkey % 5 <> 0 AS t FROM orders JOIN n ON o_orderkey = l_orderkey),
    s AS MATERIALIZED (SELECT f, count(*) AS rows, avg(x1) FILTER (t) AS m1, avg(x2) FILTER (t) AS m2, stddev_pop(x1) FILTER (t) AS s1, stddev_pop(x2) FILTER (t) AS s2, count(*) FILTER (t) / 2 / count(*) FILTER (t AND y = 1) AS wp, count(*) FILTER (t) / 2 / count(*) FILTER (t AND y = 0) AS wn FROM o GROUP BY f),
    z AS MATERIALIZED (SELECT o_orderkey, o.f, y, t, (x1 - m1) / s1 AS z1, (x2 - m2) / s2 AS z2, CASE y WHEN 1 THEN wp ELSE wn END AS w FROM o JOIN s ON o.f = s.f), b0 AS (SELECT f, 0::DOUBLE AS b0, 0::DOUBLE AS b1, 0::DOUBLE AS b2 FROM s), """ + ", ".join(
    f"b{k} AS MATERIALIZED (SELECT f, {_STEP} FROM (SELECT f, b0, b1, b2, sum(w * (q - y)) AS g0, sum(w * (q - y) * z1) AS g1, sum(w * (q - y) * z2) AS g2, sum(v) AS h00, sum(v * z1) AS h01, sum(v * z2) AS h02, sum(v * z1 * z1) AS h11, sum(v * z1 * z2) AS h12, sum(v * z2 * z2) AS h22"
    f" FROM (SELECT *, w * q * (1 - q) AS v FROM (SELECT z.*, b0, b1, b2, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) AS q FROM z JOIN b{k - 1} b ON z.f = b.f WHERE t)) GROUP BY f, b0, b1, b2))"
    for k in range(1, 10)
) + ", q AS (SELECT o_orderkey, z.f, y, t, 1 / (1 + exp(-(b0 + b1 * z1 + b2 * z2))) AS q FROM z JOIN b9 b ON z.f = b.f)"

#: The rows of the linear models: fold, three features, target, weight.
LINEAR_ROWS = """lo AS (SELECT o_orderkey, o_custkey, o_orderpriority AS label, (o_custkey % 3)::INT AS fold, n AS x1, qty AS x2, disc AS x3, o_totalprice::DOUBLE / 10000 AS y, 1.0::DOUBLE + o_orderkey % 3 AS w
    FROM orders JOIN (SELECT l_orderkey, count(*)::DOUBLE AS n, sum(l_quantity::DOUBLE) AS qty, avg(l_discount::DOUBLE) AS disc FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def linear_fit(name: str, rows: str, ridge: float = 0.01) -> str:
    """SQL tables up to ``name`` (f, b0..b3): the weighted ridge regression of y on x1, x2, x3 over the rows of all folds but f, with features and
    target scaled to unit variance for the penalty: normal equations of correlations by Cramer's rule."""
    x = ("x1", "x2", "x3")
    means = ", ".join(f"sum(w * {c}) / sum(w) AS m_{c}" for c in (*x, "y"))
    seconds = ", ".join(f"sum(w * {a} * {b}) / sum(w) AS s_{a}{b}" for i, a in enumerate((*x, "y")) for b in (*x, "y")[i:])
    cov = lambda a, b: f"(s_{a}{b} - m_{a} * m_{b})"
    sd = ", ".join(f"sqrt({cov(c, c)}) AS d_{c}" for c in (*x, "y"))
    first = lambda a, b: (a, b) if a <= b else (b, a)
    matrix = [f"({cov(*first(a, b))} / (d_{a} * d_{b}){f' + {ridge} / d_y' if a == b else ''})" for a in x for b in x]
    right = [f"({cov(a, 'y')} / d_{a})" for a in x]
    slopes = ", ".join(f"{_det(*[right[i // 3] if i % 3 == k else matrix[i] for i in range(9)])} / {_det(*matrix)} / d_{c} AS b{k + 1}" for k, c in enumerate(x))
    return (
        f"{name}_m AS (SELECT f, {means}, {seconds} FROM {rows}, (SELECT unnest(range(3)) AS f) WHERE fold <> f GROUP BY f), {name}_d AS (SELECT *, {sd} FROM {name}_m),"
        f" {name}_b AS (SELECT *, {slopes} FROM {name}_d), {name} AS MATERIALIZED (SELECT f, m_y - b1 * m_x1 - b2 * m_x2 - b3 * m_x3 AS b0, b1, b2, b3 FROM {name}_b)"
    )


LINEAR = "b0 + b1 * x1 + b2 * x2 + b3 * x3"

SQL = {
    "supplement_gate": f"""WITH {LINEAR_ROWS}, own AS (SELECT * FROM lo WHERE o_custkey % 2 = 0), {linear_fit("alone", "own")}, {linear_fit("pooled", "lo")},
        e AS (SELECT w, abs(y - (a.b0 + a.b1 * x1 + a.b2 * x2 + a.b3 * x3)) AS ea, abs(y - (b.b0 + b.b1 * x1 + b.b2 * x2 + b.b3 * x3)) AS eb FROM own JOIN alone a ON a.f = fold JOIN pooled b ON b.f = fold)
        SELECT round(avg(ea), 6) AS mae_without, round(avg(eb), 6) AS mae_with, avg(eb) <= avg(ea) AND sum(w * eb) <= sum(w * ea) AS deploy FROM e""",
    "form_heads": f"""WITH {_HEADS}, g AS (SELECT f, i, 0.1 + i * 0.025 AS threshold, round((count(*) FILTER (y = 1 AND k >= i) / count(*) FILTER (y = 1) + count(*) FILTER (y = 0 AND k < i) / count(*) FILTER (y = 0)) / 2, 12) AS ba FROM (SELECT *, floor(round((q - 0.1) / 0.025, 9)) AS k FROM q WHERE NOT t), range(33) r(i) GROUP BY ALL),
        a AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY f ORDER BY ba DESC, i) = 1)
        SELECT s.f AS o_orderpriority, rows, 'trained' AS status, round(b0, 4) AS b0, round(b1, 4) AS b1, round(b2, 4) AS b2, round(threshold::DOUBLE, 6) AS threshold, round(greatest(0.05, least(0.2, 0.5 * abs(threshold::DOUBLE - 0.5))), 6) AS margin, round(ba, 6) AS balanced_accuracy FROM s JOIN b9 ON s.f = b9.f JOIN a ON s.f = a.f""",
    "form_calls": f"WITH {_HEADS} SELECT o_orderkey, round(q, 4) AS probability FROM q",
    "batch_score": f"""WITH im AS ({st_plans.SQL["interval_marginals"]}), hc AS ({m_plans.SQL["hierarchical_calibration"]}), fs AS ({m_plans.SQL["fold_support"]}), ce AS ({st_plans.SQL["coupling_effect"]}),
        p AS (SELECT graph_id, site_id, max(p_acid) FILTER (scenario = 'low') AS a, max(p_acid) FILTER (scenario = 'mid') AS p, max(p_acid) FILTER (scenario = 'high') AS z FROM im GROUP BY ALL),
        t AS (SELECT p.*, greatest(hc.prob, 1 - hc.prob) AS emp, CASE WHEN zero_shot THEN 'none' WHEN groups_elsewhere >= 1000 THEN 'high' WHEN groups_elsewhere >= 100 THEN 'medium' ELSE 'low' END AS support, largest FROM p JOIN orders ON p.graph_id = o_orderkey JOIN hc ON p.graph_id = hc.id JOIN fs ON fs.label = o_orderpriority AND fs.fold = o_custkey % 5 JOIN ce ON p.graph_id = ce.graph_id),
        c AS (SELECT *, greatest(0.0, least(1.0, 2 * emp - 1)) * abs(2 * p - 1) * CASE WHEN least(a, z) >= 0.5 THEN 2 * (least(a, z) - 0.5) WHEN greatest(a, z) <= 0.5 THEN 2 * (0.5 - greatest(a, z)) ELSE 0 END * CASE support WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.8 WHEN 'low' THEN 0.55 ELSE 0.3 END * exp(-largest) * CASE WHEN largest > 0 THEN 0.55 ELSE 1.0 END AS c FROM t)
        SELECT graph_id, site_id, CASE WHEN p >= 0.5 THEN 'acid_form' ELSE 'base_form' END AS call, round(c::DOUBLE, 6) + 0.0 AS confidence, {_TIER} AS tier, support FROM c""",
}
