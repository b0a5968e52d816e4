"""State-graph queries: an order is a graph and its lines are the sites; orders of over 12 lines
(more than 4096 states) are unavailable."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibrant.operators import states
from calibrant.plans.common import LINE_ORDER, NUMBERED, numbered, r6, read

LEVEL = 7.4


def _sites(spark, d):
    lines = numbered(read(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", *LINE_ORDER))
    return lines.select(F.col("l_orderkey").alias("graph_id"), F.col("rn").alias("site_id"), (2 + F.col("l_quantity").cast("double") / 5).alias("b"), F.col("l_discount").cast("double").alias("disc"))


def _graphs(spark, d):
    return states.graphs(_sites(spark, d), coupling=lambda a, b: -100 * a["disc"] * b["disc"])


def state_populations(spark, d):
    rows = states.state_rows(_graphs(spark, d), LEVEL)
    return rows.select("graph_id", F.col("state").cast("long").alias("state"), F.col("n").cast("long").alias("n"), r6("weight").alias("weight"), r6("population").alias("population"))


def population_summary(spark, d):
    """Summaries per graph; those of unavailable graphs are null, their dominant state -1."""
    g = states.with_summary(_graphs(spark, d), LEVEL)
    return g.select("graph_id", "n_states", "available", r6("log10z").alias("log10z"), r6("entropy").alias("entropy"), r6("effective").alias("effective"), F.coalesce("dominant", F.lit(-1)).cast("long").alias("dominant"), r6("gap").alias("gap"))


def site_marginals(spark, d):
    return states.marginals(_graphs(spark, d), LEVEL).select("graph_id", F.col("site_id").cast("long").alias("site_id"), r6("p_acid").alias("p_acid"))


def macro_ladder(spark, d):
    return states.ladder(_graphs(spark, d)).select("graph_id", F.col("step").cast("long").alias("step"), r6("value").alias("value"))


def contextual_edges(spark, d):
    return states.edges(_graphs(spark, d)).select("graph_id", F.col("site_id").cast("long").alias("site_id"), F.col("base_state").cast("long").alias("base_state"), F.col("acid_state").cast("long").alias("acid_state"), r6("value").alias("value"), r6("cycle_error").alias("cycle_error"))


def site_ranges(spark, d):
    """Least and largest transition value of every site over all backgrounds, and that of the dominant background; orders
    of any number of lines, but the latter of available ones only."""
    site = _sites(spark, d)
    other = site.select("graph_id", F.col("site_id").alias("site_j"), F.col("disc").alias("other"))
    pairs = site.join(other, "graph_id").where("site_id < site_j").select("graph_id", F.col("site_id").alias("site_i"), "site_j", (-100 * F.col("disc") * F.col("other")).alias("j"))
    top = states.at_dominant(states.with_summary(_graphs(spark, d), LEVEL))
    t = states.site_ranges(site, pairs).join(top, ["graph_id", "site_id"], "left")
    return t.select("graph_id", F.col("site_id").cast("long").alias("site_id"), *[r6(c).alias(c) for c in ("low", "high", "spread", "value")])


def independent_ladder(spark, d):
    return states.independent_ladder(_sites(spark, d).select("graph_id", "b")).select("graph_id", F.col("step").cast("long").alias("step"), r6("value").alias("value"))


def interval_marginals(spark, d):
    """Marginals again with every one-body term half a unit lower and higher."""
    out = states.scenario_marginals(_graphs(spark, d), LEVEL, {"low": -0.5, "mid": 0.0, "high": 0.5})
    return out.select("scenario", "graph_id", F.col("site_id").cast("long").alias("site_id"), r6("p_acid").alias("p_acid"))


def coupling_effect(spark, d):
    """Sites whose call changes without couplings."""
    return states.coupling_change(_graphs(spark, d), LEVEL).select("graph_id", F.col("changed").cast("long").alias("changed"), r6("largest").alias("largest"))


def log10_sum(spark, d):
    rows = read(spark, d, "orders").select("o_custkey", (F.col("o_totalprice").cast("double") / 10000).alias("x"))
    return states.log10_sum_by(rows, "x", "o_custkey").select("o_custkey", r6("log10_sum").alias("log10_sum"))


def order_violation(spark, d):
    return states.order_violation(numbered(read(spark, d, "lineitem")), "l_orderkey", "rn", "l_extendedprice")


def monotone_projection(spark, d):
    rows = numbered(read(spark, d, "lineitem")).select("l_orderkey", "rn", F.col("l_extendedprice").cast("double").alias("price"))
    return states.monotone_projection(rows, "l_orderkey", "rn", "price").select("l_orderkey", F.col("rn").cast("long").alias("rn"), F.round("fitted", 6).alias("fitted"))


def projection_with_fixed(spark, d):
    rows = numbered(read(spark, d, "lineitem")).select("l_orderkey", "rn", F.col("l_extendedprice").cast("double").alias("price"), (F.col("l_returnflag") == "R").alias("fixed"))
    return states.projection_with_fixed(rows, "l_orderkey", "rn", "price", "fixed").select("l_orderkey", F.col("rn").cast("long").alias("rn"), "fixed", F.round("fitted", 6).alias("fitted"))


def softmax_rank(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_partkey", F.col("l_suppkey").alias("item")).agg(F.max(F.col("l_quantity").cast("double")).alias("score"))
    out = states.softmax_rank(rows, "l_partkey", "score", "item")
    return out.select("l_partkey", "item", F.col("rank").cast("long").alias("rank"), r6("share").alias("share"), "tied", "n_items", "truncated", r6("effective").alias("effective"))


def dominant_then_best(spark, d):
    """The dominant state of each order, then its best-priced site on the acid side."""
    lines = numbered(read(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", *LINE_ORDER))
    site = lines.select(F.col("l_orderkey").alias("graph_id"), F.col("rn").alias("site_id"), (2 + F.col("l_quantity").cast("double") / 5).alias("b"), F.col("l_discount").cast("double").alias("disc"), F.col("l_extendedprice").cast("double").alias("price"))
    g = states.with_summary(states.graphs(site, coupling=lambda a, b: -100 * a["disc"] * b["disc"]), LEVEL).where("available")
    inside = F.filter("sites", lambda s: F.call_function("shiftright", F.col("dominant"), s["site_id"] - 1).bitwiseAND(1) == 1)
    best = F.array_max(F.transform(inside, lambda s: F.struct(s["price"].alias("price"), (-s["site_id"]).alias("k"))))
    t = g.select("graph_id", "dominant", best.alias("b")).where("b is not null")
    return t.select("graph_id", F.col("dominant").cast("long").alias("dominant"), (-F.col("b.k")).cast("long").alias("best_site"))


def coupling_scan(spark, d):
    """The target ladder is the sorted one-body terms less 0.3 a step."""
    terms = _sites(spark, d).groupBy("graph_id").agg(F.collect_list("b").alias("b")).where(F.size("b") >= 2)
    t = states.coupling_scan(terms.withColumn("target", F.transform(F.sort_array("b", asc=False), lambda b, i: b - 0.3 * i)))
    return t.select("graph_id", F.round(F.col("coupling") * 10).cast("long").alias("j10"), "loss")


QUERIES = {f.__name__: f for f in (state_populations, population_summary, site_marginals, macro_ladder, contextual_edges, site_ranges, independent_ladder, interval_marginals, coupling_effect, log10_sum, order_violation, monotone_projection, projection_with_fixed, softmax_rank, dominant_then_best, coupling_scan)}

_S = f"""s AS (SELECT l_orderkey AS graph_id, rn AS site_id, 2 + l_quantity::DOUBLE / 5 AS b, l_discount::DOUBLE AS disc FROM {NUMBERED}),
k AS (SELECT graph_id, count(*) AS k FROM s GROUP BY graph_id HAVING count(*) <= 12),
st AS (SELECT graph_id, k, unnest(range(0, (1 << k)::BIGINT)) AS state FROM k),
oc AS (SELECT st.graph_id, state, site_id, b, disc FROM st JOIN s ON st.graph_id = s.graph_id WHERE (state >> (site_id - 1)) & 1 = 1),
pw AS (SELECT x.graph_id, x.state, sum(-100 * x.disc * y.disc) AS w FROM oc x JOIN oc y ON x.graph_id = y.graph_id AND x.state = y.state AND x.site_id < y.site_id GROUP BY ALL),
ow AS (SELECT graph_id, state, sum(b) AS w, count(*) AS n FROM oc GROUP BY ALL),
w AS (SELECT st.graph_id, st.state, k, coalesce(n, 0) AS n, coalesce(ow.w, 0) + coalesce(pw.w, 0) AS weight FROM st LEFT JOIN ow ON st.graph_id = ow.graph_id AND st.state = ow.state LEFT JOIN pw ON st.graph_id = pw.graph_id AND st.state = pw.state),
e AS (SELECT *, weight - n * 7.4 AS e, max(weight - n * 7.4) OVER (PARTITION BY graph_id) AS top FROM w),
p AS (SELECT *, top + log10(sum(pow(10, e - top)) OVER (PARTITION BY graph_id)) AS z FROM e),
q AS (SELECT *, pow(10, e - z) AS p FROM p)"""
_ANY = _S.replace(" HAVING count(*) <= 12", "")
_MARGINAL = "SELECT s.graph_id, s.site_id, round(sum(CASE WHEN (state >> (site_id - 1)) & 1 = 1 THEN p ELSE 0 END), 6) + 0.0 AS p_acid FROM s JOIN q ON s.graph_id = q.graph_id GROUP BY s.graph_id, s.site_id"

SQL = {
    "state_populations": f"WITH {_S} SELECT graph_id, state, n, round(weight, 6) + 0.0 AS weight, round(p, 6) + 0.0 AS population FROM q",
    "population_summary": f"""WITH {_S}, r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY round(p, 9) DESC, state) AS rk FROM q),
        o AS (SELECT graph_id, round(max(z), 6) + 0.0 AS log10z, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) + 0.0 AS entropy,
        round(exp(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)), 6) + 0.0 AS effective, max(CASE WHEN rk = 1 THEN state END) AS dominant,
        round(max(CASE WHEN rk = 1 THEN p END) - coalesce(max(CASE WHEN rk = 2 THEN p END), 0), 6) + 0.0 AS gap FROM r GROUP BY graph_id)
        SELECT a.graph_id, (1 << a.k)::BIGINT AS n_states, a.k <= 12 AS available, log10z, entropy, effective, coalesce(dominant, -1) AS dominant, gap FROM (SELECT graph_id, count(*) AS k FROM s GROUP BY graph_id) a LEFT JOIN o ON a.graph_id = o.graph_id""",
    "site_marginals": f"WITH {_S} {_MARGINAL}",
    "site_ranges": f"""WITH {_S}, j AS (SELECT x.graph_id, x.site_id, x.b, coalesce(sum(least(-100 * x.disc * y.disc, 0)), 0) AS lo, coalesce(sum(greatest(-100 * x.disc * y.disc, 0)), 0) AS hi FROM s x LEFT JOIN s y ON x.graph_id = y.graph_id AND x.site_id <> y.site_id GROUP BY ALL),
        d AS (SELECT graph_id, state FROM q QUALIFY row_number() OVER (PARTITION BY graph_id ORDER BY round(p, 9) DESC, state) = 1),
        v AS (SELECT s.graph_id, s.site_id, any_value(s.b) + coalesce(sum(CASE WHEN y.site_id <> s.site_id AND (state >> (y.site_id - 1)) & 1 = 1 THEN -100 * s.disc * y.disc END), 0) AS v FROM s JOIN d ON s.graph_id = d.graph_id JOIN s y ON y.graph_id = s.graph_id GROUP BY s.graph_id, s.site_id)
        SELECT j.graph_id, j.site_id, round(b + lo, 6) + 0.0 AS low, round(b + hi, 6) + 0.0 AS high, round(hi - lo, 6) + 0.0 AS spread, round(v, 6) + 0.0 AS "value" FROM j LEFT JOIN v ON j.graph_id = v.graph_id AND j.site_id = v.site_id""",
    "macro_ladder": f"""WITH {_S}, z AS (SELECT graph_id, n, max(weight) AS m FROM w GROUP BY ALL),
        l AS (SELECT w.graph_id, w.n, m + log10(sum(pow(10, weight - m))) AS lz FROM w JOIN z ON w.graph_id = z.graph_id AND w.n = z.n GROUP BY w.graph_id, w.n, m),
        d AS (SELECT graph_id, n AS step, lz - lag(lz) OVER (PARTITION BY graph_id ORDER BY n) AS value FROM l)
        SELECT graph_id, step, round(value, 6) + 0.0 AS value FROM d WHERE step > 0""",
    "contextual_edges": f"""WITH {_S}, ed AS (SELECT w.graph_id, site_id, state AS base_state, state + (1 << (site_id - 1)) AS acid_state, b, disc, weight FROM w JOIN s ON w.graph_id = s.graph_id WHERE (state >> (site_id - 1)) & 1 = 0),
        c AS (SELECT ed.graph_id, ed.site_id, base_state, acid_state, any_value(ed.b) + coalesce(sum(-100 * ed.disc * oc.disc), 0) AS value, any_value(ed.weight) AS w0 FROM ed LEFT JOIN oc ON ed.graph_id = oc.graph_id AND ed.base_state = oc.state GROUP BY ALL)
        SELECT c.graph_id, site_id, base_state, acid_state, round(value, 6) + 0.0 AS value, round(abs(w.weight - w0 - value), 6) + 0.0 AS cycle_error FROM c JOIN w ON c.graph_id = w.graph_id AND c.acid_state = w.state""",
    "independent_ladder": f"""WITH {_ANY}, o AS (SELECT st.graph_id, st.state, coalesce(w, 0) AS w, coalesce(n, 0) AS n FROM st LEFT JOIN ow ON st.graph_id = ow.graph_id AND st.state = ow.state),
        z AS (SELECT graph_id, n, max(w) + log10(sum(pow(10, w - m))) AS lz FROM (SELECT *, max(w) OVER (PARTITION BY graph_id, n) AS m FROM o) GROUP BY ALL), d AS (SELECT graph_id, n AS step, lz - lag(lz) OVER (PARTITION BY graph_id ORDER BY n) AS value FROM z)
        SELECT graph_id, step, round(value, 6) + 0.0 AS value FROM d WHERE step > 0""",
    "interval_marginals": " UNION ALL ".join(f"(WITH {_S.replace('2 + l_quantity::DOUBLE / 5 AS b', f'2 + l_quantity::DOUBLE / 5 + ({shift}) AS b')} SELECT '{name}' AS scenario, * FROM ({_MARGINAL}))" for name, shift in (("low", -0.5), ("mid", 0.0), ("high", 0.5))),
    "coupling_effect": f"""WITH a AS (WITH {_S} SELECT s.graph_id, site_id, sum(CASE WHEN (state >> (site_id - 1)) & 1 = 1 THEN p ELSE 0 END) AS p FROM s JOIN q ON s.graph_id = q.graph_id GROUP BY ALL),
        f AS (WITH {_S.replace('-100 * x.disc * y.disc', '0.0')} SELECT s.graph_id, site_id, sum(CASE WHEN (state >> (site_id - 1)) & 1 = 1 THEN p ELSE 0 END) AS p FROM s JOIN q ON s.graph_id = q.graph_id GROUP BY ALL)
        SELECT a.graph_id, count(*) FILTER ((round(a.p, 9) >= 0.5) <> (round(f.p, 9) >= 0.5)) AS changed, round(max(abs(a.p - f.p)), 6) + 0.0 AS largest FROM a JOIN f ON a.graph_id = f.graph_id AND a.site_id = f.site_id GROUP BY a.graph_id""",
    "log10_sum": "WITH x AS (SELECT o_custkey, o_totalprice::DOUBLE / 10000 AS x FROM orders), m AS (SELECT o_custkey, max(x) AS m FROM x GROUP BY 1) SELECT x.o_custkey, round(max(m) + log10(sum(pow(10, x - m))), 6) + 0.0 AS log10_sum FROM x JOIN m ON x.o_custkey = m.o_custkey GROUP BY 1",
    "order_violation": f"WITH v AS (SELECT l_orderkey, l_extendedprice > lag(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY rn) AS up FROM {NUMBERED}) SELECT l_orderkey, coalesce(bool_or(up), false) AS violated FROM v GROUP BY 1",
    "monotone_projection": f"""WITH v AS (SELECT l_orderkey AS g, rn, l_extendedprice::DOUBLE AS v, sum(l_extendedprice::DOUBLE) OVER (PARTITION BY l_orderkey ORDER BY rn) AS c FROM {NUMBERED}),
        m AS (SELECT a.g, a.rn AS i, b.rn AS j, (b.c - a.c + a.v) / (b.rn - a.rn + 1) AS mean FROM v a JOIN v b ON a.g = b.g AND a.rn <= b.rn),
        x AS (SELECT v.g, v.rn, m.i, max(mean) AS hi FROM v JOIN m ON v.g = m.g AND m.i <= v.rn AND m.j >= v.rn GROUP BY ALL)
        SELECT g AS l_orderkey, rn, round(min(hi), 6) AS fitted FROM x GROUP BY g, rn""",
    "softmax_rank": """WITH s AS (SELECT l_partkey, l_suppkey AS item, max(l_quantity::DOUBLE) AS score FROM lineitem GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, item) AS rank, count(*) OVER (PARTITION BY l_partkey) AS n_items FROM s),
        t AS (SELECT *, exp((score - max(score) OVER (PARTITION BY l_partkey)) / 5) AS e, count(*) OVER (PARTITION BY l_partkey, score) > 1 AS tied FROM r WHERE rank <= 16),
        u AS (SELECT *, e / sum(e) OVER (PARTITION BY l_partkey) AS share FROM t)
        SELECT l_partkey, item, rank, round(share, 6) AS share, tied, n_items, n_items > 16 AS truncated, round(exp(-sum(CASE WHEN share > 0 THEN share * ln(share) ELSE 0 END) OVER (PARTITION BY l_partkey)), 6) AS effective FROM u""",
    "dominant_then_best": f"""WITH {_S}, r AS (SELECT graph_id, state, row_number() OVER (PARTITION BY graph_id ORDER BY round(p, 9) DESC, state) AS rk FROM q),
        l AS (SELECT r.graph_id, state, n.rn, row_number() OVER (PARTITION BY r.graph_id ORDER BY l_extendedprice DESC, n.rn) AS o FROM r JOIN {NUMBERED} n ON r.graph_id = n.l_orderkey WHERE rk = 1 AND (state >> (n.rn - 1)) & 1 = 1)
        SELECT graph_id, state AS dominant, rn AS best_site FROM l WHERE o = 1""",
    "coupling_scan": f"""WITH {_ANY}, j AS (SELECT unnest(range(-40, 41)) AS j10),
        y AS (SELECT st.graph_id, st.k, coalesce(ow.n, 0) AS n, coalesce(w, 0) AS w, max(coalesce(w, 0)) OVER (PARTITION BY st.graph_id, coalesce(ow.n, 0)) AS m FROM st LEFT JOIN ow ON st.graph_id = ow.graph_id AND st.state = ow.state WHERE st.k >= 2),
        g AS (SELECT graph_id, n, max(m) + log10(sum(pow(10, w - m))) AS z FROM y GROUP BY ALL), o AS (SELECT graph_id, n, j10, z + j10 / 10.0 * n * (n - 1) / 2 AS z FROM g CROSS JOIN j),
        d AS (SELECT *, z - lag(z) OVER (PARTITION BY graph_id, j10 ORDER BY n) AS v FROM o),
        t AS (SELECT graph_id, row_number() OVER (PARTITION BY graph_id ORDER BY b DESC) AS n, b - 0.3 * (row_number() OVER (PARTITION BY graph_id ORDER BY b DESC) - 1) AS target FROM s),
        l AS (SELECT d.graph_id, j10, round(sum(pow(v - target, 2)) + 0.25 * j10 * j10 / 100.0, 6) AS loss FROM d JOIN t ON d.graph_id = t.graph_id AND d.n = t.n GROUP BY d.graph_id, j10),
        r AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY loss, abs(j10), j10) AS rk FROM l) SELECT graph_id, j10, loss FROM r WHERE rk = 1""",
    "projection_with_fixed": f"""WITH n AS (SELECT l_orderkey AS g, rn, l_extendedprice::DOUBLE AS v, l_returnflag = 'R' AS fixed FROM {NUMBERED}), l AS (SELECT *, fixed OR coalesce(lag(fixed) OVER (PARTITION BY g ORDER BY rn), false) AS new FROM n),
        b AS (SELECT *, sum(new::INT) OVER (PARTITION BY g ORDER BY rn) AS blk, last_value(CASE WHEN fixed THEN v END IGNORE NULLS) OVER (PARTITION BY g ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi, first_value(CASE WHEN fixed THEN v END IGNORE NULLS) OVER (PARTITION BY g ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lo FROM l),
        c AS (SELECT *, sum(v) OVER (PARTITION BY g, blk ORDER BY rn) AS c FROM b), m AS (SELECT a.g, a.blk, a.rn AS i, z.rn AS j, (z.c - a.c + a.v) / (z.rn - a.rn + 1) AS mean FROM c a JOIN c z ON a.g = z.g AND a.blk = z.blk AND a.rn <= z.rn),
        x AS (SELECT c.g, c.rn, m.i, max(mean) AS top FROM c JOIN m ON c.g = m.g AND c.blk = m.blk AND m.i <= c.rn AND m.j >= c.rn GROUP BY ALL), f AS (SELECT g, rn, min(top) AS fit FROM x GROUP BY ALL)
        SELECT f.g AS l_orderkey, f.rn, fixed, round(CASE WHEN fixed THEN v ELSE greatest(coalesce(lo, '-infinity'::DOUBLE), least(coalesce(hi, 'infinity'::DOUBLE), fit)) END, 6) AS fitted FROM f JOIN b ON f.g = b.g AND f.rn = b.rn""",
}
