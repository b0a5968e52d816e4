"""Row-policy queries: each function of the scalar module over whole tables, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.functions import scalars as s
from calibrant.operators import evidence as ev
from calibrant.operators import metrics as m
from calibrant.operators import review as rv
from calibrant.plans.common import NUMBERED, numbered, r6, read


def _lines(spark, d):
    return numbered(read(spark, d, "lineitem")).select(
        "l_orderkey", F.col("rn").cast("long").alias("rn"), F.col("l_quantity").cast("double").alias("q"), F.col("l_discount").cast("double").alias("disc"), F.col("l_tax").cast("double").alias("tax"),
        F.col("l_extendedprice").cast("double").alias("price"), "l_returnflag", "l_linestatus", "l_suppkey",
    )


def side_calls(spark, d):
    """B15, B16, B18, B19."""
    p = s.protonated_fraction(F.col("q") / 5, F.lit(5.0))
    call = s.state_call(F.round(p, 9))
    t = _lines(spark, d)
    return t.select("l_orderkey", "rn", r6(p).alias("p"), r6(s.interval_confidence(p - F.col("disc"), p + F.col("disc"))).alias("sure"), call.alias("call"), s.agreement(F.col("price") / 10000, F.lit(5.0), call).alias("agreement"))


def site_confidence(spark, d):
    """B17."""
    support = F.when(F.col("l_returnflag") == "A", "high_x").when(F.col("l_returnflag") == "R", "medium").otherwise("none")
    known = F.when(F.col("l_linestatus") == "O", "regularized_prior_dependent_pairs").otherwise("identified")
    c = s.site_confidence(F.col("q") / 50, F.lit(1.0) - F.col("disc"), 0.5 + F.col("tax") * 5, support, F.col("disc"), F.col("l_suppkey") % 9 != 0, known)
    return _lines(spark, d).select("l_orderkey", "rn", r6(c).alias("confidence"), s.confidence_tier(F.round(c, 9)).alias("tier"))


def couplings(spark, d):
    """B20, D46."""
    return _lines(spark, d).select("l_orderkey", "rn", r6(s.screened_coupling("q")).alias("coupling"), F.round(s.normal_cdf((F.col("q") - 25) / 10), 5).alias("cdf"))


def fallbacks(spark, d):
    """B23, B24, B25, B26."""
    f = s.uncertainty_fallback("l_returnflag", "disc", F.when(F.col("l_suppkey") % 2 == 0, "rule"), 0.05)
    i = s.interval_combine("q", "disc", "tax")
    t = _lines(spark, d)
    return t.select("l_orderkey", "rn", F.coalesce(f["call"], F.lit("")).alias("call"), f["source"].alias("source"), s.threshold_margin_call(F.col("q") / 50, F.lit(7), 0.5, 0.2).cast("long").alias("override"), s.missing_fields(a=F.when(F.col("disc") > 0, F.col("disc")), b=F.when(F.col("tax") > 0, F.col("tax"))).alias("missing"), r6(i["low"]).alias("low"), r6(i["high"]).alias("high"))


def classifications(spark, d):
    """B9, B30-B36."""
    t = _lines(spark, d)
    w = s.window_check("q", F.when(F.col("l_returnflag") != "N", 5.0), F.when(F.col("l_returnflag") == "A", 40.0))
    ty = s.type_consistency(F.col("l_linestatus") == "O", F.when(F.col("l_returnflag") == "A", "acid").when(F.col("l_returnflag") == "R", "base"), F.col("q") / 3 - 1)
    se = s.source_evidence(F.col("l_suppkey") % 4 == 0, F.col("l_suppkey") % 3 == 0, F.col("l_suppkey") % 2 == 0)
    sc = s.shrunk_correction(F.col("q") / 10, F.lit(0.8), F.col("disc") * 10, F.col("tax") * 10)
    return t.select(
        "l_orderkey", "rn", w["reason"].alias("window"), r6(s.selection_score("disc", "q", "site_then_state")).alias("score"), ty["flag"].alias("flag"), ty["flipped"].alias("flipped"),
        s.assignability((F.col("l_suppkey") % 3).cast("int"), (F.col("l_suppkey") % 2).cast("int")).alias("assignable"), r6(sc["shift"]).alias("shift"), r6(sc["confidence"]).alias("confidence"),
        r6(s.presence("disc", F.when(F.col("l_linestatus") == "O", "acid_form").otherwise("base_form"), F.col("l_returnflag") != "N")).alias("presence"), se["level"].alias("level"), s.failure_type(F.col("disc") > 0.08, F.col("tax") > 0.06).alias("failure"),
    )


def identifiers(spark, d):
    """H: hashes, key prefixes and normalised ids."""
    c = read(spark, d, "customer")
    return c.select("c_custkey", s.hash_id("mol_", F.col("c_custkey").cast("string"), F.col("c_mktsegment")).alias("id"), s.seed_of("c_custkey").alias("seed"), s.integral_id(F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))).alias("whole"), F.substring_index(F.concat_ws("-", "c_custkey", "c_nationkey", F.lit("N")), "-", 2).alias("prefix"))


def multi_key_counts(spark, d):
    """Counts over several keys, nulls kept, with the place within the first key."""
    t = ev.count_fraction(read(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_linenumber")
    return t.select("l_returnflag", "l_linestatus", "l_linenumber", "n", r6("share").alias("share"), F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.col("n").desc(), "l_linestatus", "l_linenumber")).cast("long").alias("place"))


def coverage_summary(spark, d):
    """Conditional counts and distinct counts over documents and their labels, per source."""
    j = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id", "left")
    return j.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("quality").isNotNull()).alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"),
        F.count_distinct(F.when(F.col("quality") == 1, F.col("lang"))).alias("good_langs"), r6(F.coalesce(F.avg("quality"), F.lit(0.0))).alias("good_rate"),
    )


def group_size_filter(spark, d):
    """Orders of customers with ten orders or more, numbered from 0."""
    o = read(spark, d, "orders").select("o_custkey", "o_orderkey")
    w = Window.partitionBy("o_custkey")
    t = o.withColumn("n", F.count(F.lit(1)).over(w)).where("n >= 10")
    return t.select("o_custkey", "o_orderkey", (F.row_number().over(w.orderBy("o_orderkey")) - 1).cast("long").alias("index"))


def failure_table(spark, d):
    """two scopes of orders with errors and customer context; the strict failures come first."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), (F.col("o_totalprice").cast("double") / 10000).alias("y"), F.lit(15.0).alias("p"), "o_orderstatus")
    t = rv.failure_table({"open": o.where("o_orderstatus = 'O'"), "closed": o.where("o_orderstatus = 'F'")}, read(spark, d, "customer").select("c_custkey", "c_mktsegment"), ["c_custkey"])
    t = rv.example_selector(t, F.col("signed_error") > 5, [F.col("abs_error").desc(), F.col("o_orderkey")], 50)
    return t.select("scope", "o_orderkey", r6("signed_error").alias("signed_error"), "c_mktsegment")


def entity_top1(spark, d):
    """Accuracy of the best line per order and its mean discount."""
    t = _lines(spark, d).groupBy("l_orderkey").agg(F.max_by(F.struct("l_returnflag", "disc"), F.struct("price", -F.col("rn"))).alias("b"))
    return t.agg(F.count(F.lit(1)).alias("orders"), r6(F.avg((F.col("b.l_returnflag") == "R").cast("double"))).alias("hit"), r6(F.avg("b.disc")).alias("disc"))


def replicate_noise(spark, d):
    """How far lines lie from the last returned one before them."""
    t = ev.carry_forward(_lines(spark, d), ["l_orderkey"], ["rn"], F.col("l_returnflag") == "R", F.col("price"), "main").where("main is not null and l_returnflag <> 'R'")
    return m.distribution_summary(t.withColumn("e", F.round(F.abs(F.col("price") - F.col("main")), 6)), "e", "l_linestatus").select("l_linestatus", "n", *[F.round(c, 4).alias(c) for c in ("median", "p90", "p95", "p99", "max")])


def representative(spark, d):
    """Per customer the order with most lines, then price, then the smaller key."""
    n = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = read(spark, d, "orders").join(n, "o_orderkey")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("n", "o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey"))


QUERIES = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_L = f"x AS (SELECT l_orderkey, rn, l_quantity::DOUBLE AS q, l_discount::DOUBLE AS disc, l_tax::DOUBLE AS tax, l_extendedprice::DOUBLE AS price, l_returnflag, l_linestatus, l_suppkey FROM {NUMBERED})"
_IC = "CASE WHEN {a} >= 0.5 THEN 2 * ({a} - 0.5) WHEN {b} <= 0.5 THEN 2 * (0.5 - {b}) ELSE 0 END"

SQL = {
    "side_calls": f"WITH {_L}, p AS (SELECT *, 1 / (1 + pow(10, 5.0 - q / 5)) AS p FROM x), c AS (SELECT *, CASE WHEN round(p, 9) >= 0.5 THEN 'acid_form' ELSE 'base_form' END AS call, price / 10000 AS o FROM p) SELECT l_orderkey, rn, round(p, 6) + 0.0 AS p, round({_IC.format(a='(p - disc)', b='(p + disc)')}, 6) + 0.0 AS sure, call, CASE WHEN abs(o - 5) <= 1e-9 THEN 'boundary' WHEN (o > 5) = (call = 'acid_form') THEN 'agrees' ELSE 'disagrees' END AS agreement FROM c",
    "site_confidence": f"WITH {_L}, c AS (SELECT l_orderkey, rn, greatest(0, least(1, 2 * (0.5 + tax * 5) - 1)) * abs(2 * q / 50 - 1) * (1 - disc) * CASE l_returnflag WHEN 'A' THEN 1.0 WHEN 'R' THEN 0.8 ELSE 0.3 END * CASE WHEN l_suppkey % 9 <> 0 THEN exp(-disc) ELSE 0 END * CASE WHEN l_linestatus = 'O' THEN 0.65 ELSE 1 END AS c FROM x) SELECT l_orderkey, rn, round(c, 6) + 0.0 AS confidence, CASE WHEN round(c, 9) >= 0.7 THEN 'high' WHEN round(c, 9) >= 0.4 THEN 'medium' WHEN round(c, 9) >= 0.1 THEN 'low' ELSE 'very_low' END AS tier FROM c",
    "couplings": f"""WITH {_L}, z AS (SELECT *, (q - 25) / 10 AS z, 1 / (1 + 0.3275911 * abs((q - 25) / 10) / sqrt(2.0)) AS t FROM x), h AS (SELECT *, (1 - ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2)) / 2 AS h FROM z)
        SELECT l_orderkey, rn, round(least(4.0, 332.06 * exp(-greatest(q, 1.5) / 7.0) / (20.0 * greatest(q, 1.5)) / 1.364), 6) + 0.0 AS coupling, round(CASE WHEN z >= 0 THEN 0.5 + h ELSE 0.5 - h END, 5) AS cdf FROM h""",
    "fallbacks": f"WITH {_L} SELECT l_orderkey, rn, coalesce(CASE WHEN disc >= 0.05 THEN l_returnflag WHEN l_suppkey % 2 = 0 THEN 'rule' END, '') AS call, CASE WHEN disc >= 0.05 THEN 'model' WHEN l_suppkey % 2 = 0 THEN 'rule' ELSE 'none' END AS source, CASE WHEN abs(q / 50 - 0.5) >= 0.2 THEN (q / 50 >= 0.5)::BIGINT ELSE 7 END AS override, concat_ws(';', CASE WHEN disc = 0 THEN 'a' END, CASE WHEN tax = 0 THEN 'b' END) AS missing, round(q - sqrt(disc * disc + tax * tax), 6) + 0.0 AS low, round(q + sqrt(disc * disc + tax * tax), 6) + 0.0 AS high FROM x",
    "classifications": f"""WITH {_L}, t AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 'acid' WHEN 'R' THEN 'base' END AS r, l_linestatus = 'O' AS a, q / 3 - 1 AS v FROM x), f AS (SELECT *, CASE WHEN r = 'acid' AND v > 13 THEN 'hard_extreme' WHEN r = 'base' AND v < 1 THEN 'hard_extreme' WHEN a AND r = 'base' THEN 'type_conflict' WHEN NOT a AND r = 'acid' THEN 'type_conflict' WHEN r = 'acid' AND v > 11 THEN 'soft_extreme' WHEN r = 'base' AND v < 3 THEN 'soft_extreme' WHEN r IS NULL AND (v < 0 OR v > 12) THEN 'soft_extreme' ELSE 'consistent' END AS flag FROM t)
        SELECT l_orderkey, rn, CASE WHEN l_returnflag = 'N' THEN 'no_window' WHEN q < 5 THEN 'below_window' WHEN l_returnflag = 'A' AND q > 40 THEN 'above_window' ELSE 'in_window' END AS "window", round(round(disc, 3) + 1e-6 * q, 6) + 0.0 AS score, flag, flag = 'type_conflict' AS flipped,
        CASE WHEN l_suppkey % 3 + l_suppkey % 2 = 0 THEN 'none' WHEN l_suppkey % 3 = 1 AND l_suppkey % 2 = 0 THEN 'clean_single' WHEN l_suppkey % 3 = 1 THEN 'single_plus_unresolved' ELSE 'multiple' END AS assignable,
        round(greatest(-4, least(4, q / 10)) * 0.8 * disc * 10, 6) + 0.0 AS shift, round(least(0.9, 0.8 * disc * 10 * exp(-tax * 10 / 3)), 6) + 0.0 AS confidence, round(CASE WHEN l_returnflag = 'N' THEN 0.5 WHEN l_linestatus = 'O' THEN disc ELSE 1 - disc END, 6) + 0.0 AS presence,
        CASE WHEN l_suppkey % 4 = 0 THEN 'high' WHEN l_suppkey % 3 = 0 THEN 'medium' WHEN l_suppkey % 2 = 0 THEN 'low' ELSE 'none' END AS level, CASE WHEN disc > 0.08 AND tax > 0.06 THEN 'site+pair_form' WHEN disc > 0.08 THEN 'site' WHEN tax > 0.06 THEN 'pair_form' ELSE 'ok' END AS failure FROM f""",
    "identifiers": "SELECT c_custkey, 'mol_' || substr(sha256(c_custkey || '|' || c_mktsegment), 1, 16) AS id, ('0x' || substr(sha256(c_custkey::VARCHAR), 1, 8))::BIGINT AS seed, c_custkey::VARCHAR AS whole, c_custkey || '-' || c_nationkey AS prefix FROM customer",
    "multi_key_counts": "WITH n AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL) SELECT *, round(n / (SELECT sum(n) FROM n), 6) + 0.0 AS share, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linestatus, l_linenumber) AS place FROM n",
    "coverage_summary": "SELECT source, count(*) AS rows, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(DISTINCT CASE WHEN quality = 1 THEN lang END) AS good_langs, round(coalesce(avg(quality), 0), 6) + 0.0 AS good_rate FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source",
    "group_size_filter": "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS index FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 10",
    "failure_table": "SELECT CASE o_orderstatus WHEN 'O' THEN 'open' ELSE 'closed' END AS scope, o_orderkey, round(15.0 - o_totalprice::DOUBLE / 10000, 6) + 0.0 AS signed_error, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus IN ('O', 'F') ORDER BY (15.0 - o_totalprice::DOUBLE / 10000 > 5) DESC, abs(15.0 - o_totalprice::DOUBLE / 10000) DESC, o_orderkey LIMIT 50",
    "entity_top1": f"WITH {_L}, b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY price DESC, rn) = 1) SELECT count(*) AS orders, round(avg((l_returnflag = 'R')::INT), 6) + 0.0 AS hit, round(avg(disc), 6) + 0.0 AS disc FROM b",
    "replicate_noise": f"WITH {_L}, c AS (SELECT *, last_value(CASE WHEN l_returnflag = 'R' THEN price END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY rn ROWS UNBOUNDED PRECEDING) AS main FROM x), e AS (SELECT l_linestatus, round(abs(price - main), 6) AS e FROM c WHERE main IS NOT NULL AND l_returnflag <> 'R') SELECT l_linestatus, count(*) AS n, round(median(e), 4) AS median, round(quantile_cont(e, 0.9), 4) AS p90, round(quantile_cont(e, 0.95), 4) AS p95, round(quantile_cont(e, 0.99), 4) AS p99, round(max(e), 4) AS max FROM e GROUP BY 1",
    "representative": "WITH n AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_custkey, o_orderkey FROM orders JOIN n ON o_orderkey = l_orderkey QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_totalprice DESC, o_orderkey) = 1",
}
