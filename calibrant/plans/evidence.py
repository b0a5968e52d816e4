"""Evidence queries: a part is an entity, its lines are observations; documents have sources and lineages."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibrant.functions import scalars as s
from calibrant.operators import evidence as ev
from calibrant.plans.common import LINE_ORDER, NUMBERED, numbered, r6, read


def _obs(spark, d):
    lines = numbered(read(spark, d, "lineitem"))
    rel = F.when(F.col("l_returnflag") == "A", "<").when(F.col("l_returnflag") == "R", ">").otherwise("=")
    b = s.censored_bounds(rel, 100 * F.col("l_discount").cast("double"))
    obs = lines.select(F.col("l_partkey").alias("part"), F.concat_ws("-", "l_orderkey", "rn").alias("id"), F.col("l_quantity").cast("double").alias("quality"), b.alias("b"))
    return obs.select("part", "id", "quality", "b.*")


def censored_summary(spark, d):
    t = ev.censored_summary(_obs(spark, d), "part")
    return t.select("part", *[r6(c).alias(c) for c in ("value", "low", "high", "iqr", "mad", "sd", "max_gap")], "method", "n", "n_exact", "n_censored", "conflict", "note", "dominant_relation", F.md5("ids").alias("ids_md5"))


def quarantine_ledger(spark, d):
    lines = numbered(read(spark, d, "lineitem"))
    t = ev.route_quarantine(
        lines, (F.col("l_discount").isNull(), "missing_value", ""), (F.col("l_quantity") > 45, "outside_range", F.col("l_quantity").cast("int")),
        (F.col("l_discount") == 0, "no_discount", "0"), (F.col("l_shipdate") > F.lit("1998-06-01"), "too_late", F.date_format("l_shipdate", "yyyy-MM-dd")),
    )
    return t.select("l_orderkey", F.col("rn").cast("long").alias("rn"), F.coalesce("reason", F.lit("accepted")).alias("reason"), F.coalesce("detail", F.lit("")).alias("detail"))


def funnel(spark, d):
    return ev.funnel(read(spark, d, "lineitem"), small=F.col("l_quantity") <= 45, discounted=F.col("l_discount") > 0, early=F.col("l_shipdate") <= F.lit("1998-06-01"))


def quality_scores(spark, d):
    """B1-B7 over customers: numbers from text, relation, bounds, quality and the first failing rule."""
    c = read(spark, d, "customer")
    v = s.safe_number(F.col("c_acctbal").cast("string"))
    q = s.quality_score(F.col("c_custkey") % 3, F.when(F.col("c_nationkey") % 4 == 0, "x"), F.col("c_nationkey") % 2, F.col("c_nationkey"))
    reason = s.first_failing((v.isNull(), "missing"), ((v < 0), "negative"), ((v > 9000), "high"))
    return c.select("c_custkey", F.round(q, 6).alias("quality"), s.truthy(F.col("c_nationkey").cast("string")).alias("flag"), F.coalesce(reason, F.lit("")).alias("reason"), r6(s.protonated_fraction(v / 1000, F.lit(4.0))).alias("fraction"))


def replicate_target(spark, d):
    lines = read(spark, d, "lineitem").select("l_partkey", F.round(F.col("l_extendedprice").cast("double") * 100).alias("x"), F.when(F.col("l_returnflag") == "N", "gold").otherwise("silver").alias("tier"), F.when(F.col("l_linestatus") == "O", "medium").otherwise("high").alias("conf"))
    t = ev.replicate_target(lines, "l_partkey", "x", "tier", "conf")
    w = s.measurement_weight("n", F.col("sigma") / 1000000, "medium_fraction", "tier")
    return t.select("l_partkey", "n", "tier", *[F.round(c, 3).alias(c) for c in ("target", "mad", "mean", "range")], F.round("sigma", 5).alias("sigma"), F.round("sd", 1).alias("sd"), r6("medium_fraction").alias("medium_fraction"), r6(w).alias("weight"))


def group_summary(spark, d):
    o = read(spark, d, "orders").withColumn("x", F.col("o_totalprice").cast("double"))
    t = ev.group_summary(o, "o_orderpriority", "x")
    return t.select("o_orderpriority", "n", *[F.round(c, 4).alias(c) for c in ("mean", "median", "sd", "min", "max", "q1", "q3", "iqr")])


def weighted_median(spark, d):
    lines = read(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("w"))
    return ev.weighted_median(lines, ["l_suppkey"], "x", "w")


def weighted_quantile(spark, d):
    lines = read(spark, d, "lineitem").select("l_suppkey", F.col("l_extendedprice").cast("double").alias("x"), F.col("l_quantity").cast("double").alias("w"))
    return ev.weighted_quantile(lines, ["l_suppkey"], "x", "w", 0.9)


def mode_tiebreak(spark, d):
    return ev.mode_tiebreak(read(spark, d, "lineitem"), ["l_partkey"], "l_linestatus")


def count_fraction(spark, d):
    t = ev.count_fraction(read(spark, d, "documents"), "lang", "source")
    return t.select("lang", "source", "n", r6("share").alias("share"))


def _tokens():
    return F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def exploded_counts(spark, d):
    t = ev.exploded_counts(read(spark, d, "documents"), _tokens())
    return t.select("item", "n", F.round("share", 9).alias("share"))


def combination_counts(spark, d):
    o = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_returnflag").alias("flags"))
    return ev.combination_counts(o, F.col("flags")).select("combination", "n", r6("share").alias("share"))


def exclusive_items(spark, d):
    tokens = read(spark, d, "documents").select("source", F.explode(F.array_distinct(_tokens())).alias("item")).where("source is not null")
    return ev.exclusive_items(tokens, "item", "source")


def source_contribution(spark, d):
    docs = read(spark, d, "documents").withColumn("len", F.char_length(F.coalesce("text", F.lit(""))).cast("double"))
    t = ev.source_contribution(docs, "source", "lang", "len", long=F.col("len") > 2000, english=F.col("lang") == "en")
    return t.select("source", "rows", "keys", *[r6(c).alias(c) for c in ("mean", "median", "long_rate", "english_rate")], "long", "english")


def weighted_family_prior(spark, d):
    labels = read(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("p_retailprice").cast("double")).alias("mean"), F.median(F.col("p_retailprice").cast("double")).alias("median"))
    t = ev.weighted_family_prior(labels, "p_brand")
    return t.select("p_brand", r6("mean").alias("mean"), r6("median").alias("median"), "count")


def lineage_duplicates(spark, d):
    docs = read(spark, d, "documents")
    t = ev.lineage_duplicates(docs, [F.sha2(F.coalesce("text", F.lit("")), 256), F.col("lang")], "doc_id", "source")
    return t.select(F.md5("lineage").alias("lineage"), "n", F.md5(F.regexp_replace("ids", " ", "")).alias("ids"), "sources")


def independent_measurements(spark, d):
    lines = numbered(read(spark, d, "lineitem")).select("l_partkey", "l_orderkey", "rn", F.when(F.col("l_returnflag") == "N", F.col("l_suppkey").cast("string")).alias("doc"), F.lit("a").alias("assay"), F.col("l_quantity").cast("double").alias("x"), F.when(F.col("l_linestatus") == "O", "gold").otherwise("silver").alias("tier"))
    return ev.independent_measurements(lines, "doc", "assay", "x", "tier", ["l_orderkey", "rn"], "l_partkey").select("l_partkey", "l_orderkey", F.col("rn").cast("long").alias("rn"), "x", "tier")


def conflict_check(spark, d):
    return ev.conflict_check(read(spark, d, "lineitem"), ["l_orderkey", "l_partkey"], "l_suppkey")


def shared_weight(spark, d):
    return ev.shared_weight(read(spark, d, "documents").select("doc_id", "source"), "source").select("doc_id", F.round("weight", 9).alias("weight"))


def weight_cap(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", F.char_length(F.coalesce("text", F.lit(""))).cast("double").alias("w"))
    return ev.weight_cap(docs, "lang", "w", "en", 0.1).select("doc_id", "lang", r6("scale").alias("scale"), r6("capped_weight").alias("capped_weight"))


def latest_wins(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return ev.latest_wins(e, ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id", "is_current")


def carry_forward_parent(spark, d):
    e = read(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return ev.carry_forward(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_id"), "parent").select("user_id", "event_id", "parent")


def priority_dedupe(spark, d):
    lines = numbered(read(spark, d, "lineitem"))
    score = 4 * (F.col("l_returnflag") == "R").cast("int") + 2 * (F.col("l_linestatus") == "O").cast("int") + (F.col("l_discount") > 0).cast("int")
    t = ev.priority_dedupe(lines, ["l_orderkey"], score, "l_partkey", ["rn"])
    return t.select("l_orderkey", F.col("rn").cast("long").alias("rn"), "l_partkey", "disagree")


def distinct_on(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = ev.distinct_on(docs.select("doc_id", F.sha2("text", 256).alias("h")), ["h"], ["doc_id"], "doc_id")
    return t.select("doc_id", "h", "n_copies", F.array_join("records", "|").alias("records"))


def _overrides(spark, d):
    """Events as a decision log about customers: the user is the customer, the type the decision."""
    return read(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")).alias("c_mktsegment"), "ts", "event_id")


def apply_overrides(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return ev.apply_overrides(c, _overrides(spark, d), ["c_custkey"], "c_mktsegment", ["ts", "event_id"])


def audit_overrides(spark, d):
    t = ev.audit_overrides(_overrides(spark, d), read(spark, d, "customer").where("c_acctbal > 0"), ["c_custkey"], "c_mktsegment", ["ts", "event_id"])
    return t.select("event_id", F.coalesce("reason", F.lit("usable")).alias("reason"))


def wildcard_rules(spark, d):
    n = read(spark, d, "nation")
    rules = n.select(F.col("n_nationkey").alias("rule_id"), F.when(F.col("n_regionkey") < 2, "nation").otherwise("customer").alias("scope"), F.col("n_nationkey").cast("string").alias("key"), F.when(F.col("n_regionkey") == 1, F.lit(100.0)).cast("double").alias("value"), F.col("n_name").alias("reason"))
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", F.round("c_acctbal", 0).cast("double").alias("x"))
    return ev.wildcard_rules(c, rules, "c_custkey", {"nation": "c_nationkey", "customer": "c_custkey"}, "x")


def overlay(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", (F.col("c_acctbal") < 0).alias("enabled"))
    last = ev.latest_wins(read(spark, d, "events"), ["user_id"], "ts", "event_id").where("is_current").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("c_mktsegment"))
    return ev.overlay(c, last, "c_custkey", ["c_mktsegment"], "enabled").select("c_custkey", "c_mktsegment", "source")


def slot_unpivot(spark, d):
    c = read(spark, d, "customer")
    t = ev.slot_unpivot(c, "c_custkey", [("c_acctbal", "c_mktsegment"), ("c_nationkey", "c_mktsegment")], -500, 9000, ["BUILDING", "MACHINERY"])
    return t.select("c_custkey", F.col("slot").cast("long").alias("slot"), r6("value").alias("value"), F.coalesce("reason", F.lit("accepted")).alias("reason"))


def candidate_explode(spark, d):
    o = numbered(read(spark, d, "lineitem")).groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "l_returnflag"))), lambda x: x["l_returnflag"]).alias("listed"), F.max("l_returnflag").alias("chosen"))
    return ev.candidate_explode(o, "l_orderkey", F.col("listed"), "chosen").select("l_orderkey", "candidate_id", F.col("is_true").cast("long").alias("is_true"))


QUERIES = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_O = f"""o AS (SELECT l_partkey AS part, l_orderkey || '-' || rn AS id, l_quantity::DOUBLE AS w, 100 * l_discount::DOUBLE AS v, CASE l_returnflag WHEN 'A' THEN '<' WHEN 'R' THEN '>' ELSE '=' END AS rel FROM {NUMBERED})"""
_PCT = "quantile_cont({x}, {q})"

SQL = {
    "censored_summary": f"""WITH {_O}, x AS (SELECT part, v, sum(w) AS w FROM o WHERE rel = '=' GROUP BY ALL),
        c AS (SELECT part, v, sum(w) OVER (PARTITION BY part ORDER BY v) AS c, sum(w) OVER (PARTITION BY part) AS t FROM x),
        m AS (SELECT part, min(v) AS wm FROM c WHERE c >= t / 2 GROUP BY 1),
        g AS (SELECT part, median(v) AS med, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, quantile_cont(v, 0.25) FILTER (rel = '=') AS q1, quantile_cont(v, 0.75) FILTER (rel = '=') AS q3,
          stddev_pop(v) AS sd, max(v) - min(v) AS max_gap, count(*) AS n, count(*) FILTER (rel = '=') AS n_exact, count(*) FILTER (rel <> '=') AS n_censored,
          max(v) FILTER (rel = '>') AS lo, min(v) FILTER (rel = '<') AS hi, md5(string_agg(DISTINCT id, '|' ORDER BY id)) AS ids_md5 FROM o GROUP BY part),
        d AS (SELECT o.part, median(abs(v - med)) AS mad FROM o JOIN g ON o.part = g.part GROUP BY 1),
        r AS (SELECT part, rel, row_number() OVER (PARTITION BY part ORDER BY count(*) DESC, rel) AS k FROM o GROUP BY part, rel),
        j AS (SELECT g.*, wm, mad, rel AS dominant_relation, CASE WHEN n_exact > 0 THEN wm WHEN lo <= hi THEN (lo + hi) / 2 END AS value,
          CASE WHEN n_exact = 0 AND (lo IS NOT NULL OR hi IS NOT NULL) AND NOT coalesce(lo <= hi, false) THEN 'inconsistent_censored_bounds' WHEN n_exact > 0 AND (coalesce(wm < lo, false) OR coalesce(wm > hi, false)) THEN 'exact_vs_censored_disagreement' WHEN max_gap > 6 THEN 'wide_value_spread' ELSE '' END AS note
          FROM g LEFT JOIN m ON g.part = m.part JOIN d ON g.part = d.part JOIN r ON g.part = r.part AND k = 1)
        SELECT part, round(value, 6) + 0.0 AS value, round(CASE WHEN n_exact > 0 THEN q1 ELSE lo END, 6) + 0.0 AS low, round(CASE WHEN n_exact > 0 THEN q3 ELSE hi END, 6) + 0.0 AS high, round(iqr, 6) + 0.0 AS iqr, round(mad, 6) + 0.0 AS mad, round(sd, 6) + 0.0 AS sd, round(max_gap, 6) + 0.0 AS max_gap,
          CASE WHEN n_exact > 0 THEN 'exact_weighted_median' WHEN lo <= hi THEN 'censored_interval' ELSE 'censored_conflict' END AS method, n, n_exact, n_censored, note <> '' AS conflict, note, dominant_relation, ids_md5 FROM j""",
    "quarantine_ledger": f"SELECT l_orderkey, rn, CASE WHEN l_discount IS NULL THEN 'missing_value' WHEN l_quantity > 45 THEN 'outside_range' WHEN l_discount = 0 THEN 'no_discount' WHEN l_shipdate > '1998-06-01' THEN 'too_late' ELSE 'accepted' END AS reason, CASE WHEN l_discount IS NULL THEN '' WHEN l_quantity > 45 THEN (l_quantity::INT)::VARCHAR WHEN l_discount = 0 THEN '0' WHEN l_shipdate > '1998-06-01' THEN strftime(l_shipdate, '%Y-%m-%d') ELSE '' END AS detail FROM {NUMBERED}",
    "funnel": "SELECT count(*) AS rows, count(*) FILTER (l_quantity <= 45) AS small, count(*) FILTER (l_quantity <= 45 AND l_discount > 0) AS discounted, count(*) FILTER (l_quantity <= 45 AND l_discount > 0 AND l_shipdate <= '1998-06-01') AS early FROM lineitem",
    "quality_scores": """SELECT c_custkey, round(greatest(0, least(1, 1 - CASE WHEN c_custkey % 3 > 0 THEN 0.25 ELSE 0 END - CASE WHEN c_nationkey % 4 = 0 THEN 0.35 ELSE 0 END - CASE WHEN c_nationkey % 2 <= 0 THEN 0.2 ELSE 0 END + c_nationkey::DOUBLE / 50)), 6) AS quality,
        c_nationkey = 1 AS flag, CASE WHEN c_acctbal IS NULL THEN 'missing' WHEN c_acctbal < 0 THEN 'negative' WHEN c_acctbal > 9000 THEN 'high' ELSE '' END AS reason, round(1 / (1 + pow(10, 4.0 - c_acctbal::DOUBLE / 1000)), 6) + 0.0 AS fraction FROM customer""",
    "replicate_target": """WITH x AS (SELECT l_partkey, round(l_extendedprice::DOUBLE * 100) AS x, l_returnflag = 'N' AS gold, (l_linestatus = 'O')::INT::DOUBLE AS medium FROM lineitem), g AS (SELECT l_partkey, median(x) AS target, avg(x) AS mean, stddev_pop(x) AS sd, max(x) - min(x) AS range, count(*) AS n, bool_and(gold) AS gold, avg(medium) AS mf FROM x GROUP BY 1),
        m AS (SELECT x.l_partkey, median(abs(x - target)) AS mad FROM x JOIN g ON x.l_partkey = g.l_partkey GROUP BY 1)
        SELECT g.l_partkey, n, CASE WHEN gold THEN 'gold' ELSE 'silver' END AS tier, round(target, 3) AS target, round(mad, 3) AS mad, round(1.4826 * mad, 5) AS sigma, round(mean, 3) AS mean, round(sd, 1) AS sd, round(range, 3) AS range, round(mf, 6) + 0.0 AS medium_fraction,
        round(greatest(0.1, least(1.5, least(1.5, 1 + 0.2 * log2(n)) / (1 + pow(1.4826 * mad / 1000000, 2)) * (1 - 0.25 * mf) * CASE WHEN gold THEN 1.0 ELSE 0.7 END)), 6) + 0.0 AS weight FROM g JOIN m ON g.l_partkey = m.l_partkey""",
    "group_summary": "SELECT o_orderpriority, count(*) AS n, round(avg(x), 4) AS mean, round(median(x), 4) AS median, round(stddev_samp(x), 4) AS sd, round(min(x), 4) AS min, round(max(x), 4) AS max, round(quantile_cont(x, 0.25), 4) AS q1, round(quantile_cont(x, 0.75), 4) AS q3, round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 4) AS iqr FROM (SELECT o_orderpriority, o_totalprice::DOUBLE AS x FROM orders) GROUP BY 1",
    "weighted_median": "WITH x AS (SELECT l_suppkey, l_extendedprice::DOUBLE AS x, sum(l_quantity::DOUBLE) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY l_suppkey ORDER BY x) AS c, sum(w) OVER (PARTITION BY l_suppkey) AS t FROM x) SELECT l_suppkey, min(x) AS weighted_median FROM c WHERE c >= t / 2 GROUP BY 1",
    "weighted_quantile": "WITH x AS (SELECT l_suppkey, l_extendedprice::DOUBLE AS x, sum(l_quantity::DOUBLE) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, round(sum(w) OVER (PARTITION BY l_suppkey ORDER BY x) / sum(w) OVER (PARTITION BY l_suppkey), 12) AS s FROM x) SELECT l_suppkey, min(x) AS quantile FROM c WHERE s >= 0.9 GROUP BY 1",
    "mode_tiebreak": "WITH n AS (SELECT l_partkey, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_linestatus) AS k FROM n) SELECT l_partkey, l_linestatus AS mode FROM r WHERE k = 1",
    "count_fraction": "SELECT lang, source, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents), 6) + 0.0 AS share FROM documents GROUP BY ALL",
    "exploded_counts": r"WITH t AS (SELECT unnest(list_distinct(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS item FROM documents), n AS (SELECT item, count(*) AS n FROM t GROUP BY 1) SELECT item, n, round(n / (SELECT sum(n) FROM n), 9) AS share FROM n",
    "combination_counts": "WITH c AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS combination FROM lineitem GROUP BY 1) SELECT combination, count(*) AS n, round(count(*) / (SELECT count(*) FROM c), 6) + 0.0 AS share FROM c GROUP BY 1",
    "exclusive_items": r"WITH t AS (SELECT DISTINCT source, unnest(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS item FROM documents WHERE source IS NOT NULL) SELECT item, min(source) AS source FROM t GROUP BY 1 HAVING min(source) = max(source)",
    "source_contribution": "SELECT source, count(*) AS rows, count(DISTINCT lang) AS keys, round(avg(n), 6) + 0.0 AS mean, round(median(n), 6) + 0.0 AS median, round(avg((n > 2000)::INT), 6) + 0.0 AS long_rate, round(avg((lang = 'en')::INT), 6) + 0.0 AS english_rate, count(*) FILTER (n > 2000) AS long, count(*) FILTER (lang = 'en') AS english FROM (SELECT *, length(coalesce(text, ''))::DOUBLE AS n FROM documents) GROUP BY source",
    "weighted_family_prior": "WITH l AS (SELECT p_brand, p_type, count(*) AS n, avg(p_retailprice::DOUBLE) AS mean, median(p_retailprice::DOUBLE) AS med FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, med DESC) AS k FROM l) SELECT p_brand, round(sum(mean * n) / sum(n), 6) + 0.0 AS mean, round(max(CASE WHEN k = 1 THEN med END), 6) + 0.0 AS median, sum(n)::BIGINT AS count FROM r GROUP BY 1",
    "lineage_duplicates": """SELECT md5(sha256(coalesce(text, '')) || '|' || coalesce(lang, '')) AS lineage, count(*) AS n, md5('[' || array_to_string([x::VARCHAR FOR x IN list_sort(list_distinct(list(doc_id)))], ',') || ']') AS ids,
        '[' || array_to_string(['"' || x || '"' FOR x IN list_sort(list_distinct(list(source)))], ',') || ']' AS sources FROM documents GROUP BY coalesce(text, ''), lang HAVING count(*) >= 2""",
    "independent_measurements": f"""WITH x AS (SELECT l_partkey, l_orderkey, rn, l_quantity::DOUBLE AS x, CASE WHEN l_linestatus = 'O' THEN 'gold' ELSE 'silver' END AS tier, CASE WHEN l_returnflag = 'N' THEN l_suppkey END AS doc FROM {NUMBERED}),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, doc, x ORDER BY tier = 'gold' DESC, l_orderkey, rn) AS k FROM x) SELECT l_partkey, l_orderkey, rn, x, tier FROM r WHERE k = 1""",
    "conflict_check": "SELECT l_orderkey, l_partkey, count(DISTINCT l_suppkey) AS n_values FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_suppkey) > 1",
    "shared_weight": "SELECT doc_id, round(0.5 / count(*) OVER (PARTITION BY source), 9) AS weight FROM documents",
    "weight_cap": "WITH d AS (SELECT doc_id, lang, length(coalesce(text, ''))::DOUBLE AS w FROM documents), s AS (SELECT lang, sum(w) AS raw FROM d GROUP BY 1), k AS (SELECT lang, CASE WHEN lang = 'en' OR raw <= 0 THEN 1.0 ELSE least(1.0, 0.1 * (SELECT raw FROM s WHERE lang = 'en') / raw) END AS scale FROM s) SELECT doc_id, d.lang, round(scale::DOUBLE, 6) + 0.0 AS scale, round(w * scale, 6) + 0.0 AS capped_weight FROM d JOIN k ON d.lang = k.lang",
    "latest_wins": "SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1 AS is_current FROM events",
    "carry_forward_parent": "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS parent FROM events",
    "priority_dedupe": f"WITH s AS (SELECT *, 4 * (l_returnflag = 'R')::INT + 2 * (l_linestatus = 'O')::INT + (l_discount > 0)::INT AS s FROM {NUMBERED}), b AS (SELECT * FROM s QUALIFY s = max(s) OVER (PARTITION BY l_orderkey)) SELECT l_orderkey, rn, l_partkey, min(l_partkey) OVER w <> max(l_partkey) OVER w AS disagree FROM b WINDOW w AS (PARTITION BY l_orderkey) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY rn) = 1",
    "distinct_on": "SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS h, count(*) AS n_copies, array_to_string([x::VARCHAR FOR x IN list_sort(list(doc_id))], '|') AS records FROM documents GROUP BY coalesce(text, '')",
    "apply_overrides": "WITH o AS (SELECT user_id, event_type FROM events WHERE event_type <> 'view' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT c_custkey, coalesce(event_type, c_mktsegment) AS c_mktsegment, c_mktsegment AS auto_c_mktsegment, event_type IS NOT NULL AS overridden FROM customer LEFT JOIN o ON c_custkey = user_id",
    "audit_overrides": "WITH o AS (SELECT user_id, event_id, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS l, ts FROM events), t AS (SELECT *, min(l) OVER w <> max(l) OVER w AS two, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM o WINDOW w AS (PARTITION BY user_id)) SELECT event_id, CASE WHEN c_custkey IS NULL THEN 'stale_key' WHEN two THEN 'conflicting_duplicates' WHEN k > 1 THEN 'superseded' ELSE 'usable' END AS reason FROM t LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = user_id",
    "wildcard_rules": "WITH r AS (SELECT n_nationkey AS rule_id, CASE WHEN n_regionkey < 2 THEN 'nation' ELSE 'customer' END AS scope, CASE WHEN n_regionkey = 1 THEN 100.0 END AS v, n_name AS reason FROM nation), h AS (SELECT c_custkey, rule_id, reason FROM customer JOIN r ON (scope = 'nation' AND c_nationkey = rule_id OR scope = 'customer' AND c_custkey = rule_id) WHERE v IS NULL OR abs(v - round(c_acctbal, 0)) < 1e-8) SELECT c_custkey, rule_id, reason FROM h QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY rule_id) = 1",
    "overlay": "WITH e AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT c_custkey, CASE WHEN user_id IS NOT NULL AND c_acctbal >= 0 THEN event_type ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'template' WHEN user_id IS NOT NULL THEN 'response' ELSE 'unanswered' END AS source FROM customer LEFT JOIN e ON c_custkey = user_id",
    "slot_unpivot": "WITH s AS (SELECT c_custkey, 1 AS slot, c_acctbal::DOUBLE AS v, c_mktsegment AS c FROM customer UNION ALL SELECT c_custkey, 2, c_nationkey::DOUBLE, c_mktsegment FROM customer) SELECT c_custkey, slot::BIGINT AS slot, round(v, 6) + 0.0 AS value, CASE WHEN v < -500 OR v > 9000 THEN 'out_of_range' WHEN c NOT IN ('BUILDING', 'MACHINERY') THEN 'unknown_class' ELSE 'accepted' END AS reason FROM s WHERE v IS NOT NULL",
    "candidate_explode": f"WITH m AS (SELECT l_orderkey, rn, l_returnflag, max(l_returnflag) OVER (PARTITION BY l_orderkey) AS chosen, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY rn) AS k FROM {NUMBERED}) SELECT l_orderkey, l_returnflag || '#' || (rn - 1) AS candidate_id, (l_returnflag = chosen AND k = 1)::BIGINT AS is_true FROM m",
}
