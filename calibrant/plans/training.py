"""Queries of what stands between evidence and a fit: provenance, strict filters, weights, encodings, splits, references."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from calibrant.functions import scalars as s
from calibrant.operators import encode
from calibrant.operators import evidence as ev
from calibrant.operators import metrics as m
from calibrant.operators import models as md
from calibrant.plans.common import NUMBERED, numbered, r6, read
from calibrant.plans.metrics import _OOF, _oof
from calibrant.plans.models import LINEAR, LINEAR_ROWS, _orders, linear_fit
from calibrant.sources import tables


def provenance_buckets(spark, d):
    """Lines by bucket and detail; the line's fields stand for method, match, override and status."""
    li = read(spark, d, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", "marvin").alias("method"), F.when(F.col("l_linestatus") == "O", True).alias("match"),
        (F.col("l_suppkey") % 5 == 0).alias("override"), F.when(F.col("l_linenumber") == 1, "single_group").alias("status"),
    )
    b = li.select(s.provenance_bucket("method", "match", "override", "status").alias("b"))
    return b.groupBy(F.col("b.bucket").alias("bucket"), F.col("b.detail").alias("detail")).agg(F.count(F.lit(1)).alias("n"))


def strict_training(spark, d):
    """Lines fit for training; of lines alike in order, quantity and flag the first stays."""
    rows = numbered(read(spark, d, "lineitem")).withColumn("sane", F.col("l_discount") <= 0.08)
    t = ev.strict_training_filter(rows, F.col("l_linestatus") == "F", ["l_partkey", "l_returnflag"], "l_quantity", ["l_orderkey", "l_quantity", "l_returnflag"], ["rn"], method=("l_returnflag", " r "), sane="sane", low=5, high=40)
    return t.select("l_orderkey", F.col("rn").cast("long").alias("rn"), r6("l_quantity").alias("l_quantity"))


def pair_training(spark, d):
    """B27, the pair form: the mode is a pair, the own form is one of two."""
    rows = numbered(read(spark, d, "lineitem")).withColumn("form", F.when(F.col("l_returnflag") == "A", "acid_form").when(F.col("l_returnflag") == "N", "base_form"))
    pairs = (F.col("l_linestatus") == "O") & F.col("form").isin("acid_form", "base_form")
    t = ev.strict_training_filter(rows, pairs, ["form"], "l_quantity", ["l_partkey", "l_suppkey", "l_quantity"], ["l_orderkey", "rn"])
    return t.select("l_partkey", "l_suppkey", r6("l_quantity").alias("l_quantity"), "l_orderkey", F.col("rn").cast("long").alias("rn"), "form")


def weight_budget(spark, d):
    """French and German texts share a budget of a quarter of the English ones' length, Spanish has its own."""
    docs = read(spark, d, "documents").select("doc_id", "lang", F.char_length(F.coalesce("text", F.lit(""))).cast("double").alias("w"))
    t = ev.weight_budget(docs, "lang", "w", "en", ["fr", "de"], 0.25, {"es": 0.025})
    return t.select("doc_id", "lang", r6("scale").alias("scale"), r6("capped_weight").alias("capped_weight"))


def multi_hot(spark, d):
    """H: the suppliers of each order as a pipe list, encoded."""
    lists = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.col("l_suppkey").cast("string")), "|").alias("suppliers"))
    tokens = encode.tokens_of("suppliers")
    t = encode.multi_hot(lists, "l_orderkey", tokens, encode.vocabulary(lists, tokens))
    return t.select("l_orderkey", F.array_join(F.col("indices").cast("array<string>"), ",").alias("indices"))


def class_by_margin(spark, d):
    """H: priority of each order, and its interaction with the price's distance from 150,000."""
    o = read(spark, d, "orders").select("o_orderkey", "o_orderpriority", ((F.col("o_totalprice") - 150000) / 1000).alias("margin"))
    words = encode.vocabulary(o, F.array(F.coalesce("o_orderpriority", F.lit("unknown"))))
    t = encode.class_by_margin(o, "o_orderpriority", "margin", words, 5)
    return t.select("o_orderkey", F.explode("features").alias("f")).select("o_orderkey", F.col("f.place").alias("place"), r6("f.value").alias("value"))


def split_errors(spark, d):
    """A split of orders with rows in both parts, ids of no order, and customers in both."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    train = o.where("o_custkey % 5 <> 0").select("o_orderkey").unionByName(o.where("o_custkey % 100 = 0").select((-F.col("o_orderkey") - 1).alias("o_orderkey")))
    test = o.where("o_custkey % 5 = 0 or o_orderkey % 97 = 0").select("o_orderkey")
    return m.split_errors(o, "o_orderkey", "o_custkey", train, test)


def utc_stamps(spark, d):
    """H: moments as UTC ISO text; per user the latest event by moment, then id."""
    e = read(spark, d, "events").select("user_id", "event_id", F.timestamp_seconds(F.col("event_id") * 86399).alias("at"))
    latest = e.groupBy("user_id").agg(F.max(F.struct("at", "event_id")).alias("e"))
    return latest.select("user_id", F.col("e.event_id").alias("event_id"), s.utc_stamp(F.col("e.at")).alias("stamp"))


def reference_keys(spark, d):
    """H: DOIs, PubMed ids, addresses and plain text around each order's key."""
    k = F.col("o_orderkey").cast("string")
    text = F.element_at(F.array(F.concat(F.lit("https://doi.org/10.1000/Order-"), k, F.lit(".,;)")), F.concat(F.lit(" HTTPS://PubMed.ncbi.nlm.nih.gov/"), k, F.lit("/ ")), F.concat(F.lit("Report%20No"), k, F.lit("/")), F.concat(F.lit("10.1234/a%2Fb"), k), F.concat(F.lit("doi:10.1234/A+"), k)), (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", s.reference_key(text).alias("reference"))


def exact_numbers(spark, d):
    """Prices written exactly, as bounds, approximately or with an error."""
    p = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = F.element_at(F.array(p, F.concat(F.lit("<"), p), F.concat(F.lit("~ "), p), F.concat(p, F.lit("±1")), F.concat(p, F.lit("="))), (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int"))
    return read(spark, d, "orders").select("o_orderkey", r6(s.exact_number(text)).alias("price"))


def written_outputs(spark, d):
    """A10: accepted and rejected orders written by one call and read back."""
    base = f"{tables.shared_dir(spark)}/outputs-{uuid.uuid4().hex[:12]}"
    o = read(spark, d, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("price"))
    tables.write_outputs(base, ["o_orderkey"], accepted=o.where("price < 200000"), rejected=o.where("price >= 200000").withColumn("why", F.lit("high")))
    back = [spark.read.parquet(f"{base}/{name}").select(F.lit(name).alias("table"), "o_orderkey", r6("price").alias("price")) for name in ("accepted", "rejected")]
    return back[0].unionByName(back[1])


def delta_target(spark, d):
    """The price's distance from the baseline where an order has several lines."""
    n = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.count(F.lit(1)) > 1).alias("several"))
    o = _oof(spark, d).join(n, "o_orderkey", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    return md.delta_target(o, "y", "q", "several").select("o_orderkey", (F.round("delta", 9) + F.lit(0.0)).alias("delta"))


def evidence_gate(spark, d):
    """Which priorities' orders, customers and statuses suffice for a fit."""
    o = read(spark, d, "orders")
    t = o.groupBy("o_orderpriority").agg(*md.evidence_counts("o_custkey", "o_orderstatus"))
    return t.select("o_orderpriority", "rows", "groups", "classes", md.enough_evidence(1000, 500, 3).alias("enough"))


def reference_residual(spark, d):
    """Orders of three priorities have the other folds' median as a prior, others are predicted outright."""
    base = m.leave_fold_out_median(_orders(spark, d).drop("features"), "o_orderpriority", "fold", "y", 3)
    o = _orders(spark, d).join(base, ["o_orderpriority", "fold"]).withColumn("prior", F.when(F.col("o_orderpriority") < "4", F.col("baseline"))).drop("baseline")
    return md.reference_residual(o, lambda y: md.candidates(y)["linear"], 3).select("o_orderkey", "fold", r6("p").alias("p"))


def paired_difference(spark, d):
    """Held-out differences between the cheapest and dearest order of each customer."""
    o = _orders(spark, d)
    ends = o.groupBy("o_custkey").agg(F.min(F.struct("y", "o_orderkey")).alias("a"), F.max(F.struct("y", "o_orderkey")).alias("b")).where("a.o_orderkey <> b.o_orderkey")
    keys = ends.select(F.explode(F.array(F.struct(F.col("a.o_orderkey").alias("o_orderkey"), F.lit("a").alias("end")), F.struct(F.col("b.o_orderkey").alias("o_orderkey"), F.lit("b").alias("end")))).alias("k")).select("k.*")
    t = md.paired_difference(o.join(keys, "o_orderkey"), "o_custkey", "end", md.candidates()["linear"], 3)
    return t.select("o_custkey", r6("dy").alias("dy"), r6("dp").alias("dp"))


QUERIES = {f.__name__: f for f in (provenance_buckets, strict_training, pair_training, weight_budget, multi_hot, class_by_margin, split_errors, utc_stamps, reference_keys, exact_numbers, written_outputs, delta_target, evidence_gate, reference_residual, paired_difference)}


SQL = {
    "reference_residual": f"""WITH {LINEAR_ROWS}, k AS (SELECT label, f, median(y) AS prior FROM lo, (SELECT unnest(range(3)) AS f) WHERE fold <> f AND label < '4' GROUP BY ALL), r AS (SELECT lo.* REPLACE (y - prior AS y), prior FROM lo JOIN k ON lo.label = k.label AND lo.fold = k.f), u AS (SELECT * FROM lo WHERE NOT label < '4'),
        {linear_fit("rb", "r")}, {linear_fit("ub", "u")} SELECT o_orderkey, fold, round(prior + {LINEAR}, 6) + 0.0 AS p FROM r JOIN rb ON rb.f = fold UNION ALL SELECT o_orderkey, fold, round({LINEAR}, 6) + 0.0 FROM u JOIN ub ON ub.f = fold""",
    "paired_difference": f"""WITH {LINEAR_ROWS}, c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY y, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM lo), t AS (SELECT * FROM c WHERE n > 1 AND (i = 1 OR i = n)), {linear_fit("tb", "t")},
        p AS (SELECT o_custkey, i = 1 AS first, y, {LINEAR} AS p FROM t JOIN tb ON tb.f = fold) SELECT a.o_custkey, round(b.y - a.y, 6) + 0.0 AS dy, round(b.p - a.p, 6) + 0.0 AS dp FROM p a JOIN p b ON a.o_custkey = b.o_custkey AND a.first AND NOT b.first""",
    "provenance_buckets": """WITH x AS (SELECT CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'marvin_atom_match' WHEN l_returnflag = 'R' THEN 'marvin_no_atom_match' WHEN l_suppkey % 5 = 0 THEN 'manual_site_override'
        WHEN l_linestatus = 'O' THEN 'explicit_atom_match_non_marvin' WHEN l_linenumber = 1 THEN 'single_group_drawn_state' ELSE 'multi_group_pair_first' END AS detail FROM lineitem)
        SELECT CASE WHEN detail LIKE 'marvin%' THEN 'marvin_backed' WHEN detail = 'multi_group_pair_first' THEN 'macro_only_no_site_truth' ELSE 'structure_supported_non_marvin' END AS bucket, detail, count(*) AS n FROM x GROUP BY ALL""",
    "strict_training": f"SELECT l_orderkey, rn, round(l_quantity, 6) + 0.0 AS l_quantity FROM {NUMBERED} WHERE l_linestatus = 'F' AND l_partkey IS NOT NULL AND l_returnflag = 'R' AND l_discount <= 0.08 AND l_quantity BETWEEN 5 AND 40 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_quantity ORDER BY rn) = 1",
    "pair_training": f"SELECT l_partkey, l_suppkey, round(l_quantity, 6) + 0.0 AS l_quantity, l_orderkey, rn, CASE l_returnflag WHEN 'A' THEN 'acid_form' ELSE 'base_form' END AS form FROM {NUMBERED} WHERE l_linestatus = 'O' AND l_returnflag IN ('A', 'N') AND l_quantity BETWEEN -5 AND 20 QUALIFY row_number() OVER (PARTITION BY l_partkey, l_suppkey, l_quantity ORDER BY l_orderkey, rn) = 1",
    "weight_budget": """WITH d AS (SELECT doc_id, lang, length(coalesce(text, ''))::DOUBLE AS w FROM documents), s AS (SELECT coalesce(sum(w) FILTER (lang = 'en'), 0) AS en, coalesce(sum(w) FILTER (lang = 'fr'), 0) AS fr, coalesce(sum(w) FILTER (lang = 'de'), 0) AS de, coalesce(sum(w) FILTER (lang = 'es'), 0) AS es FROM d),
        k AS (SELECT CASE WHEN fr > 0 THEN least(1.0, 0.25 * en / fr) ELSE 0 END AS kf, CASE WHEN de > 0 THEN least(1.0, greatest(0.0, 0.25 * en - fr) / de) ELSE 0 END AS kd, CASE WHEN es > 0 THEN least(1.0, 0.025 * en / es) ELSE 0 END AS ke FROM s),
        t AS (SELECT doc_id, lang, w, (CASE lang WHEN 'fr' THEN kf WHEN 'de' THEN kd WHEN 'es' THEN ke ELSE 1.0 END)::DOUBLE AS scale FROM d, k) SELECT doc_id, lang, round(scale, 6) + 0.0 AS scale, round(w * scale, 6) + 0.0 AS capped_weight FROM t""",
    "multi_hot": "WITH t AS (SELECT DISTINCT l_orderkey, l_suppkey::VARCHAR AS token FROM lineitem), v AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS i FROM (SELECT DISTINCT token FROM t)) SELECT l_orderkey, string_agg(i::VARCHAR, ',' ORDER BY i) AS indices FROM t JOIN v USING (token) GROUP BY 1",
    "class_by_margin": """WITH v AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i FROM (SELECT DISTINCT coalesce(o_orderpriority, 'unknown') AS p FROM orders)), t AS (SELECT o_orderkey, i, (o_totalprice - 150000) / 1000 AS margin FROM orders JOIN v ON coalesce(o_orderpriority, 'unknown') = p)
        SELECT o_orderkey, i AS place, 1.0::DOUBLE AS value FROM t UNION ALL SELECT o_orderkey, i + 5, round(margin, 6) + 0.0 FROM t WHERE margin <> 0""",
    "split_errors": """WITH tr AS (SELECT o_orderkey AS i FROM orders WHERE o_custkey % 5 <> 0 UNION SELECT -o_orderkey - 1 FROM orders WHERE o_custkey % 100 = 0), te AS (SELECT o_orderkey AS i FROM orders WHERE o_custkey % 5 = 0 OR o_orderkey % 97 = 0),
        a AS (SELECT i, 1 AS s FROM tr UNION SELECT i, 2 FROM te), k AS (SELECT o_custkey, count(DISTINCT s) AS n FROM a JOIN orders ON i = o_orderkey GROUP BY 1)
        SELECT 'overlap' AS kind, i::VARCHAR AS id FROM a GROUP BY i HAVING count(*) = 2 UNION ALL SELECT DISTINCT 'range', i::VARCHAR FROM a WHERE i NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'leak', o_custkey::VARCHAR FROM k WHERE n = 2""",
    "utc_stamps": "SELECT user_id, max(event_id) AS event_id, strftime(make_timestamp(max(event_id) * 86399 * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM events GROUP BY 1",
    "reference_keys": "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '10.1000/order-' || o_orderkey WHEN 1 THEN 'pmid:' || o_orderkey WHEN 2 THEN 'report no' || o_orderkey WHEN 3 THEN '10.1234/a/b' || o_orderkey ELSE '10.1234/a+' || o_orderkey END AS reference FROM orders",
    "exact_numbers": "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN round(o_totalprice::DECIMAL(18, 2)::DOUBLE, 6) + 0.0 END AS price FROM orders",
    "written_outputs": "SELECT CASE WHEN round(o_totalprice, 2) < 200000 THEN 'accepted' ELSE 'rejected' END AS \"table\", o_orderkey, round(round(o_totalprice, 2), 6) + 0.0 AS price FROM orders",
    "delta_target": f"WITH {_OOF}, n AS (SELECT l_orderkey, count(*) > 1 AS several FROM lineitem GROUP BY 1) SELECT o_orderkey, round(CASE WHEN coalesce(several, false) THEN y - q ELSE 0 END, 9) + 0.0 AS delta FROM x LEFT JOIN n ON o_orderkey = l_orderkey",
    "evidence_gate": "SELECT o_orderpriority, count(*) AS rows, count(DISTINCT o_custkey) AS groups, count(DISTINCT o_orderstatus) AS classes, count(*) >= 1000 AND count(DISTINCT o_custkey) >= 500 AND count(DISTINCT o_orderstatus) >= 3 AS enough FROM orders GROUP BY 1",
}
