"""Join, neighbourhood, review and ledger queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from calibrant.functions import scalars as s
from calibrant.operators import evidence as ev
from calibrant.operators import joins as j
from calibrant.operators import neighbours as nb
from calibrant.operators import review as rv
from calibrant.plans.common import NUMBERED, numbered, r6, read
from calibrant.sources import tables


def enrich_star(spark, d):
    """Lines with their order, customer and nation; every dimension key is proved unique first."""
    lines = numbered(read(spark, d, "lineitem")).select("l_orderkey", F.col("rn").cast("long").alias("rn"), "l_suppkey")
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("own"))
    sup = read(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("other"))
    n = read(spark, d, "nation").select(F.col("n_nationkey").alias("nation"), "n_name")
    t = j.join_many_to_one(j.join_many_to_one(j.join_many_to_one(lines, o, ["l_orderkey"]), c, ["o_custkey"]), sup, ["l_suppkey"])
    return j.join_many_to_one(t.withColumn("nation", F.coalesce("own", "other")), n, ["nation"]).select("l_orderkey", "rn", "o_custkey", "n_name")


def join_one_to_one(spark, d):
    top = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return j.join_one_to_one(read(spark, d, "customer").select("c_custkey"), top, ["c_custkey"])


def composite_match(spark, d):
    ps = read(spark, d, "lineitem")
    facts = ps.select("l_partkey", "l_suppkey").distinct()
    a = ps.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey", F.col("l_linenumber").alias("x"))
    b = ps.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey", F.col("l_linenumber").alias("y"))
    t = j.composite_match(facts, a, b, ["l_partkey", "l_suppkey"], "x", "y")
    return t.select("l_partkey", "l_suppkey", F.coalesce(F.array_join("xs", "|"), F.lit("")).alias("xs"), F.coalesce(F.array_join("ys", "|"), F.lit("")).alias("ys"), "status")


def exclude_known(spark, d):
    o = read(spark, d, "orders")
    new, _ = j.exclude_known(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), o, ["o_custkey"], own=F.col("o_orderstatus") == "O")
    return new


def overlap_ledger(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), F.col("lang"))
    odd, even = docs.where("doc_id % 2 = 1"), docs.where("doc_id % 2 = 0")
    return j.overlap_ledger(even.select("doc_id", "source", "h", "lang"), {"same_text": (F.col("h"), odd.select("h")), "same_context": (F.concat_ws("|", "source", "lang"), odd.where("doc_id % 3 = 1").select(F.concat_ws("|", "source", "lang").alias("k")))}).select("doc_id", "same_text", "same_context", "reasons", "eligible")


def hierarchical_lookup(spark, d):
    p = read(spark, d, "part").where("p_partkey % 3 = 0").groupBy("p_type", "p_brand").agg(F.avg(F.col("p_retailprice").cast("double") / 1000).alias("v"), F.lit(0.5).alias("u"))
    facts = read(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    t = j.hierarchical_lookup(facts, p, "p_type", "p_brand", "v", "u", spread=0.9)
    return t.select("p_partkey", r6("prior").alias("prior"), "prior_level")


def plausibility(spark, d):
    """Order prices against the reference of their priority."""
    ref = read(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg(F.col("o_totalprice").cast("double")).alias("ref"), (F.stddev_pop(F.col("o_totalprice").cast("double")) / 2).alias("unc"))
    t = read(spark, d, "orders").join(ref, "o_orderpriority")
    z = s.plausibility(F.col("o_totalprice").cast("double"), "ref", "unc")
    src = F.when(F.col("o_orderstatus") == "F", "high").when(F.col("o_orderstatus") == "O", "medium").otherwise("none")
    tier = s.evidence_tier(src, F.lit("high"), z["status"], (F.col("o_custkey") % 3 == 0).cast("int"), F.lit(""), F.lit(False))
    return t.select("o_orderkey", z["status"].alias("status"), F.round(z["z"], 4).alias("z"), tier["tier"].alias("tier"), tier["reason"].alias("reason"))


def holdout_safe_union(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "source")
    held = docs.where("doc_id % 50 = 7")
    return j.holdout_safe_union(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), held, "source")


def one_step_edges(spark, d):
    """C12 as a table join: orders of a customer whose numbers of lines differ by one."""
    n = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = read(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "n")
    a, b = o.select("o_custkey", F.col("o_orderkey").alias("acid"), (F.col("n") - 1).alias("k")), o.select("o_custkey", F.col("o_orderkey").alias("base"), F.col("n").alias("k"))
    return a.join(b, ["o_custkey", "k"]).select("o_custkey", "acid", "base")


def alternative_assignment(spark, d):
    lines = numbered(read(spark, d, "lineitem")).select("l_orderkey", "rn", F.col("l_quantity").cast("double").alias("obs"), (F.col("l_extendedprice").cast("double") / 1500).alias("pred"))
    t = j.alternative_assignment(lines, "l_orderkey", "rn", "obs", "pred")
    return t.select("l_orderkey", F.col("rn").cast("long").alias("rn"), F.col("alternative").cast("long").alias("alternative"), r6("gain").alias("gain"), "swap_improves")


def left_context_merge(spark, d):
    left = read(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("doc_id") % 2).cast("int").alias("quality"))
    return j.left_context_merge(left, read(spark, d, "labels"), ["doc_id"])


def coverage_match(spark, d):
    return j.coverage_match(read(spark, d, "documents"), read(spark, d, "labels").unionByName(read(spark, d, "labels").where("doc_id % 10 = 0")).withColumn("doc_id", F.when(F.col("doc_id") % 17 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id"))), "doc_id")


def best_overlap(spark, d):
    """Orders and the other order that shares the most of its parts."""
    o = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("ids"))
    return j.best_overlap(o.withColumnRenamed("l_orderkey", "item"), o.withColumnRenamed("l_orderkey", "candidate"), "item", "candidate", "ids", same_table=True).select("item", "candidate", r6("jaccard").alias("jaccard"), "status")


def overlap_resolve(spark, d):
    lines = numbered(read(spark, d, "lineitem")).select("l_orderkey", F.col("rn").cast("long").alias("rn"), F.col("l_extendedprice").cast("double").alias("x"), F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long").alias("a"))
    return j.overlap_resolve(lines.withColumn("z", F.col("a") + 400), "l_orderkey", "x", "rn", "a", "z")


def overlap_sets(spark, d):
    """C20: orders of a customer as items with sets of parts: larger sets win, then dearer orders; conflicts by overlap."""
    o = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_partkey") % 12).alias("m"))
    t = read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("double").alias("x")).join(o, "o_orderkey").withColumn("n", F.size("m"))
    c = j.overlap_conflicts(t, "o_custkey", "o_orderkey", "m", ["n", "x"], family="o_orderpriority", strong=("1-URGENT",))
    return j.independent_items(t, c, "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey", "kept", "overlap_with")


def reference_transitions(spark, d):
    """Orders of a customer as states: families are return flags, the order with least lines the reference."""
    f = read(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).cast("int").alias("n"))
    f = f.groupBy("l_orderkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("l_returnflag", "n")))).alias("forms"), F.sum("n").cast("int").alias("charge"))
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(f, F.col("o_orderkey") == F.col("l_orderkey"))
    least = o.groupBy("o_custkey").agg(F.min(F.struct("charge", "o_orderkey")).alias("m"))
    t = o.join(least, "o_custkey").withColumn("is_ref", F.col("m.o_orderkey") == F.col("o_orderkey"))
    return j.reference_transitions(t, "o_custkey", "o_orderkey", "charge", "forms", "is_ref").select("o_custkey", "o_orderkey", "status", F.coalesce("family", F.lit("")).alias("family"))


def provenance_gates(spark, d):
    """Gates that hold on the tables; the rows come back only if they do."""
    o = j.feature_guard(read(spark, d, "orders").withColumn("x", F.col("o_totalprice").cast("double")), ["x"], ["y"])
    o = j.require_all(o, positive=F.col("o_totalprice") > 0, keyed=F.col("o_orderkey").isNotNull())
    j.disjoint_check(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), "o_orderkey")
    return o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


def union_cohorts(spark, d):
    t = j.union_cohorts(customers=read(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("id")), suppliers=read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), "s_name"))
    return t.groupBy("cohort", "nation").agg(F.count(F.lit(1)).alias("n"), F.count("s_name").alias("named"))


def _points(spark, d):
    e = lambda i: F.col("embedding")[i].cast("double")
    return read(spark, d, "embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("id"), (10 * e(0)).alias("x"), (10 * e(1)).alias("y"), (10 * e(2)).alias("z"), (F.col("vec_id") % 3 - 1).cast("double").alias("q"))


def radius_features(spark, d):
    p = _points(spark, d)
    t = nb.radius_features(p.withColumnRenamed("id", "site"), p.withColumnRenamed("id", "point"), "scope", "site", "point", "q", (0.5, 1.0, 2.0))
    return t.select("scope", "site", "n_0", "n_1", "n_2", r6("nearest").alias("nearest"), F.round("field", 5).alias("field"))


def nearest_within(spark, d):
    p = _points(spark, d)
    t = nb.nearest_within(p.withColumnRenamed("id", "site"), p.withColumnRenamed("id", "point"), "scope", "site", "point", 2.0, 6)
    return t.select("scope", "site", "point", r6("distance").alias("distance"), F.col("rank").cast("long").alias("rank"), "n_near")


def site_center(spark, d):
    """Centroid and radius of gyration of each label's points; no self-join for the radius."""
    p = _points(spark, d)
    c = p.groupBy("scope").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.avg("z").alias("cz"))
    t = p.join(c, "scope").groupBy("scope").agg(F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.first("cz").alias("cz"), F.sqrt(F.avg(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2) + F.pow(F.col("z") - F.col("cz"), 2))).alias("gyration"), F.count(F.lit(1)).alias("n"))
    return t.select("scope", "n", *[r6(c).alias(c) for c in ("cx", "cy", "cz", "gyration")])


def similar_orders(spark, d):
    """Pairs of orders whose sets of parts have a Jaccard similarity of a half or more."""
    o = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("ids"))
    t = nb.similar_sets(o, o, "l_orderkey", "ids", 0.5).where("a_l_orderkey < b_l_orderkey")
    return t.select("a_l_orderkey", "b_l_orderkey", r6("jaccard").alias("jaccard"))


def nearest_same_label(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("ids")), "o_orderkey")
    t = nb.nearest_same_label(o.where("o_orderkey % 20 = 0"), o.where("o_orderkey % 20 <> 0"), "o_orderkey", "o_orderpriority", "ids")
    return t.select("o_orderkey", "o_orderpriority", r6("similarity").alias("similarity"), "n_train", "domain")


def connected_groups(spark, d):
    """Orders and parts (-1 less the key) linked by lines."""
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("a"), (-F.col("l_partkey").cast("long") - 1).alias("b"))
    return nb.connected_groups(e)


def k_hop_features(spark, d):
    """From the orders with keys divisible by 20 (the query set), the orders and parts within 3 hops over all lines."""
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("a"), (-F.col("l_partkey").cast("long") - 1).alias("b"))
    t = nb.hop_lists(e, e.where("a % 20 = 0").select("a"), 3)
    return t.groupBy("start", "hops").agg(F.sum(F.size("ids")).alias("n")).select("start", F.col("hops").cast("long").alias("hops"), "n")


def _site_nodes(spark, d):
    """Orders and parts (-1 less the key) linked by lines; an order's class is its status, its charge from its key."""
    e = read(spark, d, "lineitem").select(F.col("l_orderkey").cast("long").alias("a"), (-F.col("l_partkey").cast("long") - 1).alias("b"))
    o = read(spark, d, "orders").select(F.col("o_orderkey").cast("long").alias("node"), F.col("o_orderstatus").alias("class"), (F.col("o_orderkey") % 3 - 1).cast("int").alias("charge"))
    p = read(spark, d, "part").select((-F.col("p_partkey").cast("long") - 1).alias("node"), F.lit("part").alias("class"), F.lit(1).alias("charge"))
    return e, o.unionByName(p)


def class_distances(spark, d):
    """Hops, 3 at most, from every order and part to the nearest other of each class."""
    e, nodes = _site_nodes(spark, d)
    return nb.class_distances(e, nodes, 3).select("node", "class", F.col("distance").cast("long").alias("distance"))


def class_sums(spark, d):
    """How many others of each class lie within 2 hops of every order and part, and their charges."""
    e, nodes = _site_nodes(spark, d)
    return nb.class_sums(e, nodes, 2).select("node", "class", F.col("n").cast("long").alias("n"), F.col("charge").cast("long").alias("charge"))


def outlier_queue(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", (F.col("o_totalprice").cast("double") / 10000).alias("y")).withColumn("p", F.lit(15.0))
    log = read(spark, d, "events").select(F.col("user_id").alias("o_custkey"), F.col("event_type").alias("decision"), "ts", "event_id")
    t = rv.outlier_queue(o, ev.latest_wins(log, ["o_custkey"], "ts", "event_id").where("is_current"), "o_custkey", 10.0)
    return t.select("id", "o_custkey", r6("error").alias("error"), F.col("rank").cast("long").alias("rank"), "status")


def one_worst_per_entity(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("x"))
    return rv.one_worst(o, "o_custkey", [F.col("x").desc(), F.col("o_orderkey")]).select("o_orderkey", "o_custkey")


def merge_queues(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("double").alias("x"))
    return rv.merge_queues("id", high=o.where("x > 300000").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("o")), low=o.where("x < 20000").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("o")), order=["o"]).select("id", "queue", "o")


def reopen_decisions(spark, d):
    log = read(spark, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("decision"), "ts", "event_id")
    current = ev.latest_wins(log, ["id"], "ts", "event_id").where("is_current").drop("is_current")
    still = read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("id"))
    return rv.reopen_decisions(current, still, "id", "decision").select("id", "decision", "previous", "reopened")


def ambiguity_queue(spark, d):
    lines = numbered(read(spark, d, "lineitem"))
    return rv.tagged_queue(lines, {"big": F.col("l_quantity") > 48, "no_discount": F.col("l_discount") == 0, "returned": (F.col("l_returnflag") == "R") & (F.col("l_tax") == 0)}).select("l_orderkey", F.col("rn").cast("long").alias("rn"), "tags")


def conflict_review(spark, d):
    """nearest other price of each order's lines; the queue keeps what is far off."""
    t = rv.plausibility_rank(numbered(read(spark, d, "lineitem")).select("l_orderkey", "rn", F.col("l_extendedprice").cast("double").alias("x")).withColumn("ref", F.lit(40000.0)), "l_orderkey", "rn", "x", "ref", best_below=20000, margin=5000)
    return t.select("l_orderkey", F.col("rn").cast("long").alias("rn"), r6("delta").alias("delta"), "winner")


def class_examples(spark, d):
    t = rv.class_examples(read(spark, d, "documents").select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")), "lang", "h", ["doc_id"], 3)
    return t.select("doc_id", "lang")


def history_merge(spark, d):
    e = read(spark, d, "events").select("user_id", "event_type", "ts", "event_id")
    return rv.history_merge(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


def top_label_counts(spark, d):
    return rv.top_label_counts(read(spark, d, "documents"), "source", 5)


def consistency_queue(spark, d):
    """orders whose price side disagrees with their status, one row per order, the worst line kept."""
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("x"), F.when(F.col("o_orderstatus") == "F", "acid_form").otherwise("base_form").alias("call"))
    lines = numbered(read(spark, d, "lineitem")).select(F.col("l_orderkey").alias("o_orderkey"), "rn", F.col("l_extendedprice").cast("double").alias("price"))
    bad = o.where(s.agreement("x", F.lit(150000.0), "call") == "disagrees")
    t = bad.join(lines.groupBy("o_orderkey").agg(F.max_by("rn", F.struct("price", -F.col("rn"))).alias("best")), "o_orderkey", "left")
    return t.select("o_orderkey", F.col("best").cast("long").alias("best"), s.hash_id("rev_", F.col("o_orderkey").cast("string")).alias("review_id"))


def run_manifest(spark, d):
    """Rows and digests of whole tables, of which one has nulls."""
    c = read(spark, d, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("nation"))
    return tables.run_manifest(orders=read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"), customer=c, nation=read(spark, d, "nation").select("n_nationkey", "n_name"), none=c.where("c_custkey is null"))


def stable_prefix(spark, d):
    return tables.stable_prefix(read(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_custkey", "o_orderkey"], 100)


def label_frequency(spark, d):
    """Part types with their frequency and uniqueness."""
    p = read(spark, d, "part").select("p_partkey", "p_type")
    n = p.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))
    return p.join(n, "p_type").select("p_partkey", "n", r6(1 / F.log1p("n")).alias("uniqueness"))


def nested_value_counts(spark, d):
    """Items of an embedded JSON list, counted by tier with the least, middle and largest price; unreadable
    cells are skipped."""
    cell = F.to_json(F.sort_array(F.collect_list(F.struct(F.col("l_returnflag").alias("tier"), F.col("l_extendedprice").cast("double").alias("v")))))
    o = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.when(F.col("l_orderkey") % 10 == 0, "broken").otherwise(cell).alias("cell"))
    items = o.select(F.explode(F.from_json("cell", "array<struct<tier:string,v:double>>")).alias("i"))
    return items.groupBy("i.tier").agg(F.count(F.lit(1)).alias("n"), F.min("i.v").alias("low"), F.median("i.v").alias("mid"), F.max("i.v").alias("high"))


def expand_states(spark, d):
    """Mixed-radix states of the customers' coordinates, capped by count before anything is made."""
    c = read(spark, d, "customer").select("c_custkey", F.array((F.col("c_nationkey") % 3 + 1).cast("int"), (F.col("c_custkey") % 4 + 1).cast("int"), F.lit(2)).alias("levels"))
    t = rv.expand_states(c, "c_custkey", "levels", cap=20)
    return t.select("c_custkey", "truncated", F.coalesce(F.array_join("state", ","), F.lit("")).alias("state"))


QUERIES = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_PTS = "p AS (SELECT label AS scope, vec_id AS id, 10 * embedding[1]::DOUBLE AS x, 10 * embedding[2]::DOUBLE AS y, 10 * embedding[3]::DOUBLE AS z, (vec_id % 3 - 1)::DOUBLE AS q FROM embeddings), pr AS (SELECT a.scope, a.id AS site, b.id AS point, b.q, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2)) AS dist FROM p a JOIN p b ON a.scope = b.scope AND a.id <> b.id)"
_EDGE = "e AS (SELECT DISTINCT l_orderkey::BIGINT AS a, -l_partkey::BIGINT - 1 AS b FROM lineitem), u AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e)"
_NODES = "SELECT o_orderkey::BIGINT AS node, o_orderstatus AS class, (o_orderkey % 3 - 1)::INT AS charge FROM orders UNION ALL SELECT -p_partkey::BIGINT - 1, 'part', 1 FROM part"
_SETS = "s AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), n AS (SELECT l_orderkey, count(*) AS n FROM s GROUP BY 1), ov AS (SELECT a.l_orderkey AS x, b.l_orderkey AS y, count(*) AS k FROM s a JOIN s b ON a.l_partkey = b.l_partkey WHERE a.l_orderkey <> b.l_orderkey GROUP BY ALL), jc AS (SELECT x, y, round(k / (m.n + o.n - k), 9) AS j FROM ov JOIN n m ON x = m.l_orderkey JOIN n o ON y = o.l_orderkey)"

SQL = {
    "enrich_star": f"SELECT l_orderkey, rn, o_custkey, n_name FROM {NUMBERED} LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON n_nationkey = coalesce(c_nationkey, s_nationkey)",
    "join_one_to_one": "WITH t AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) SELECT c_custkey, n, n IS NOT NULL AS available FROM customer LEFT JOIN t ON c_custkey = o_custkey",
    "composite_match": "WITH f AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem), a AS (SELECT l_partkey, l_suppkey, string_agg(DISTINCT l_linenumber, '|' ORDER BY l_linenumber) AS xs FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), b AS (SELECT l_partkey, l_suppkey, string_agg(DISTINCT l_linenumber, '|' ORDER BY l_linenumber) AS ys FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2) SELECT l_partkey, l_suppkey, coalesce(xs, '') AS xs, coalesce(ys, '') AS ys, CASE WHEN xs IS NULL AND ys IS NULL THEN 'unmatched' WHEN xs IS NULL THEN 'no_first' WHEN ys IS NULL THEN 'no_second' ELSE 'matched' END AS status FROM f LEFT JOIN a USING (l_partkey, l_suppkey) LEFT JOIN b USING (l_partkey, l_suppkey)",
    "exclude_known": "SELECT c_custkey AS o_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'O')",
    "overlap_ledger": "WITH d AS (SELECT doc_id, coalesce(text, '') AS t, source || '|' || lang AS c FROM documents), f AS (SELECT doc_id, t IN (SELECT t FROM d WHERE doc_id % 2 = 1) AS same_text, c IN (SELECT c FROM d WHERE doc_id % 2 = 1 AND doc_id % 3 = 1) AS same_context FROM d WHERE doc_id % 2 = 0) SELECT *, concat_ws(';', CASE WHEN same_text THEN 'same_text' END, CASE WHEN same_context THEN 'same_context' END) AS reasons, NOT same_text AND NOT same_context AS eligible FROM f",
    "hierarchical_lookup": "WITH p AS (SELECT p_type, p_brand, avg(p_retailprice::DOUBLE / 1000) AS v FROM part WHERE p_partkey % 3 = 0 GROUP BY ALL), l AS (SELECT p_type, max(v) AS v FROM p GROUP BY 1), f AS (SELECT p_brand, avg(v) AS v FROM p GROUP BY 1 HAVING max(v) - min(v) <= 0.9), g AS (SELECT median(v) AS v FROM p) SELECT p_partkey, round(coalesce(l.v, f.v, g.v), 6) + 0.0 AS prior, CASE WHEN l.v IS NOT NULL THEN 'label' WHEN f.v IS NOT NULL THEN 'family' ELSE 'global' END AS prior_level FROM part LEFT JOIN l ON part.p_type = l.p_type LEFT JOIN f ON part.p_brand = f.p_brand, g",
    "plausibility": """WITH r AS (SELECT o_orderpriority, avg(o_totalprice::DOUBLE) AS ref, stddev_pop(o_totalprice::DOUBLE) / 2 AS unc FROM orders GROUP BY 1), z AS (SELECT o_orderkey, o_custkey % 3 = 0 AS open, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'medium' ELSE 'none' END AS src, abs(o_totalprice::DOUBLE - ref) / greatest(unc, 0.25) AS z FROM orders JOIN r USING (o_orderpriority)),
        s AS (SELECT *, CASE WHEN z > 3.5 THEN 'conflict' WHEN z > 2.5 THEN 'review' ELSE 'consistent' END AS status FROM z), t AS (SELECT *, CASE WHEN status = 'conflict' THEN 'low' WHEN status = 'consistent' THEN CASE WHEN src = 'high' THEN 'high' ELSE 'medium' END WHEN src IN ('high', 'medium') THEN 'medium' ELSE 'low' END AS tr FROM s),
        u AS (SELECT *, CASE WHEN src = 'high' AND tr <> 'low' THEN 'gold' WHEN NOT open AND tr <> 'low' THEN 'silver' ELSE 'ambiguous' END AS tier, concat_ws('+', CASE WHEN open THEN 'competing_unresolved_context' END, CASE WHEN src NOT IN ('high', 'medium') THEN 'source_does_not_identify_site' END, CASE WHEN tr = 'low' THEN 'transition_identity_low_confidence' END) AS why FROM t)
        SELECT o_orderkey, status, round(z, 4) AS z, tier, CASE tier WHEN 'gold' THEN 'source_identifies_site' WHEN 'silver' THEN 'unique_structural_site' ELSE CASE WHEN why = '' THEN 'insufficient_evidence' ELSE why END END AS reason FROM u""",
    "holdout_safe_union": "SELECT doc_id, source FROM documents WHERE doc_id % 2 = 0 OR source NOT IN (SELECT source FROM documents WHERE doc_id % 50 = 7)",
    "one_step_edges": "WITH n AS (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) SELECT a.o_custkey, a.o_orderkey AS acid, b.o_orderkey AS base FROM n a JOIN n b ON a.o_custkey = b.o_custkey AND a.n - 1 = b.n",
    "alternative_assignment": f"WITH x AS (SELECT l_orderkey, rn, l_quantity::DOUBLE AS o, l_extendedprice::DOUBLE / 1500 AS p FROM {NUMBERED}), c AS (SELECT a.l_orderkey, a.rn, a.o, a.p, b.rn AS j, b.o AS oj, b.p AS pj, abs(a.o - b.p) AS e FROM x a JOIN x b ON a.l_orderkey = b.l_orderkey AND a.rn <> b.rn) SELECT l_orderkey, rn, j AS alternative, round(abs(o - p) - e, 6) + 0.0 AS gain, e < abs(o - p) AND abs(oj - p) < abs(oj - pj) AS swap_improves FROM c QUALIFY row_number() OVER (PARTITION BY l_orderkey, rn ORDER BY e, j) = 1",
    "left_context_merge": "SELECT d.doc_id, lang, coalesce(CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE (d.doc_id % 2)::INT END, l.quality) AS quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "coverage_match": "WITH l AS (SELECT CASE WHEN doc_id % 17 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id FROM (SELECT doc_id FROM labels UNION ALL SELECT doc_id FROM labels WHERE doc_id % 10 = 0)), g AS (SELECT doc_id, count(*) AS n FROM l GROUP BY 1) SELECT coalesce(d.doc_id, g.doc_id) AS doc_id, CASE WHEN n IS NULL THEN 'missing' WHEN d.doc_id IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' ELSE 'matched' END AS status FROM documents d FULL JOIN g ON d.doc_id = g.doc_id",
    "best_overlap": f"WITH {_SETS}, b AS (SELECT x, j, count(*) AS n, min(y) AS y FROM (SELECT *, max(j) OVER (PARTITION BY x) AS m FROM jc) WHERE j = m GROUP BY x, j) SELECT x AS item, CASE WHEN n = 1 THEN y END AS candidate, round(j, 6) + 0.0 AS jaccard, CASE WHEN n = 1 THEN 'unique' ELSE 'ambiguous' END AS status FROM b",
    "provenance_gates": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "union_cohorts": "SELECT 'customers' AS cohort, c_nationkey AS nation, count(*) AS n, 0::BIGINT AS named FROM customer GROUP BY ALL UNION ALL SELECT 'suppliers', s_nationkey, count(*), count(s_name) FROM supplier GROUP BY ALL",
    "radius_features": f"WITH {_PTS} SELECT p.scope, p.id AS site, count(*) FILTER (dist <= 0.5) AS n_0, count(*) FILTER (dist <= 1.0) AS n_1, count(*) FILTER (dist <= 2.0) AS n_2, round(min(dist) FILTER (dist <= 2.0), 6) + 0.0 AS nearest, round(coalesce(sum(pr.q / greatest(dist, 1e-6)) FILTER (dist <= 2.0), 0), 5) AS field FROM p LEFT JOIN pr ON p.scope = pr.scope AND p.id = pr.site GROUP BY ALL",
    "nearest_within": f"WITH {_PTS} SELECT scope, site, point, round(dist, 6) + 0.0 AS distance, row_number() OVER w AS rank, count(*) OVER (PARTITION BY scope, site) AS n_near FROM pr WHERE dist <= 2.0 WINDOW w AS (PARTITION BY scope, site ORDER BY round(dist, 9), point) QUALIFY row_number() OVER w <= 6",
    "site_center": f"WITH {_PTS}, c AS (SELECT scope, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY 1) SELECT p.scope, count(*) AS n, round(any_value(cx), 6) + 0.0 AS cx, round(any_value(cy), 6) + 0.0 AS cy, round(any_value(cz), 6) + 0.0 AS cz, round(sqrt(avg(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2))), 6) + 0.0 AS gyration FROM p JOIN c ON p.scope = c.scope GROUP BY p.scope",
    "similar_orders": f"WITH {_SETS} SELECT x AS a_l_orderkey, y AS b_l_orderkey, round(j, 6) + 0.0 AS jaccard FROM jc WHERE j >= 0.5 AND x < y",
    "nearest_same_label": """WITH s AS (SELECT DISTINCT l_orderkey, l_suppkey, o_orderpriority AS l FROM lineitem JOIN orders ON l_orderkey = o_orderkey), n AS (SELECT l_orderkey, l, count(*) AS n FROM s GROUP BY ALL), o AS (SELECT a.l_orderkey AS x, b.l_orderkey AS y, count(*) AS k FROM s a JOIN s b ON a.l = b.l AND a.l_suppkey = b.l_suppkey WHERE a.l_orderkey % 20 = 0 AND b.l_orderkey % 20 <> 0 GROUP BY ALL),
        j AS (SELECT x, max(k / (m.n + q.n - k)) AS j FROM o JOIN n m ON x = m.l_orderkey JOIN n q ON y = q.l_orderkey GROUP BY x), t AS (SELECT l, count(*) AS c FROM n WHERE l_orderkey % 20 <> 0 GROUP BY 1)
        SELECT n.l_orderkey AS o_orderkey, n.l AS o_orderpriority, round(coalesce(j, 0), 6) + 0.0 AS similarity, coalesce(c, 0) AS n_train, CASE WHEN coalesce(c, 0) = 0 THEN 'zero_shot' WHEN round(coalesce(j, 0), 9) >= 0.7 AND c >= 5 THEN 'high' WHEN round(coalesce(j, 0), 9) >= 0.4 AND c >= 2 THEN 'medium' ELSE 'low' END AS domain FROM n LEFT JOIN j ON n.l_orderkey = x LEFT JOIN t ON n.l = t.l WHERE n.l_orderkey % 20 = 0""",
    # the smallest label reached in up to 24 steps over neighbours and what those point at
    "connected_groups": f"WITH {_EDGE}, l0 AS MATERIALIZED (SELECT u AS node, least(u, min(v)) AS g FROM u GROUP BY u), "
    + ", ".join(f"s{i} AS MATERIALIZED (SELECT u.u AS node, least(any_value(o.g), min(l.g)) AS g FROM u JOIN l{i - 1} l ON l.node = u.v JOIN l{i - 1} o ON o.node = u.u GROUP BY u.u), l{i} AS MATERIALIZED (SELECT s.node, least(s.g, t.g) AS g FROM s{i} s JOIN s{i} t ON t.node = s.g)" for i in range(1, 25))
    + ' SELECT node, g AS "group" FROM l24',
    "k_hop_features": f"WITH RECURSIVE {_EDGE}, r(start, node, hops) AS (SELECT DISTINCT a, a, 0 FROM e WHERE a % 20 = 0 UNION SELECT start, v, hops + 1 FROM r JOIN u ON node = u WHERE hops < 3), m AS (SELECT start, node, min(hops) AS hops FROM r GROUP BY ALL) SELECT start, hops::BIGINT AS hops, count(*) AS n FROM m GROUP BY ALL",
    "class_distances": f"WITH {_EDGE}, t AS ({_NODES}), r AS (SELECT DISTINCT class, u.v AS node, u.u AS src FROM t JOIN u ON u.u = t.node), m1 AS MATERIALIZED (SELECT DISTINCT node, class FROM r), p2 AS MATERIALIZED (SELECT DISTINCT a.u AS node, b.v AS other FROM u a JOIN u b ON a.v = b.u WHERE a.u <> b.v), m2 AS (SELECT DISTINCT p2.node, class FROM p2 JOIN t ON t.node = p2.other),"
    " m3 AS (SELECT DISTINCT u.u AS node, t.class FROM u JOIN p2 ON p2.node = u.v JOIN t ON t.node = p2.other WHERE p2.other <> u.u) SELECT node, class, min(k)::BIGINT AS distance FROM (SELECT *, 1 AS k FROM m1 UNION ALL SELECT *, 2 FROM m2 UNION ALL SELECT *, 3 FROM m3) GROUP BY ALL",
    "class_sums": f"WITH {_EDGE}, t AS ({_NODES}), p AS (SELECT u AS node, v AS other FROM u UNION SELECT a.u, b.v FROM u a JOIN u b ON a.v = b.u WHERE a.u <> b.v) SELECT p.node, class, count(*)::BIGINT AS n, sum(charge)::BIGINT AS charge FROM p JOIN t ON t.node = p.other GROUP BY ALL",
    "overlap_sets": """WITH RECURSIVE m AS (SELECT l_orderkey, list(DISTINCT l_partkey % 12) AS m FROM lineitem GROUP BY 1), x AS (SELECT o_custkey, o_orderkey, o_orderpriority AS f, m, row_number() OVER (PARTITION BY o_custkey ORDER BY len(m) DESC, o_totalprice DESC, o_orderkey) AS k FROM orders JOIN m ON o_orderkey = l_orderkey),
        r AS (SELECT o_custkey, k, [{'i': o_orderkey, 'm': m, 'f': f}] AS kept, o_orderkey, NULL::BIGINT AS w FROM x WHERE k = 1
        UNION ALL SELECT z.o_custkey, z.k, CASE WHEN z.w IS NULL THEN list_append(z.kept, {'i': z.o_orderkey, 'm': z.m, 'f': z.f}) ELSE z.kept END, z.o_orderkey, z.w FROM (
          SELECT x.*, r.kept, list_filter(r.kept, lambda y: len(list_intersect(y.m, x.m)) > 0 AND (len(list_intersect(y.m, x.m)) / least(len(y.m), len(x.m)) >= CASE WHEN y.f = x.f THEN 0.01 ELSE 0.75 END OR (y.f = '1-URGENT' AND len(list_intersect(y.m, x.m)) / len(x.m) >= 0.5)))[1].i AS w
          FROM r JOIN x ON x.o_custkey = r.o_custkey AND x.k = r.k + 1) z)
        SELECT o_custkey, o_orderkey, w IS NULL AS kept, w AS overlap_with FROM r""",
    "outlier_queue": "WITH l AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1), o AS (SELECT o_orderkey AS id, o_custkey, abs(o_totalprice::DOUBLE / 10000 - 15) AS e FROM orders) SELECT id, o_custkey, round(e, 6) + 0.0 AS error, row_number() OVER (PARTITION BY o_custkey ORDER BY e DESC, id) AS rank, coalesce(event_type, 'pending') AS status FROM o LEFT JOIN l ON o_custkey = user_id WHERE e > 10",
    "one_worst_per_entity": "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "merge_queues": "WITH u AS (SELECT o_custkey AS id, 'high' AS queue, 0 AS p, o_orderkey AS o FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT o_custkey, 'low', 1, o_orderkey FROM orders WHERE o_totalprice < 20000) SELECT id, queue, o FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, o) = 1",
    "reopen_decisions": "WITH l AS (SELECT user_id AS id, event_type AS d FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT id, CASE WHEN c_custkey IS NULL THEN 'defer' ELSE d END AS decision, d AS previous, c_custkey IS NULL AS reopened FROM l LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON id = c_custkey",
    "ambiguity_queue": f"WITH t AS (SELECT l_orderkey, rn, concat_ws('|', CASE WHEN l_quantity > 48 THEN 'big' END, CASE WHEN l_discount = 0 THEN 'no_discount' END, CASE WHEN l_returnflag = 'R' AND l_tax = 0 THEN 'returned' END) AS tags FROM {NUMBERED}) SELECT * FROM t WHERE tags <> ''",
    "conflict_review": f"WITH d AS (SELECT l_orderkey, rn, abs(l_extendedprice::DOUBLE - 40000) AS delta FROM {NUMBERED}), r AS (SELECT *, row_number() OVER w AS k, lead(delta) OVER w AS nx FROM d WINDOW w AS (PARTITION BY l_orderkey ORDER BY delta, rn)) SELECT l_orderkey, rn, round(delta, 6) + 0.0 AS delta, k = 1 AND delta < 20000 AND (nx IS NULL OR nx - delta >= 5000) AS winner FROM r",
    "class_examples": "WITH h AS (SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY lang, coalesce(text, '')) SELECT doc_id, lang FROM h QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 3",
    "history_merge": "SELECT user_id, event_type, event_id FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "top_label_counts": "WITH n AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY n DESC, source LIMIT 5) SELECT '{' || string_agg('\"' || source || '\":' || n, ',' ORDER BY n DESC, source) || '}' AS top FROM n",
    "consistency_queue": f"WITH o AS (SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'acid_form' ELSE 'base_form' END AS i, CASE WHEN o_orderstatus = 'F' THEN 'acid_form' ELSE 'base_form' END AS c FROM orders WHERE o_totalprice <> 150000), b AS (SELECT l_orderkey, rn FROM {NUMBERED} QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, rn) = 1) SELECT o_orderkey, rn AS best, 'rev_' || substr(sha256(o_orderkey::VARCHAR), 1, 16) AS review_id FROM o LEFT JOIN b ON o_orderkey = l_orderkey WHERE i <> c",
    "run_manifest": "SELECT 'orders' AS \"table\", '1' AS version, count(*) AS rows, coalesce(sum(('0x' || substr(sha256(concat_ws(chr(31), o_orderkey, o_custkey, o_orderstatus, o_orderpriority)), 1, 15))::HUGEINT), 0)::VARCHAR AS digest FROM orders"
    " UNION ALL SELECT 'customer', '1', count(*), sum(('0x' || substr(sha256(concat_ws(chr(31), c_custkey, c_mktsegment, coalesce(CASE WHEN c_nationkey > 4 THEN c_nationkey END::VARCHAR, chr(27)))), 1, 15))::HUGEINT)::VARCHAR FROM customer"
    " UNION ALL SELECT 'nation', '1', count(*), sum(('0x' || substr(sha256(concat_ws(chr(31), n_nationkey, n_name)), 1, 15))::HUGEINT)::VARCHAR FROM nation UNION ALL SELECT 'none', '1', 0, '0'",
    "stable_prefix": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 100",
    "label_frequency": "SELECT p_partkey, count(*) OVER (PARTITION BY p_type) AS n, round(1 / ln(1 + count(*) OVER (PARTITION BY p_type)), 6) + 0.0 AS uniqueness FROM part",
    "nested_value_counts": "SELECT l_returnflag AS tier, count(*) AS n, min(l_extendedprice::DOUBLE) AS low, median(l_extendedprice::DOUBLE) AS mid, max(l_extendedprice::DOUBLE) AS high FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1",
    "expand_states": "WITH c AS (SELECT c_custkey, c_nationkey % 3 + 1 AS a, c_custkey % 4 + 1 AS b FROM customer), x AS (SELECT c_custkey, i::VARCHAR || ',' || j || ',' || k AS state FROM c, range(3) r(i), range(4) s(j), range(2) t(k) WHERE i < a AND j < b AND a * b * 2 <= 20) SELECT c.c_custkey, a * b * 2 > 20 AS truncated, coalesce(state, '') AS state FROM c LEFT JOIN x ON c.c_custkey = x.c_custkey",
    "reference_transitions": """WITH f AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS q FROM lineitem GROUP BY 1),
        o AS (SELECT o_orderkey, o_custkey, f.* FROM orders JOIN f ON o_orderkey = l_orderkey), m AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY q, o_orderkey) = 1),
        d AS (SELECT o.o_custkey, o.o_orderkey, o.q - m.q AS step, o.a - m.a AS da, o.n - m.n AS dn, o.r - m.r AS dr FROM o JOIN m ON o.o_custkey = m.o_custkey AND o.o_orderkey <> m.o_orderkey),
        c AS (SELECT *, (da <> 0)::INT + (dn <> 0)::INT + (dr <> 0)::INT AS k, da + dn + dr AS one FROM d),
        t AS (SELECT *, CASE WHEN abs(step) <> 1 THEN 'charge_not_one' WHEN k <> 1 THEN 'families_changed' WHEN abs(one) <> 1 THEN 'several_sites' WHEN one <> step THEN 'wrong_direction' ELSE 'unambiguous' END AS status FROM c)
        SELECT o_custkey, o_orderkey, status, CASE WHEN status <> 'unambiguous' THEN '' WHEN da <> 0 THEN 'A' WHEN dn <> 0 THEN 'N' ELSE 'R' END AS family FROM t""",
    "overlap_resolve": f"""WITH RECURSIVE x AS (SELECT l_orderkey, rn, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS a, date_diff('day', DATE '1992-01-01', l_shipdate::DATE) + 400 AS z, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, rn) AS k FROM {NUMBERED}),
        r AS (SELECT l_orderkey, k, [{{'i': rn, 'a': a, 'z': z}}] AS kept FROM x WHERE k = 1
        UNION ALL SELECT x.l_orderkey, x.k, CASE WHEN len(list_filter(kept, lambda y: y.a < x.z AND x.a < y.z)) > 0 THEN kept ELSE list_append(kept, {{'i': x.rn, 'a': x.a, 'z': x.z}}) END FROM r JOIN x ON x.l_orderkey = r.l_orderkey AND x.k = r.k + 1),
        e AS (SELECT l_orderkey, unnest(kept) AS y FROM r QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY k DESC) = 1) SELECT l_orderkey, y.i AS rn, y.a AS a, y.z AS z FROM e""",
}
