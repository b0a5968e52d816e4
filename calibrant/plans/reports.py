"""Reports, audits and the batch call over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from calibrant.functions import scalars as s
from calibrant.operators import batch, encode
from calibrant.operators import joins as j
from calibrant.operators import metrics as m
from calibrant.operators import neighbours as nb
from calibrant.operators import review as rv
from calibrant.operators import states as st
from calibrant.plans import joins as join_plans
from calibrant.plans import metrics as metric_plans
from calibrant.plans import states as state_plans
from calibrant.plans.common import NUMBERED, numbered, r6, read
from calibrant.sources import reuse, tables


def _place(spark, label):
    return f"{tables.shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def nearest_budget(spark, d):
    """Each vector's neighbours within 2, kept within 6 points and 256 states; vectors start with 2, 4, 8 or 16 states."""
    p = join_plans._points(spark, d).withColumn("states", F.pow(F.lit(2.0), F.col("id") % 4 + 1))
    t = nb.nearest_within_budget(p.withColumnRenamed("id", "site"), p.drop("states").withColumnRenamed("id", "point"), "scope", "site", "point", 2.0, 6, "states", 256)
    return t.select("scope", "site", "point", r6("distance").alias("distance"), F.col("rank").cast("long").alias("rank"), "selected", F.coalesce("reason", F.lit("")).alias("reason"))


def site_shapes(spark, d):
    """Centre, gyration and span of the vectors of each label; those of label 3 lack a coordinate."""
    p = join_plans._points(spark, d).withColumn("z", F.when(F.col("scope") != 3, F.col("z")))
    return nb.site_shape(p, "scope").select("scope", "n", *[r6(c).alias(c) for c in ("cx", "cy", "cz", "gyration", "span")], F.coalesce("reason", F.lit("")).alias("reason"))


def near_duplicate_audit(spark, d):
    """Every twentieth order against the others by the sets of its parts (thirty kinds)."""
    o = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 30).alias("ids"), F.count(F.lit(1)).alias("n"))
    t = nb.near_duplicate_audit(o.where("l_orderkey % 20 = 0"), o.where("l_orderkey % 20 <> 0"), "l_orderkey", "ids", threshold=0.6, least=3, length="n")
    return t.select("l_orderkey", r6("similarity").alias("similarity"), "nearest", "length", "status", "disjoint")


def observed_transitions(spark, d):
    """customers' order states (see reference_transitions) with flags as families and their lines as sites; every third customer
    was observed twice."""
    f = read(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).cast("int").alias("n"))
    f = f.groupBy("l_orderkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("l_returnflag", "n")))).alias("forms"), F.sum("n").cast("int").alias("charge"))
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey").join(f, F.col("o_orderkey") == F.col("l_orderkey"))
    least = o.groupBy("o_custkey").agg(F.min(F.struct("charge", "o_orderkey")).alias("m"))
    t = o.join(least, "o_custkey").withColumn("is_ref", F.col("m.o_orderkey") == F.col("o_orderkey"))
    moves = j.reference_transitions(t, "o_custkey", "o_orderkey", "charge", "forms", "is_ref", sites="forms")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.explode(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("observation"))
    return j.observed_transitions(c, moves, "o_custkey", "o_orderkey")


def portability_report(spark, d):
    """Two predictions of orders' prices with intervals, over all, by status and for every third order."""
    o = metric_plans._oof(spark, d).withColumn("low", F.col("p") - 8).withColumn("high", F.col("p") + 8)
    t = m.portability_report(o, ["p", "q"], "q", "low", "high", "family", F.col("o_orderkey") % 3 == 0)
    return t.select("scope", "name", "predictor", "rows", *[r6(c).alias(c) for c in ("mae", "rmse", "bias", "p90", "gain", "nominal", "coverage")])


def shared_populations(spark, d):
    """An order's lines as drawings of configurations by their flags."""
    lines = numbered(read(spark, d, "lineitem")).select("l_orderkey", F.col("rn").cast("long").alias("rn"), F.concat("l_returnflag", "l_linestatus").alias("c"), (F.ascii("l_returnflag") / 10).alias("weight"), (F.col("l_linestatus") == "O").cast("int").alias("n"))
    t = st.shared_populations(lines, "l_orderkey", "c", 0.4)
    return t.select("l_orderkey", "rn", "duplicates", r6("population").alias("population"), r6("share").alias("share"))


def coupling_dominance(spark, d):
    """Dominant states and calls with and without couplings."""
    t = st.coupling_change(state_plans._graphs(spark, d), state_plans.LEVEL)
    return t.select("graph_id", F.col("dominant").cast("long").alias("dominant"), F.col("dominant_free").cast("long").alias("dominant_free"), "dominant_changed", F.col("changed").cast("long").alias("changed"), r6("largest").alias("largest"))


def softmax_configurations(spark, d):
    """A part's suppliers by their largest quantity, as alternatives of a configuration with a population of its own."""
    rows = read(spark, d, "lineitem").groupBy("l_partkey", F.col("l_suppkey").alias("item")).agg(F.max(F.col("l_quantity").cast("double")).alias("score")).withColumn("pop", 1.0 / (1 + F.col("l_partkey") % 5))
    t = st.softmax_rank(rows, "l_partkey", "score", "item", cap=5, population="pop")
    return t.select("l_partkey", "item", F.col("rank").cast("long").alias("rank"), r6("share").alias("share"), r6("complete").alias("complete"), "truncated")


def cluster_medians(spark, d):
    """Clusters of an order's quantities with their medians."""
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("double") / 5).alias("v"))
    c = g.select("l_orderkey", F.explode(m.clusters_with_medians(F.col("v"))).alias("c")).select("l_orderkey", "c.*")
    return c.select("l_orderkey", r6("low").alias("low"), r6("high").alias("high"), F.col("n").cast("long").alias("n"), r6("median").alias("median"))


def entity_top1_pairs(spark, d):
    """The dearest line of each order: its flag, and its status among discounted ones."""
    lines = numbered(read(spark, d, "lineitem")).select("l_orderkey", "rn", "l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("double").alias("price"), F.col("l_discount").cast("double").alias("disc"))
    t = m.top1_summary(lines, "l_orderkey", [F.col("price"), -F.col("rn")], F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", F.col("disc") > 0.05, "disc")
    return t.select("entities", r6("label_accuracy").alias("label_accuracy"), "pair_rows", r6("pair_accuracy").alias("pair_accuracy"), r6("mean_confidence").alias("mean_confidence"))


def dataset_manifest(spark, d):
    """A manifest row for the documents of each source."""
    docs = read(spark, d, "documents").where("source is not null")
    t = m.dataset_manifest(docs, "source", "doc_id", "lang", {"english": F.col("lang") == "en", "long": F.char_length(F.coalesce("text", F.lit(""))) > 2000}, [("[0-4]$", "training"), ("[5-9]$", "held_out")], top=3)
    return t.select("source", "role", "rows", "entities", "english", r6("english_rate").alias("english_rate"), "long", r6("long_rate").alias("long_rate"), "top_labels")


def consistent_states(spark, d):
    """orders whose price side disagrees with their status, with the dearest line of the implied form."""
    o = read(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "acid_form").otherwise("base_form").alias("call"), F.when(F.col("o_totalprice") > 150000, "acid_form").otherwise("base_form").alias("implied"), F.col("o_orderkey").alias("l_orderkey"))
    lines = numbered(read(spark, d, "lineitem")).select("l_orderkey", F.col("rn").cast("long").alias("rn"), F.when(F.col("l_returnflag") == "R", "acid_form").otherwise("base_form").alias("form"), F.col("l_extendedprice").cast("double").alias("price"))
    t = rv.consistency_queue(o, lines, "o_orderkey", "l_orderkey", "call", "implied", "rn", "form", "price")
    return t.select("o_orderkey", "implied", "best_state", r6("best_population").alias("best_population"), "review_id")


def json_cells(spark, d):
    """H: JSON cells of customers, some broken, null or of another kind, as lists and objects."""
    k = F.col("c_custkey")
    cell = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.concat(F.lit("["), k.cast("string"), F.lit(", 7]"))).when(k % 5 == 2, F.lit("[1, broken")).when(k % 5 == 3, F.concat(F.lit('{"a": '), k.cast("string"), F.lit("}"))).otherwise(F.lit("5"))
    c = read(spark, d, "customer").select("c_custkey", cell.alias("cell"))
    return c.select("c_custkey", F.array_join(F.transform(s.json_list("cell", "long"), lambda x: x.cast("string")), ",").alias("items"), F.size(s.json_object("cell", "long")).cast("long").alias("names"), F.coalesce(F.try_element_at(s.json_object("cell", "long"), F.lit("a")), F.lit(-1)).alias("a"))


def one_hot(spark, d):
    """H: the place of each document's source among the sources in order; those of another vocabulary have none."""
    docs = read(spark, d, "documents").select("doc_id", "source")
    words = encode.vocabulary(docs.where("source not like '%1'"), F.array(F.coalesce("source", F.lit("unknown"))))
    return encode.one_hot(docs, "source", words).select("doc_id", F.coalesce("index", F.lit(-1)).alias("index"))


def keyed_files(spark, d):
    """Three tables' files read together, each row with the entity that its file's name tells."""
    t = spark.read.option("mergeSchema", True).parquet(*[f"{d}/{t}.parquet" for t in ("nation", "supplier", "customer")])
    return tables.keyed_files(t, r"^([a-z]+)\.parquet$").groupBy("entity_id").agg(F.count(F.lit(1)).alias("rows"), F.count("n_name").alias("named"), F.count("s_suppkey").alias("suppliers"))


def reused_outputs(spark, d):
    """Orders by priority are inputs. A second run finds one changed, one gone, one whose output was tampered with, one new and one as it was; the rows
    are those of a run from nothing."""
    path = _place(spark, "reused")
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), "o_orderkey", F.col("o_totalprice").cast("double").alias("price"))
    before = o.where("name <> '5-LOW' and not (name = '1-URGENT' and o_orderkey % 7 = 0)")
    after = o.where("name <> '2-HIGH'")
    for rows in (before, after):
        status = reuse.refresh_outputs(spark, path, reuse.content_digests(rows, "name"), lambda names, rows=rows: rows.join(names, "name").select("name", "o_orderkey", F.round("price", 2).alias("price")), settings="two places")
        if rows is before:
            spark.range(1).select(F.lit(0).cast(dict(o.dtypes)["o_orderkey"]).alias("o_orderkey"), F.lit(0.0).alias("price"), F.lit("3-MEDIUM").alias("_input"), F.lit("3-MEDIUM").alias("name")).write.mode("append").partitionBy("name").parquet(f"{path}/data")
    n = spark.read.parquet(f"{path}/data").groupBy(F.col("_input").alias("name")).agg(F.count(F.lit(1)).alias("rows"))
    return status.join(n, "name", "left").select("name", "status", F.coalesce("rows", F.lit(0)).alias("rows"))


def _batch(spark, d):
    path = _place(spark, "batch")
    return path, batch.run_batch(path, state_plans._sites(spark, d), state_plans.LEVEL, coupling=lambda a, b: -100 * a["disc"] * b["disc"])


def batch_counts(spark, d):
    """The tables of a batch of all orders and their rows, as counted while they were written."""
    _, counts = _batch(spark, d)
    return spark.createDataFrame([(k, v) for k, v in counts.items()], "`table` string, rows long")


def batch_alternatives(spark, d):
    """The three likeliest states of every order."""
    path, _ = _batch(spark, d)
    t = spark.read.parquet(f"{path}/alternatives")
    return t.select("graph_id", F.col("rank").cast("long").alias("rank"), F.col("state").cast("long").alias("state"), r6("population").alias("population"), r6("cumulative").alias("cumulative"))


def batch_warnings(spark, d):
    """What asks for a second look."""
    path, _ = _batch(spark, d)
    return spark.read.parquet(f"{path}/warnings").select("graph_id", F.coalesce("site_id", F.lit(-1)).cast("long").alias("site_id"), "warning", r6("value").alias("value"))


QUERIES = {k: v for k, v in dict(globals()).items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

_S, _PTS, _SETS, _OOF = state_plans._S, join_plans._PTS, join_plans._SETS, metric_plans._OOF
_FREE = _S.replace("-100 * x.disc * y.disc", "0.0")
_TOP = "row_number() OVER (PARTITION BY graph_id ORDER BY round(p, 9) DESC, state)"
_SHARE = "SELECT s.graph_id, site_id, sum(CASE WHEN (state >> (site_id - 1)) & 1 = 1 THEN p ELSE 0 END) AS p FROM s JOIN q ON s.graph_id = q.graph_id GROUP BY ALL"

SQL = {
    "nearest_budget": f"""WITH {_PTS}, r AS (SELECT scope, site, point, dist, row_number() OVER (PARTITION BY scope, site ORDER BY round(dist, 9), point) AS rank, 8 - (site % 4 + 1) AS room FROM pr WHERE dist <= 2.0)
        SELECT scope, site, point, round(dist, 6) + 0.0 AS distance, rank, rank <= 6 AND rank <= room AS selected, CASE WHEN rank > 6 THEN 'too_many_points' WHEN rank > room THEN 'too_many_states' ELSE '' END AS reason FROM r""",
    "site_shapes": f"""WITH {_PTS}, k AS (SELECT * FROM p WHERE scope <> 3), c AS (SELECT scope, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz, count(*) AS n FROM k GROUP BY 1), g AS (SELECT k.scope, sqrt(avg(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2))) AS g FROM k JOIN c ON k.scope = c.scope GROUP BY 1),
        w AS (SELECT a.scope, max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))) AS span FROM k a JOIN k b ON a.scope = b.scope GROUP BY 1)
        SELECT u.scope, coalesce(n, 0) AS n, round(cx, 6) + 0.0 AS cx, round(cy, 6) + 0.0 AS cy, round(cz, 6) + 0.0 AS cz, round(g, 6) + 0.0 AS gyration, round(span, 6) + 0.0 AS span, CASE WHEN n IS NULL THEN 'no_points' ELSE '' END AS reason FROM (SELECT DISTINCT scope FROM p) u LEFT JOIN c ON u.scope = c.scope LEFT JOIN g ON u.scope = g.scope LEFT JOIN w ON u.scope = w.scope""",
    "near_duplicate_audit": """WITH s AS (SELECT DISTINCT l_orderkey, l_partkey % 30 AS i FROM lineitem), c AS (SELECT l_orderkey, count(*) AS k FROM s GROUP BY 1), l AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1),
        o AS (SELECT a.l_orderkey AS x, b.l_orderkey AS y, count(*) AS k FROM s a JOIN s b ON a.i = b.i WHERE a.l_orderkey % 20 = 0 AND b.l_orderkey % 20 <> 0 GROUP BY ALL), j AS (SELECT x, y, round(o.k / (p.k + q.k - o.k), 9) AS j FROM o JOIN c p ON x = p.l_orderkey JOIN c q ON y = q.l_orderkey),
        b AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY x ORDER BY j DESC, y) = 1)
        SELECT l.l_orderkey, CASE WHEN n >= 3 THEN round(coalesce(j, 0), 6) + 0.0 END AS similarity, CASE WHEN n >= 3 THEN y END AS nearest, n AS length, CASE WHEN n < 3 THEN 'target_chain_sequence_too_short' WHEN coalesce(j, 0) >= 0.6 THEN 'near_duplicate_training_chain' ELSE 'disjoint_at_proxy_threshold' END AS status, n >= 3 AND coalesce(j, 0) < 0.6 AS disjoint
        FROM l LEFT JOIN b ON l.l_orderkey = x WHERE l.l_orderkey % 20 = 0""",
    "observed_transitions": """WITH f AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) AS q FROM lineitem GROUP BY 1),
        o AS (SELECT o_orderkey, o_custkey, f.* FROM orders JOIN f ON o_orderkey = l_orderkey), m AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY q, o_orderkey) = 1),
        t AS (SELECT o.o_custkey, o.o_orderkey, CASE WHEN o.a <> m.a THEN 'A' WHEN o.n <> m.n THEN 'N' ELSE 'R' END AS fam, CASE WHEN o.a <> m.a THEN m.a WHEN o.n <> m.n THEN m.n ELSE m.r END AS sites FROM o JOIN m ON o.o_custkey = m.o_custkey AND o.o_orderkey <> m.o_orderkey
          WHERE abs(o.q - m.q) = 1 AND (o.a <> m.a)::INT + (o.n <> m.n)::INT + (o.r <> m.r)::INT = 1),
        u AS (SELECT o_custkey, count(*) AS n, count(DISTINCT fam) AS k, string_agg(DISTINCT fam, '|' ORDER BY fam) AS families, min(o_orderkey) AS first FROM t WHERE sites = 1 GROUP BY 1),
        c AS (SELECT c_custkey AS o_custkey, unnest(CASE WHEN c_custkey % 3 = 0 THEN [1, 2] ELSE [1] END) AS observation FROM customer)
        SELECT c.o_custkey, observation, count(*) OVER (PARTITION BY c.o_custkey) AS n_observations, coalesce(n, 0) AS n_unambiguous, coalesce(families, '') AS families, c.o_custkey % 3 <> 0 AND coalesce(k, 0) = 1 AS usable, CASE WHEN c.o_custkey % 3 <> 0 AND k = 1 THEN first END AS o_orderkey FROM c LEFT JOIN u ON c.o_custkey = u.o_custkey""",
    "portability_report": f"""WITH {_OOF}, z AS (SELECT 'overall' AS scope, '' AS name, * FROM x UNION ALL SELECT 'group', family, * FROM x UNION ALL SELECT 'disjoint', '', * FROM x WHERE o_orderkey % 3 = 0),
        l AS (SELECT scope, name, 'p' AS predictor, y, p AS v, p FROM z UNION ALL SELECT scope, name, 'q', y, q, p FROM z), a AS (SELECT scope, name, predictor, count(*) AS rows, avg(abs(y - v)) AS mae, sqrt(avg((y - v) * (y - v))) AS rmse, avg(v - y) AS bias, quantile_cont(abs(y - v), 0.9) AS p90, avg((y BETWEEN p - 8 AND p + 8)::INT) AS coverage FROM l GROUP BY ALL)
        SELECT a.scope, a.name, a.predictor, a.rows, round(a.mae, 6) + 0.0 AS mae, round(a.rmse, 6) + 0.0 AS rmse, round(a.bias, 6) + 0.0 AS bias, round(a.p90, 6) + 0.0 AS p90, round(b.mae - a.mae, 6) + 0.0 AS gain, 0.9::DOUBLE AS nominal, round(a.coverage, 6) + 0.0 AS coverage FROM a JOIN a b ON a.scope = b.scope AND a.name = b.name AND b.predictor = 'q'""",
    "shared_populations": f"""WITH x AS (SELECT l_orderkey, rn, l_returnflag || l_linestatus AS c, ascii(l_returnflag) / 10 AS w, (l_linestatus = 'O')::INT AS n FROM {NUMBERED}), k AS (SELECT l_orderkey, c, count(*) AS dup, any_value(w - n * 0.4::DOUBLE) AS e FROM x GROUP BY ALL),
        p AS (SELECT l_orderkey, c, dup, pow(10, e - max(e) OVER w) / sum(pow(10, e - m)) OVER w AS p FROM (SELECT *, max(e) OVER (PARTITION BY l_orderkey) AS m FROM k) WINDOW w AS (PARTITION BY l_orderkey))
        SELECT x.l_orderkey, rn, dup AS duplicates, round(p, 6) + 0.0 AS population, round(p / dup, 6) + 0.0 AS share FROM x JOIN p ON x.l_orderkey = p.l_orderkey AND x.c = p.c""",
    "coupling_dominance": f"""WITH a AS (WITH {_S} {_SHARE}), f AS (WITH {_FREE} {_SHARE}), da AS (WITH {_S} SELECT graph_id, state FROM q QUALIFY {_TOP} = 1), df AS (WITH {_FREE} SELECT graph_id, state FROM q QUALIFY {_TOP} = 1),
        c AS (SELECT a.graph_id, count(*) FILTER ((round(a.p, 9) >= 0.5) <> (round(f.p, 9) >= 0.5)) AS changed, max(abs(a.p - f.p)) AS largest FROM a JOIN f ON a.graph_id = f.graph_id AND a.site_id = f.site_id GROUP BY a.graph_id)
        SELECT c.graph_id, da.state AS dominant, df.state AS dominant_free, da.state <> df.state AS dominant_changed, changed, round(largest, 6) + 0.0 AS largest FROM c JOIN da ON c.graph_id = da.graph_id JOIN df ON c.graph_id = df.graph_id""",
    "softmax_configurations": """WITH r AS (SELECT l_partkey, l_suppkey AS item, max(l_quantity::DOUBLE) AS score FROM lineitem GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY score DESC, item) AS rank, count(*) OVER (PARTITION BY l_partkey) AS n FROM r),
        e AS (SELECT *, exp((score - max(score) OVER (PARTITION BY l_partkey)) / 5) AS e FROM k WHERE rank <= 5)
        SELECT l_partkey, item, rank, round(e / sum(e) OVER w, 6) + 0.0 AS share, round(e / sum(e) OVER w / (1 + l_partkey % 5), 6) + 0.0 AS complete, n > 5 AS truncated FROM e WINDOW w AS (PARTITION BY l_partkey)""",
    "cluster_medians": """WITH RECURSIVE v AS (SELECT l_orderkey, x, row_number() OVER (PARTITION BY l_orderkey ORDER BY x) AS k FROM (SELECT DISTINCT l_orderkey, l_quantity::DOUBLE / 5 AS x FROM lineitem)),
        r AS (SELECT l_orderkey, k, x, x AS first, 1 AS c FROM v WHERE k = 1 UNION ALL SELECT v.l_orderkey, v.k, v.x, CASE WHEN round(v.x - r.x, 9) <= 1 AND round(v.x - first, 9) <= 2 THEN first ELSE v.x END, CASE WHEN round(v.x - r.x, 9) <= 1 AND round(v.x - first, 9) <= 2 THEN c ELSE c + 1 END FROM r JOIN v ON v.l_orderkey = r.l_orderkey AND v.k = r.k + 1)
        SELECT l_orderkey, round(min(x), 6) + 0.0 AS low, round(max(x), 6) + 0.0 AS high, count(*) AS n, round(median(x), 6) + 0.0 AS "median" FROM r GROUP BY l_orderkey, c""",
    "entity_top1_pairs": f"WITH t AS (SELECT * FROM {NUMBERED} QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, rn) = 1) SELECT count(*) AS entities, round(avg((l_returnflag = 'R')::INT), 6) + 0.0 AS label_accuracy, count(*) FILTER (l_discount::DOUBLE > 0.05) AS pair_rows, round(coalesce(avg((l_linestatus = 'O')::INT) FILTER (l_discount::DOUBLE > 0.05), 0), 6) + 0.0 AS pair_accuracy, round(avg(l_discount::DOUBLE), 6) + 0.0 AS mean_confidence FROM t",
    "dataset_manifest": """WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY source, lang), n AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) <= 3), t AS (SELECT source, '{' || string_agg('"' || lang || '":' || n, ',' ORDER BY n DESC, lang) || '}' AS top_labels FROM n GROUP BY 1)
        SELECT d.source, CASE WHEN regexp_matches(d.source, '[0-4]$') THEN 'training' WHEN regexp_matches(d.source, '[5-9]$') THEN 'held_out' ELSE 'other' END AS role, count(*) AS rows, count(DISTINCT doc_id) AS entities, count(*) FILTER (lang = 'en') AS english, round(avg(coalesce(lang = 'en', false)::INT), 6) + 0.0 AS english_rate,
        count(*) FILTER (length(coalesce(text, '')) > 2000) AS long, round(avg((length(coalesce(text, '')) > 2000)::INT), 6) + 0.0 AS long_rate, coalesce(any_value(top_labels), '{}') AS top_labels FROM documents d LEFT JOIN t ON d.source = t.source WHERE d.source IS NOT NULL GROUP BY d.source""",
    "consistent_states": f"""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'acid_form' ELSE 'base_form' END AS call, CASE WHEN o_totalprice > 150000 THEN 'acid_form' ELSE 'base_form' END AS implied FROM orders), l AS (SELECT l_orderkey, rn, CASE WHEN l_returnflag = 'R' THEN 'acid_form' ELSE 'base_form' END AS form, l_extendedprice::DOUBLE AS p FROM {NUMBERED}),
        b AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey, form ORDER BY p DESC, rn) = 1) SELECT o_orderkey, implied, rn AS best_state, round(p, 6) + 0.0 AS best_population, 'rev_' || substr(sha256(o_orderkey || '|' || o_orderkey), 1, 16) AS review_id FROM o LEFT JOIN b ON o_orderkey = l_orderkey AND implied = form WHERE call <> implied""",
    "json_cells": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 1 THEN c_custkey || ',7' ELSE '' END AS items, (c_custkey % 5 = 3)::BIGINT AS names, CASE WHEN c_custkey % 5 = 3 THEN c_custkey ELSE -1 END AS a FROM customer",
    "one_hot": "WITH v AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i FROM (SELECT DISTINCT source FROM documents WHERE source NOT LIKE '%1')) SELECT doc_id, coalesce(i, -1) AS index FROM documents d LEFT JOIN v ON d.source = v.source",
    "keyed_files": "SELECT 'nation' AS entity_id, count(*) AS rows, count(n_name) AS named, 0::BIGINT AS suppliers FROM nation UNION ALL SELECT 'supplier', count(*), 0, count(s_suppkey) FROM supplier UNION ALL SELECT 'customer', count(*), 0, 0 FROM customer",
    "reused_outputs": "SELECT o_orderpriority AS name, CASE o_orderpriority WHEN '1-URGENT' THEN 'changed' WHEN '2-HIGH' THEN 'gone' WHEN '3-MEDIUM' THEN 'output_mismatch' WHEN '5-LOW' THEN 'new' ELSE 'reused' END AS status, count(*) FILTER (o_orderpriority <> '2-HIGH') AS rows FROM orders GROUP BY 1",
    "batch_counts": f"""WITH {_S}, g AS (SELECT graph_id, count(*) AS k FROM s GROUP BY 1), m AS ({_SHARE}), r AS (SELECT graph_id, p, {_TOP} AS rk FROM q), gap AS (SELECT graph_id, max(p) FILTER (rk = 1) - max(p) FILTER (rk = 2) AS gap FROM r GROUP BY 1)
        SELECT 'sites' AS "table", (SELECT count(*) FROM m) AS rows UNION ALL SELECT 'states', (SELECT count(*) FROM g) UNION ALL SELECT 'alternatives', (SELECT count(*) FROM r WHERE rk <= 3)
        UNION ALL SELECT 'warnings', (SELECT count(*) FROM g WHERE k > 12) + (SELECT count(*) FROM gap WHERE round(gap, 9) < 0.1) + (SELECT count(*) FROM m WHERE round(abs(p - 0.5), 9) < 0.05)""",
    "batch_alternatives": f"WITH {_S}, r AS (SELECT graph_id, state, p, {_TOP} AS rank FROM q) SELECT graph_id, rank, state, round(p, 6) + 0.0 AS population, round(sum(p) OVER (PARTITION BY graph_id ORDER BY rank), 6) + 0.0 AS cumulative FROM r WHERE rank <= 3",
    "batch_warnings": f"""WITH {_S}, g AS (SELECT graph_id, count(*) AS k FROM s GROUP BY 1), m AS ({_SHARE}), r AS (SELECT graph_id, p, {_TOP} AS rk FROM q), gap AS (SELECT graph_id, max(p) FILTER (rk = 1) - max(p) FILTER (rk = 2) AS gap FROM r GROUP BY 1)
        SELECT graph_id, -1::BIGINT AS site_id, 'state_space_over_cap' AS warning, k::DOUBLE AS "value" FROM g WHERE k > 12 UNION ALL SELECT graph_id, -1, 'dominant_state_not_clear', round(gap, 6) + 0.0 FROM gap WHERE round(gap, 9) < 0.1
        UNION ALL SELECT graph_id, site_id, 'site_near_half', round(p, 6) + 0.0 FROM m WHERE round(abs(p - 0.5), 9) < 0.05""",
}
