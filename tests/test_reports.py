"""Reuse of outputs, audits, shapes, reports and the batch call on small tables."""

import itertools
import math
import random
from collections import Counter

from calibrant.functions import scalars as s
from calibrant.operators import batch
from calibrant.operators import metrics as m
from calibrant.operators import neighbours as nb
from calibrant.operators import review as rv
from calibrant.operators import states as st
from calibrant.sources import reuse
from pyspark.sql import functions as F


def test_outputs_are_reused_only_when_all_digests_match(spark, tmp_path):
    path, built = f"file://{tmp_path}/out", []

    def run(rows, settings=""):
        t = spark.createDataFrame(rows, "name string, x int")

        def build(names):
            built.append(sorted(r.name for r in names.collect()))
            return t.where("x >= 0").join(names, "name").select("x", "name")

        status = {r.name: r.status for r in reuse.refresh_outputs(spark, path, reuse.content_digests(t, "name"), build, settings).collect()}
        lies = Counter((r["_input"], r.x) for r in spark.read.parquet(f"{path}/data").collect())
        assert lies == Counter((n, x) for n, x in rows if x >= 0)
        return status

    rows = [("01", 1), ("01", 1), ("1", 2), ("a/b =c", 3), ("none", -1)]
    assert set(run(rows).values()) == {"new"}
    assert set(run(rows[::-1]).values()) == {"reused"} and built[-1] == ["01", "1", "a/b =c", "none"]
    assert run([*rows[:2], ("1", 5), *rows[3:], ("z", 9)]) == {"01": "reused", "1": "changed", "a/b =c": "reused", "none": "reused", "z": "new"}
    assert built[-1] == ["1", "z"]
    assert run([("01", 1), ("a/b =c", 3)]) == {"01": "changed", "a/b =c": "reused", "1": "gone", "none": "gone", "z": "gone"}
    spark.createDataFrame([(8, "01", "01")], "x int, _input string, name string").write.mode("append").partitionBy("name").parquet(f"{path}/data")
    assert run([("01", 1), ("a/b =c", 3)]) == {"01": "output_mismatch", "a/b =c": "reused"}
    assert set(run([("01", 1), ("a/b =c", 3)], "other").values()) == {"settings_changed"}
    empty = f"file://{tmp_path}/empty"
    t = spark.createDataFrame([("q", 1)], "name string, x int")
    for want in ("new", "reused"):
        assert [r.status for r in reuse.refresh_outputs(spark, empty, reuse.content_digests(t, "name"), lambda names: t.limit(0)).collect()] == [want]


def test_shapes(spark):
    rng = random.Random(7)
    rows = [(k, *[rng.gauss(0, 1 + k) for _ in range(3)]) for k in range(4) for _ in range(40)] + [(5, 1.0, 1.0, 1.0)] * 3 + [(6, None, 1.0, 1.0)]
    got = {r.k: r for r in nb.site_shape(spark.createDataFrame(rows, "k int, x double, y double, z double"), "k").collect()}
    for k in range(4):
        p = [r[1:] for r in rows if r[0] == k]
        c = [sum(v) / len(p) for v in zip(*p)]
        assert abs(got[k].span - max(math.dist(a, b) for a, b in itertools.combinations(p, 2))) < 1e-9
        assert abs(got[k].gyration - math.sqrt(sum(math.dist(a, c) ** 2 for a in p) / len(p))) < 1e-9 and abs(got[k].cy - c[1]) < 1e-9
    assert (got[5].n, got[5].span, got[5].gyration, got[5].reason) == (3, 0, 0, None)
    assert (got[6].n, got[6].span, got[6].reason) == (0, None, "no_points")


def test_budget_of_neighbours(spark):
    sites = spark.createDataFrame([("s", 1, 0.0, 0.0, 0.0, 1), ("s", 2, 0.0, 0.0, 0.0, 40), ("s", 3, 0.0, 0.0, 0.0, 200), ("t", 4, 0.0, 0.0, 0.0, 1)], "scope string, site int, x double, y double, z double, n int")
    points = spark.createDataFrame([("s", 10 + i, float(i), 0.0, 0.0) for i in range(1, 7)], "scope string, point int, x double, y double, z double")
    got = {(r.site, r.point): (r.selected, r.reason) for r in nb.nearest_within_budget(sites, points, "scope", "site", "point", 5.0, 3, "n", 160).collect()}
    assert {k: v for k, v in got.items() if k[0] == 1} == {(1, 11): (True, None), (1, 12): (True, None), (1, 13): (True, None), (1, 14): (False, "too_many_points"), (1, 15): (False, "too_many_points")}
    assert [got[2, 10 + i][1] for i in range(1, 6)] == [None, None, "too_many_states", "too_many_points", "too_many_points"]
    assert got[3, 11] == (False, "too_many_states") and not any(k[0] == 4 for k in got)


def test_near_duplicate_states(spark):
    text = list(range(40))
    rows = spark.createDataFrame([(1, text), (2, text[:39] + [99]), (3, list(range(100, 140))), (4, [1, 2]), (5, []), (6, None)], "k int, t array<int>")
    train = spark.createDataFrame([(50, text), (51, text), (52, list(range(500, 560)))], "k int, t array<int>")
    got = {r.k: r for r in nb.near_duplicate_audit(rows, train, "k", "t").collect()}
    assert [(got[1].similarity, got[1].nearest, got[1].status, got[1].disjoint)] == [(1.0, 50, "near_duplicate_training_chain", False)]
    assert got[2].similarity > 0.9 and got[3].similarity == 0 and got[3].nearest is None and got[3].disjoint
    assert [got[k].status for k in (4, 5, 6)] == ["target_chain_sequence_too_short", "target_chain_sequence_unavailable", "target_chain_sequence_unavailable"] and not any(got[k].disjoint for k in (4, 5, 6))


def test_portability_report(spark):
    rows = [("g", 1.0, 1.5, 1.0, 0.0, 2.0, False), ("g", 2.0, 1.0, 2.5, 1.5, 2.5, False), (None, 3.0, 3.0, 5.0, 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, "f string, y double, a double, b double, lo double, hi double, d boolean")
    got = {(r.scope, r.name, r.predictor): r for r in m.portability_report(df, ["a", "b"], "b", "lo", "hi", "f", F.col("d")).collect()}
    assert len(got) == 6 and got["overall", "", "a"].rows == 3 and abs(got["overall", "", "a"].mae - 0.5) < 1e-12 and abs(got["overall", "", "a"].gain - (2.5 / 3 - 0.5)) < 1e-12
    assert got["group", "g", "b"].gain == 0 and got["group", None, "a"].coverage == 0 and got["group", "g", "a"].coverage == 1


def test_json_with_empty_fallback(spark):
    t = spark.createDataFrame([("[1,2]",), ("[1,",), ('{"a":1}',), ("3",), ("",), (None,), (" [5]",), ('{"a":',)], "x string")
    got = t.select(s.json_list("x", "long").alias("l"), s.json_object("x", "long").alias("o")).collect()
    assert [r.l for r in got] == [[1, 2], [], [], [], [], [], [5], []] and [r.o for r in got] == [{}, {}, {"a": 1}, {}, {}, {}, {}, {}]


def test_summaries_of_empty_and_small_sets(spark):
    df = spark.createDataFrame([("e1", 2.0, "x", 0.9), ("e1", 3.0, "y", 0.5), ("e2", 1.0, "x", None)], "e string, p double, l string, c double")
    ask = lambda t: m.top1_summary(t, "e", [F.col("p")], F.col("l") == "x", F.col("l") == "y", F.col("l") == "y", "c").first()
    assert tuple(ask(df)) == (2, 0.5, 1, 1.0, 0.5) and tuple(ask(df.limit(0))) == (0, 0.0, 0, 0.0, 0.0)
    docs = spark.createDataFrame([("train_1.sdf", 1, "b"), ("train_1.sdf", 1, "a"), ("train_1.sdf", 2, None), ("other", 3, None)], "d string, e int, l string")
    got = {r.d: r for r in m.dataset_manifest(docs, "d", "e", "l", {"first": F.col("l") == "a"}, [("^train", "training")]).collect()}
    assert (got["train_1.sdf"].role, got["train_1.sdf"].entities, got["train_1.sdf"].first, got["train_1.sdf"].top_labels) == ("training", 2, 1, '{"a":1,"b":1}')
    assert (got["other"].role, got["other"].first_rate, got["other"].top_labels) == ("other", 0.0, "{}")
    c = spark.createDataFrame([([1.0, 1.5, 1.5, 5.0, 5.5, 6.0, 9.0, None],)], "v array<double>").select(m.clusters_with_medians(F.col("v")).alias("c")).first().c
    assert [tuple(x) for x in c] == [(1.0, 1.5, 2, 1.25), (5.0, 6.0, 3, 5.5), (9.0, 9.0, 1, 9.0)]


def test_duplicates_share_a_configuration(spark):
    rows = [("g", "n1", "A", 1.0, 0), ("g", "n2", "A", 1.0, 0), ("g", "n3", "B", 1.0, 0), ("h", "n4", "A", 5.0, 2)]
    got = {r.node: r for r in st.shared_populations(spark.createDataFrame(rows, "g string, node string, c string, weight double, n int"), "g", "c", 7.0).collect()}
    assert [round(got[n].population, 9) for n in ("n1", "n2", "n3", "n4")] == [0.5, 0.5, 0.5, 1.0] and [round(got[n].share, 9) for n in ("n1", "n2", "n3", "n4")] == [0.25, 0.25, 0.5, 1.0]


def test_consistency_queue(spark):
    measured = spark.createDataFrame([(1, "e", "acid", "base"), (2, "e", "base", "base"), (3, "f", "acid", "base"), (4, "e", None, "base")], "id int, e string, call string, implied string")
    states = spark.createDataFrame([("e", 7, "base", 0.2), ("e", 5, "base", 0.3), ("e", 4, "base", 0.3), ("e", 1, "acid", 0.9), ("f", 2, "acid", 0.9)], "e string, s int, form string, p double")
    got = {r.id: (r.best_state, r.best_population) for r in rv.consistency_queue(measured, states, "id", "e", "call", "implied", "s", "form", "p").collect()}
    assert got == {1: (4, 0.3), 3: (None, None)}


def test_batch_tables(spark, tmp_path):
    sites = spark.createDataFrame([(1, i, 7.4) for i in range(2)] + [(2, i, 3.0) for i in range(14)] + [(3, 0, 1.0)], "graph_id int, site_id int, b double")
    counts = batch.run_batch(f"file://{tmp_path}/b", sites, 7.4)
    assert counts == {"sites": 3, "states": 3, "alternatives": 5, "warnings": 4}
    read = lambda name: spark.read.parquet(f"file://{tmp_path}/b/{name}")
    assert {(r.graph_id, r.site_id, r.warning) for r in read("warnings").collect()} == {(2, None, batch.UNAVAILABLE), (1, None, batch.CLOSE_STATES), (1, 0, batch.BORDERLINE_SITE), (1, 1, batch.BORDERLINE_SITE)}
    assert [(r.rank, r.state) for r in read("alternatives").where("graph_id = 1").orderBy("rank").collect()] == [(1, 0), (2, 1), (3, 2)]
    assert [r.call for r in read("sites").where("graph_id = 3").collect()] == ["base_form"]
