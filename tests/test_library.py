"""Operators on small rows with the values that follow from their definitions."""

import math

import pytest
from pyspark.sql import functions as F

from calibrant.functions import scalars as s
from calibrant.operators import encode
from calibrant.operators import evidence as ev
from calibrant.operators import joins as j
from calibrant.operators import metrics as m
from calibrant.operators import neighbours as nb
from calibrant.operators import review as rv
from calibrant.operators import states as st
from calibrant.sources import tables


def values(df, *names):
    return {tuple(r[n] for n in names) for r in df.collect()}


@pytest.fixture(scope="module")
def two_sites(spark):
    sites = spark.createDataFrame([("g", "a", 9.0), ("g", "b", 4.0)], "graph_id string, site_id string, b double")
    pairs = spark.createDataFrame([("g", "b", "a", -1.0)], "graph_id string, site_i string, site_j string, j double")
    return st.with_states(st.graphs(sites, pairs=pairs))


def test_two_site_ladder_and_edges(two_sites):
    ladder = {r.step: r.value for r in st.ladder(two_sites).collect()}
    assert ladder[1] == pytest.approx(9.0000043429, abs=1e-9) and ladder[2] == pytest.approx(2.9999956571, abs=1e-9)
    e = st.edges(two_sites).collect()
    assert sorted((r.site_id, r.value) for r in e) == [("a", 8.0), ("a", 9.0), ("b", 3.0), ("b", 4.0)]
    assert max(r.cycle_error for r in e) < 1e-12


def test_populations(spark, two_sites):
    p = st.with_populations(two_sites, 7.0)
    assert sum(r.population for r in st.state_rows(p).collect()) == pytest.approx(1.0)
    one = spark.createDataFrame([("h", "x", 7.4)], "graph_id string, site_id string, b double")
    half = st.with_populations(st.with_states(st.graphs(one)), 7.4)
    assert st.marginals(half).first().p_acid == pytest.approx(0.5)
    assert half.first().entropy == pytest.approx(math.log(2)) and half.first().gap == 0 and half.first().dominant == 0


def test_too_many_states_are_unavailable(spark):
    sites = spark.range(5).select(F.lit("g").alias("graph_id"), "id", F.lit(1.0).alias("b")).withColumnRenamed("id", "site_id")
    g = st.with_states(st.graphs(sites, cap=16))
    assert not g.first().available and g.first().states is None and st.marginals(st.with_populations(g, 1.0)).count() == 0


def test_overflow_safe_sum(spark):
    df = spark.createDataFrame([([400.0, 400.0],), ([],)], "x array<double>")
    assert [r[0] for r in df.select(st.log10_sum(F.col("x"))).collect()] == [pytest.approx(400 + math.log10(2)), None]


def test_monotone_projection(spark):
    rows = spark.createDataFrame([("g", i, v) for i, v in enumerate([5.0, 6.0, 3.0, 4.0, 2.0])], "g string, i int, v double")
    assert [r.fitted for r in st.monotone_projection(rows, "g", "i", "v").orderBy("i").collect()] == [5.5, 5.5, 3.5, 3.5, 2.0]
    fixed = rows.withColumn("fx", F.col("i") == 1)
    got = [r.fitted for r in st.projection_with_fixed(fixed, "g", "i", "v", "fx").orderBy("i").collect()]
    assert got == [6.0, 6.0, 3.5, 3.5, 2.0]


def test_scalars(spark):
    df = spark.createDataFrame([("7", "="), ("bad", "~"), (" ", None), ("<5", ">")], "v string, r string")
    assert [r[0] for r in df.select(s.safe_number("v")).collect()] == [7.0, None, None, None]
    assert [r[0] for r in df.select(s.relation("r", F.lit(None))).collect()] == ["=", "~", "=", ">"]
    assert [r[0] for r in df.select(s.exact_number("v")).collect()] == [7.0, None, None, None]
    one = spark.range(1)
    assert one.select(s.quality_score(F.lit(1), F.lit("c"), F.lit(0), F.lit(0))).first()[0] == pytest.approx(0.2)
    assert one.select(s.protonated_fraction(F.lit(7.0), F.lit(7.0))).first()[0] == 0.5
    assert one.select(s.measurement_weight(F.lit(4), F.lit(0.0), F.lit(0.0), F.lit("gold"))).first()[0] == pytest.approx(1.4)
    assert one.select(s.state_call(F.lit(0.5)), s.state_call(F.lit(None).cast("double"))).first()[:] == ("acid_form", "unavailable")
    assert one.select(s.normal_cdf(F.lit(1.96))).first()[0] == pytest.approx(0.9750021, abs=2e-7)
    assert [one.select(s.confidence_tier(F.lit(c))).first()[0] for c in (0.7, 0.4, 0.1, 0.09)] == ["high", "medium", "low", "very_low"]
    assert one.select(s.interval_confidence(F.lit(0.6), F.lit(0.9)), s.interval_confidence(F.lit(0.4), F.lit(0.6))).first()[:] == (pytest.approx(0.2), 0.0)
    assert one.select(s.integral_id(F.lit("12.0")), s.integral_id(F.lit("12A"))).first()[:] == ("12", "12A")
    refs = spark.createDataFrame([("https://doi.org/10.1021/ja01.x?q",), ("PMID: 12",), (" a  b ",), (None,), ("https://doi.org/10.1021/ja01.x.;",), ("pubmed/7",), ("http%3A//X/",)], "x string")
    assert [r[0] for r in refs.select(s.reference_key("x")).collect()] == ["10.1021/ja01.x", "pmid:12", "a b", "", "10.1021/ja01.x", "pmid:7", "http://x"]


def observations(spark, rows):
    df = spark.createDataFrame(rows, "k string, id int, v double, r string, quality double")
    return df.select("k", "id", "quality", s.censored_bounds("r", "v").alias("b")).select("k", "id", "quality", "b.*")


def test_censored_summary(spark):
    rows = [("a", 1, 5.0, "=", 1.0), ("a", 2, 7.0, "=", 1.0), ("a", 3, 8.0, ">", 1.0), ("b", 4, 8.0, ">", 1.0), ("b", 5, 5.0, "<", 1.0), ("c", 6, 2.0, ">", 1.0), ("c", 7, 4.0, "<", 1.0)]
    got = {r.k: r for r in ev.censored_summary(observations(spark, rows), "k").collect()}
    assert (got["a"].method, got["a"].value, got["a"].note, got["a"].ids) == ("exact_weighted_median", 5.0, "exact_vs_censored_disagreement", "1|2|3")
    assert (got["b"].method, got["b"].value, got["b"].note) == ("censored_conflict", None, "inconsistent_censored_bounds")
    assert (got["c"].method, got["c"].value, got["c"].conflict) == ("censored_interval", 3.0, False)
    assert ev.censored_summary(observations(spark, []), "k").count() == 0


def test_robust_statistics(spark):
    df = spark.createDataFrame([("a", 1.0, 0.0), ("a", 5.0, 5.0), ("a", 9.0, 1.0), ("z", 1.0, 0.0), ("z", 9.0, -1.0)], "k string, x double, w double")
    assert values(ev.weighted_median(df, ["k"], "x", "w"), "k", "weighted_median") == {("a", 5.0), ("z", 5.0)}
    t = spark.createDataFrame([("a", v) for v in (None, "", "b", "a")], "k string, x string")
    assert ev.mode_tiebreak(t, ["k"], "x").first().mode == "a"
    r = spark.createDataFrame([("k", 4.0, "gold", "high"), ("k", 4.4, "gold", "high"), ("k", 4.8, "gold", "high")], "k string, x double, t string, c string")
    got = ev.replicate_target(r, "k", "x", "t", "c").first()
    assert (got.target, got.n, got.tier) == (4.4, 3, "gold") and got.range == pytest.approx(0.8)
    assert ev.replicate_target(r, "k", "x", "t", "c", max_range=0.5).count() == 0


def test_evidence_rows(spark):
    df = spark.createDataFrame([(1, "d1", "a", 5.0, "silver"), (2, "d1", "a", 5.0, "gold"), (3, None, "a", 5.0, "gold"), (4, "nan", "b", 5.0, "gold"), (5, "d2", "a", 5.0, "gold")], "i int, doc string, assay string, x double, tier string")
    assert values(ev.independent_measurements(df, "doc", "assay", "x", "tier", ["i"]), "i") == {(2,), (3,), (5,)}
    log = spark.createDataFrame([(1, None, "A", 1), (1, None, "B", 2), (2, 3.0, "", 9)], "k int, v double, label string, at int")
    facts = spark.createDataFrame([(1, None, "auto"), (2, 3.0, "auto"), (3, None, "auto")], "k int, v double, label string")
    assert values(ev.apply_overrides(facts, log, ["k", "v"], "label", ["at"]), "k", "label", "auto_label", "overridden") == {(1, "B", "auto", True), (2, "auto", "auto", False), (3, "auto", "auto", False)}
    cand = spark.createDataFrame([("m", ["p", "p", "q"], "p")], "m string, l array<string>, c string")
    assert [(r.candidate_id, r.is_true) for r in ev.candidate_explode(cand, "m", F.col("l"), "c").orderBy("candidate_id").collect()] == [("p#0", 1), ("p#1", 0), ("q#2", 0)]
    best = spark.createDataFrame([(1, 1, 3.0, "x"), (1, 1, 3.0, "y"), (1, 0, 9.0, "z")], "k int, sc int, v double, i string")
    assert values(ev.priority_dedupe(best, ["k"], F.col("sc"), "i", ["i"]), "i", "disagree") == {("x", True)}


def test_joins_fail_closed(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(j.NotUnique):
        j.join_many_to_one(left, right, ["k"])
    with pytest.raises(j.GateFailed):
        j.require_all(left, small=F.col("k") < 2)
    with pytest.raises(j.GateFailed):
        j.disjoint_check(left, right, "k")
    with pytest.raises(j.GateFailed):
        j.feature_guard(left, ["k"], ["k"])
    assert values(j.coverage_match(left, right, "k"), "k", "status") == {(1, "duplicate"), (2, "missing")}
    with pytest.raises(ValueError):
        tables.require_columns(left, "k", "z")


def test_transitions(spark):
    rows = [("c", "ref", 0, {"acid": 1, "amine": 1}, True), ("c", "up", 1, {"acid": 1, "amine": 2}, False), ("c", "two", 1, {"acid": 2, "amine": 2}, False), ("c", "back", -1, {"acid": 2, "amine": 1}, False), ("c", "far", 2, {"acid": 1}, False), ("d", "x", 1, {"acid": 1}, False)]
    df = spark.createDataFrame(rows, "g string, s string, q int, f map<string,int>, r boolean")
    assert values(j.reference_transitions(df, "g", "s", "q", "f", "r"), "s", "status", "family") == {("up", "unambiguous", "amine"), ("two", "families_changed", None), ("back", "wrong_direction", None), ("far", "charge_not_one", None), ("x", "no_reference", None)}


def test_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5, 1.0), (2.0, 5.0, 3.0)], "y double, p double, w double")
    r = m.error_metrics(df).first()
    assert (r.rows, r.mae, r.over_2, r.over_3) == (2, 1.75, 1, 0) and r.weighted_mae == pytest.approx(9.5 / 4) and r.r2 == pytest.approx(1 - 9.25 / 0.5)
    assert m.error_metrics(df.limit(0)).first().rows == 0
    panel = spark.createDataFrame([(2.0, 2.5, "exact"), (1.0, 1.5, "lower_bound"), (-1.0, 0.0, "upper_bound")], "y double, p double, qualifier string")
    r = m.censored_score(panel).first()
    assert (r.exact_mae, r.bounds_satisfied, r.upper_violation) == (0.5, 0.5, 1.0)
    e = spark.createDataFrame([("k", 0.0, float(i)) for i in range(1, 10)], "k string, y double, p double")
    assert values(m.conformal_radius(e, "k"), "level", "radius") == {(0.5, 5.0), (0.8, 8.0), (0.9, 9.0), (0.95, 9.0)}
    b = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "s double, t int")
    r = m.binary_metrics(b, "s", "t").first()
    assert r.roc_auc == pytest.approx(0.875) and r.accuracy == 0.75
    assert m.binary_metrics(b.where("t = 1"), "s", "t").first().roc_auc is None


def test_set_match_and_clusters(spark):
    import itertools
    import random

    rng = random.Random(1)
    rows = [([rng.uniform(0, 9) for _ in range(rng.randrange(0, 4))], [rng.uniform(0, 9) for _ in range(rng.randrange(1, 5))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "o array<double>, p array<double>")
    for r in df.select("o", "p", m.set_match_cost(F.col("o"), F.col("p")).alias("c")).collect():
        want = None if len(r.o) > len(r.p) else min(sum(abs(a - b) for a, b in zip(sorted(r.o), q)) for q in itertools.combinations(sorted(r.p), len(r.o)))
        assert r.c is None if want is None else r.c == pytest.approx(want)
    v = spark.createDataFrame([([4.8, 4.6, 2.3, None, 9.6, 4.6],), ([1.0, 2.0, 3.0, 4.0],), ([],)], "v array<double>")
    assert [r[0] for r in v.select(m.cluster_1d(F.col("v"))).collect()] == [[[2.3], [4.6, 4.8], [9.6]], [[1.0, 2.0, 3.0], [4.0]], []]


def test_folds(spark):
    g = spark.createDataFrame([(f"g{i:02}", n) for i, n in enumerate([1, 1, 1, 2, 2, 5, 8])], "g string, n int")
    assert values(m.rarest_first_split(g, "g", "n", 0.25).where("is_test"), "g") == {("g00",), ("g01",), ("g02",), ("g03",)}
    folds = m.group_kfold(g, "g", "n", 2).groupBy("fold").agg(F.sum("n").alias("n")).collect()
    assert len(folds) == 2
    cal = m.hierarchical_calibration(
        spark.createDataFrame([(1, "l", "f", 10.0, 7.4), (2, "l", "f", 4.0, 7.4), (3, "new", "f", 7.4, 7.4)], "id int, label string, family string, p double, level double"),
        spark.createDataFrame([("l", "f", -0.1), ("l", "f", 0.1), ("k", "f", -0.3), ("k", "f", 0.3)], "label string, family string, r double"), "label", "family",
    )
    p = {r.id: r.prob for r in cal.collect()}
    assert p[1] > 0.75 and p[2] < 0.25 and p[3] == pytest.approx(0.5)


def test_neighbours(spark):
    pts = spark.createDataFrame([("s", i, x, 0.0, 0.0, 1.0) for i, x in enumerate([0.0, 3.5, 4.0, 12.0, 12.01, -3.5])], "scope string, id int, x double, y double, z double, q double")
    t = nb.radius_features(pts.withColumnRenamed("id", "site"), pts.withColumnRenamed("id", "point"), "scope", "site", "point", "q", (3.5, 4.0, 12.0))
    r = t.where("site = 0").first()
    assert (r.n_0, r.n_1, r.n_2, r.nearest) == (2, 3, 4, 3.5)
    sets = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, ["a", "b", "c", "e"]), (3, ["x"]), (4, [])], "k int, i array<string>")
    assert {(r.a_k, r.b_k) for r in nb.similar_sets(sets, sets, "k", "i", 0.6).where("a_k < b_k").collect()} == {(1, 2)}
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 9), (7, 8)], "a long, b long")
    assert values(nb.connected_groups(e), "node", "group") == {(1, 1), (2, 1), (3, 1), (4, 1), (9, 9), (7, 7), (8, 7)}
    assert values(nb.k_hop(e, e.where("a = 1").select("a"), 2), "node", "hops") == {(1, 0), (2, 1), (3, 2)}
    over = spark.createDataFrame([("g", 3.0, "a", 0, 5), ("g", 2.0, "b", 4, 8), ("g", 1.0, "c", 5, 9)], "g string, s double, i string, a int, z int")
    assert values(j.overlap_resolve(over, "g", "s", "i", "a", "z"), "i") == {("a",), ("c",)}


def test_review(spark):
    s3 = spark.createDataFrame([("g", [2, 3])], "g string, l array<int>")
    assert rv.expand_states(s3, "g", "l").count() == 6 and rv.expand_states(s3, "g", "l", cap=5).first().truncated
    a, b = spark.createDataFrame([(1, 5)], "id int, o int"), spark.createDataFrame([(1, 2), (2, 3)], "id int, o int")
    assert values(rv.merge_queues("id", ["o"], first=a, second=b), "id", "queue") == {(1, "first"), (2, "second")}


def test_sources(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("k\tv\n1\t2\n")
    (tmp_path / "b.tsv").write_text("k\tw\n3\t4\n")
    (tmp_path / "INCORRECT_c.tsv").write_text("k\tw\n5\t6\n")
    paths = [f"file://{tmp_path}/{n}" for n in ("a.tsv", "b.tsv", "INCORRECT_c.tsv", "absent.tsv")]
    assert values(tables.read_many(spark, paths, required=("k",)), "k", "v", "w", "source_file") == {("1", "2", None, "a.tsv"), ("3", None, "4", "b.tsv")}
    with pytest.raises(ValueError):
        tables.read_many(spark, paths, required=("zzz",))
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "x.json").write_text('{"data": [{"id": 7, "attributes": {"a": 1}}, {"attributes": {"id": "8", "a": 2}}]}')
    assert values(tables.read_json_records(spark, f"file://{tmp_path}/j"), "id", "a") == {("7", 1), ("8", 2)}
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "m.sdf").write_text("one\n> <pka>\n4.5\n\n> <name>\nx y\n\n$$$$\ntwo\n> <pka>\n5\n\n$$$$\n")
    for index in (False, True):
        got = {(r.title, r.tags["pka"]) for r in tables.scan_sdf_properties(spark, f"file://{tmp_path}/s", index).collect()}
        assert got == {("one", "4.5"), ("two", "5")}
    atom = "ATOM      1  CA AALA A  12      11.104   6.134  -6.504  1.00  0.00           C"
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1abc.pdb").write_text("\n".join([atom, atom.replace(" CA A", " CB B"), atom[:76], atom[:30] + "   bad  " + atom[38:], "ENDMDL", atom]))
    got = tables.scan_fixed_width_atoms(spark, f"file://{tmp_path}/p").collect()
    assert [(r.structure_id, r.atom_name, r.element, r.x) for r in got] == [("1abc", "CA", "C", 11.104)] * 2
    ledger = tables.file_ledger(spark, f"file://{tmp_path}/j")
    assert values(tables.check_ledger(ledger, spark.createDataFrame([("x.json", "0"), ("y", "1")], "name string, sha256 string")), "name", "status") == {("x.json", "mismatch"), ("y", "missing")}
    assert tables.incremental_inputs(ledger, ledger).count() == 0
    d = spark.range(5)
    assert tables.table_digest(d, "t").first() == tables.table_digest(d.repartition(3).orderBy(F.desc("id")), "t").first()


def test_provenance_and_strict_filter_with_nulls(spark):
    rows = spark.createDataFrame([("marvin", True, None, None), ("marvin", None, True, None), (None, None, True, None), ("x", True, None, ""), (None, None, None, "single_group"), (None, None, None, None)], "m string, a boolean, o boolean, t string")
    got = [r.b.detail for r in rows.select(s.provenance_bucket("m", "a", "o", "t").alias("b")).collect()]
    assert got == ["marvin_atom_match", "marvin_no_atom_match", "manual_site_override", "explicit_atom_match_non_marvin", "single_group_drawn_state", "multi_group_pair_first"]
    data = [(1, "k", "7", True, " Marvin "), (2, "k", "7", True, "marvin"), (3, "j", "21", True, "marvin"), (4, "i", "x", True, "marvin"), (5, None, "7", True, "marvin"), (6, "h", "7", None, "marvin"), (7, "g", "7", True, None)]
    df = spark.createDataFrame(data, "id int, k string, v string, strict boolean, method string")
    kept = ev.strict_training_filter(df, F.col("strict"), ["k"], "v", ["k", "v"], ["id"], method=("method", "marvin"))
    assert values(kept, "id") == {(1,)} and kept.columns == df.columns
    assert ev.strict_training_filter(df.limit(0), F.col("strict"), ["k"], "v", ["k"], ["id"]).count() == 0


def test_weight_budget(spark):
    df = spark.createDataFrame([("c", 100.0), ("a", 20.0), ("b", 20.0), ("z", 4.0), ("o", 3.0), (None, 1.0), ("n", 0.0)], "cohort string, w double")
    got = {r.cohort: r.scale for r in ev.weight_budget(df, "cohort", "w", "c", ["a", "b", "n"], 0.25, {"z": 0.02}).collect()}
    assert got == {"c": 1.0, "a": 1.0, "b": 0.25, "z": 0.5, "o": 1.0, None: 1.0, "n": 0.0}


def test_encodings(spark):
    df = spark.createDataFrame([(1, "b|a||b"), (2, None), (3, "c")], "id int, x string")
    words = encode.vocabulary(df.where("id < 3"), encode.tokens_of("x"))
    assert values(words, "token", "index") == {("a", 0), ("b", 1)}
    assert {r.id: r.indices for r in encode.multi_hot(df, "id", encode.tokens_of("x"), words).collect()} == {1: [0, 1], 2: [], 3: []}
    rows = spark.createDataFrame([(1, "a", 2.5), (2, "b", None), (3, None, 1.0)], "id int, c string, m double")
    got = {r.id: [tuple(f) for f in r.features] for r in encode.class_by_margin(rows, "c", "m", words, 2).collect()}
    assert got == {1: [(0, 1.0), (2, 2.5)], 2: [(1, 1.0)], 3: []}


def test_split_errors_and_quantiles(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, k string")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id int")
    assert values(m.split_errors(rows, "id", "k", ids(1, 3), ids(2, 3, 9)), "kind", "id") == {("overlap", "3"), ("range", "9"), ("leak", "a"), ("leak", "b")}
    assert m.split_errors(rows, "id", "k", ids(1, 2), ids(3)).count() == 0
    x = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").cast("double").alias("v")).unionByName(spark.createDataFrame([(None, 4.0), (5, None)], "k long, v double"))
    got = {r.k: (r.q, r.m) for r in m.ranks.quantiles(x, ["k"], "v", {"q": 0.9, "m": 0.5}).collect()}
    want = {r.k: (r.q, r.m) for r in x.where("v is not null").groupBy("k").agg(F.percentile("v", F.lit(0.9)).alias("q"), F.median("v").alias("m")).collect()}
    assert got == want and m.ranks.quantiles(x.limit(0), ["k"], "v", {"q": 0.9}).count() == 0


def test_gate_reaches_full_scale(spark):
    rows = [("k", g, float(g % 7), float(g % 7) + 0.01 * (g % 3), float(g % 7) + 2) for g in range(40)]
    t = m.calibration_gate(spark.createDataFrame(rows, "key string, g int, y double, p double, q double"), "key", "g").first()
    assert t.scale == 1.0 and t.p05_baseline > 0 and t.p05_zero > 0


def test_coupling_scan_finds_the_coupling(spark):
    sites = [("g", i, 9.0 - i) for i in range(5)]
    pairs = [("g", i, k, -1.5) for i in range(5) for k in range(i + 1, 5)]
    g = st.with_states(st.graphs(spark.createDataFrame(sites, "graph_id string, site_id int, b double"), pairs=spark.createDataFrame(pairs, "graph_id string, site_i int, site_j int, j double")))
    target = st.ladder(g).groupBy("graph_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "value"))), lambda x: x["value"]).alias("target"))
    terms = spark.createDataFrame([("g", [9.0 - i for i in range(5)])], "graph_id string, b array<double>").join(target, "graph_id")
    assert st.coupling_scan(terms, ridge=0.0).first().coupling == pytest.approx(-1.5)
