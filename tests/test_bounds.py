"""Results at sizes and layouts beyond those of the given tables."""

import math

from pyspark.sql import functions as F

from calibrant.functions import scalars as s
from calibrant.operators import joins as j
from calibrant.operators import metrics as m
from calibrant.operators import neighbours as nb
from calibrant.operators import states
from calibrant.plans import registry


def test_stamps_of_years_of_five_digits(spark):
    t = spark.createDataFrame([(0, "1970-01-01T00:00:00Z"), (253402300799, "9999-12-31T23:59:59Z"), (253402300800, "10000-01-01T00:00:00Z"), (518_393_913_601, "18397-04-01T13:20:01Z")], "at long, want string")
    assert t.select(s.utc_stamp(F.timestamp_seconds("at")).alias("got"), "want").where("got <> want").collect() == []


def test_tables_in_parts_are_one_entry_each(spark, tmp_path):
    for name in ("nation", "part", "region", "orders"):
        spark.range(10).repartition(3).write.parquet(f"file://{tmp_path}/{name}.parquet")
    (tmp_path / "events.parquet").write_bytes(b"x")
    got = {r.name: r.status for r in registry.QUERIES["integrity_ledger"](spark, str(tmp_path)).collect()}
    assert got == {"part.parquet": "mismatch", "region.parquet": "unexpected", "gone.parquet": "missing", "orders.parquet": "ok", "events.parquet": "ok"}


def test_matches_of_items_dealt_out(spark):
    """3,000 sets that all hold one item: 4.5 million pairs. An item dealt out over places gives the same."""
    rows = spark.range(3000).select("id", F.array(F.lit(-1), F.col("id"), F.col("id") % 50 + 10000).alias("m"))
    before, got = nb.HOLDERS, []
    try:
        for holders in (4096, 100):
            nb.HOLDERS = holders
            got.append({r.id: (r.jaccard, r.n_best, r.match) for r in nb.best_matches(rows, rows, "id", "m", same_table=True).collect()})
    finally:
        nb.HOLDERS = before
    assert got[0] == got[1] == {i: (0.5, 59, i % 50 if i >= 50 else i + 50) for i in range(3000)}


def test_the_grid_of_the_scan_stays_in_its_row(spark):
    t = spark.createDataFrame([(1, [9.0, 8.0], [9.0, 7.7])], "graph_id int, b array<double>, target array<double>")
    plan = states.coupling_scan(t)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_neighbourhoods_are_lists_not_pairs(spark, monkeypatch):
    """200 nodes around 4 centres: 40,000 pairs within two hops, and no table of more rows than nodes or edges; the same when ids are dealt over buckets."""
    edges = spark.range(200).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("a"), (F.col("id") + 10).alias("b"))
    nodes = spark.range(210).select(F.col("id").alias("node"), F.when(F.col("id") < 10, "hub").otherwise("leaf").alias("class"), (F.col("id") % 3 - 1).cast("int").alias("charge"))
    write, rows = nb.cut, []

    def counted(df, label="cut"):
        out = write(df, label)
        rows.append(out.count())
        return out

    monkeypatch.setattr(nb, "cut", counted)
    charge = sum(i % 3 - 1 for i in range(10, 210))
    for gathered in (nb.GATHERED, 50):
        monkeypatch.setattr(nb, "GATHERED", gathered)
        rows.clear()
        sums = {(r.node, r["class"]): (r.n, r.charge) for r in nb.class_sums(edges, nodes, 2).collect()}
        assert len(sums) == 408 and sums[0, "leaf"] == (200, charge) and sums[0, "hub"] == (3, 0) and sums[12, "leaf"] == (199, charge + 1) and sums[12, "hub"] == (4, -1)
        hops = nb.hop_lists(edges, edges.select("b"), 3)
        assert gathered == 50 or max(rows) <= 800
        assert {(r.start, r.hops): r.n for r in hops.groupBy("start", "hops").agg(F.sum(F.size("ids")).alias("n")).collect()} == {(i, h): n for i in range(10, 210) for h, n in ((0, 1), (1, 4), (2, 199))}


def test_statistics_beside_others_take_one_sort(spark):
    t = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (1, 3, 5.0), (2, 1, 7.0), (3, 1, None), (3, 2, 4.0)], "g int, i int, x double")
    got = m.context_stats(t, "g", "i", "x")
    assert got._jdf.queryExecution().sparkPlan().toString().count("Window") == 3 and got._jdf.queryExecution().executedPlan().toString().count("Sort [") == 1
    assert {tuple(r) for r in got.collect() if r.g < 3} == {(1, 1, 2, 2.0, 5.0, 3.5, 0.0, 0, 1), (1, 2, 2, 2.0, 5.0, 3.5, 0.0, 0, 1), (1, 3, 2, 2.0, 2.0, 2.0, 3.0, 2, 0), (2, 1, 0, 0.0, 0.0, 0.0, 0.0, 0, 0)}


def test_small_groups_are_not_dealt_over_ranges(spark, monkeypatch):
    write, labels = j.cut, []
    monkeypatch.setattr(j, "cut", lambda df, label="cut": labels.append(label) or write(df, label))
    t = spark.createDataFrame([(g, i, float(i), float(i * g)) for g in range(5) for i in range(4)], "g int, i int, o double, p double")
    assert j.alternative_assignment(t, "g", "i", "o", "p").count() == 20 and "on-a-line" not in labels


def test_neighbours_in_blocks(spark, monkeypatch):
    """Points that all are near and tie in places, against plain Python, in blocks of a few; the ledger of all pairs is ranked where they meet."""
    rows = [(s, i, float(i % 5), float(i % 3), (i % 7) / 2) for s in "ab" for i in range(60)] + [("a", 99, None, 0.0, 0.0), (None, 98, 0.0, 0.0, 0.0)]
    t = spark.createDataFrame(rows, "scope string, id int, x double, y double, z double").withColumn("states", F.lit(2))
    sites, points = t.withColumnRenamed("id", "site"), t.drop("states").withColumnRenamed("id", "point")
    want = {}
    for s, i, *p in rows:
        near = sorted((round(math.dist(p, q), 9), j) for u, j, *q in rows if u == s and j != i and None not in q and None not in p and s and math.dist(p, q) <= 2.0)
        want |= {(s, i, j): (r, len(near)) for r, (_, j) in enumerate(near, 1)}
    for sizes in ((nb.SITES, nb.POINTS, nb.PAIRS), (7, 5, 20)):
        for name, size in zip(("SITES", "POINTS", "PAIRS"), sizes):
            monkeypatch.setattr(nb, name, size)
        got = {(r.scope, r.site, r.point): (r.rank, r.n_near) for r in nb.nearest_within(sites, points, "scope", "site", "point", 2.0, 4).collect()}
        assert got == {k: v for k, v in want.items() if v[0] <= 4}
        ledger = nb.nearest_within_budget(sites, points, "scope", "site", "point", 2.0, 3, "states", 8)
        assert "Window" not in ledger._jdf.queryExecution().executedPlan().toString()
        assert {(r.scope, r.site, r.point): (r.rank, r.selected) for r in ledger.collect()} == {k: (v[0], v[0] <= 2) for k, v in want.items()}


def test_rows_of_a_hub_are_not_joined_in_one_task(spark, monkeypatch):
    """A star of 3,000 and a path: the star's centre takes what it needs by broadcast; the same groups either way."""
    edges = spark.range(3000).select(F.lit(0).cast("long").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.range(5000, 5040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    write, labels = nb.cut, []
    monkeypatch.setattr(nb, "cut", lambda df, label="cut": labels.append(label) or write(df, label))
    for rows in (nb.HUB_ROWS, 100):
        monkeypatch.setattr(nb, "HUB_ROWS", rows)
        assert {(r.node, r.group) for r in nb.connected_groups(edges).collect()} == {(i, 0) for i in range(3001)} | {(i, 5000) for i in range(5000, 5041)}
    assert "hubs" in labels


def test_nearest_of_a_class_are_one_row(spark, monkeypatch):
    """40 leaves around 2 hubs: a node keeps its two nearest members of a class in one row."""
    edges = spark.range(40).select(F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("a"), (F.col("id") + 10).alias("b"))
    nodes = spark.range(50).where("id < 2 or id >= 10").select(F.col("id").alias("node"), F.when(F.col("id") < 10, "hub").otherwise("leaf").alias("class"))
    write, rows = nb.cut, []

    def counted(df, label="cut"):
        out = write(df, label)
        rows.append(out.count() if label == "nearest-of-class" else 0)
        return out

    monkeypatch.setattr(nb, "cut", counted)
    got = {(r.node, r["class"]): r.distance for r in nb.class_distances(edges, nodes, 3).collect()}
    want = {(n, c): d for n in (0, 1) for c, d in (("hub", 2), ("leaf", 1))} | {(n, c): d for n in range(10, 50) for c, d in (("hub", 1), ("leaf", 2))}
    assert got == want and max(rows) <= len(want)
