"""Neighbourhoods by class and summaries of groups of any size, against plain Python."""

import math
import random
import statistics
from collections import defaultdict

import pytest
from calibrant.operators import evidence as ev
from calibrant.operators import neighbours as nb
from calibrant.operators import ranks


def bfs(adjacent, start, k):
    hops, front = {start: 0}, [start]
    for i in range(1, k + 1):
        front = [v for u in front for v in adjacent[u] if v not in hops and not hops.update({v: i})]
    return hops


@pytest.mark.parametrize("k", [1, 2, 4])
def test_class_neighbourhoods(spark, k):
    rng = random.Random(k)
    nodes = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(-1, 2)) for i in range(150)]
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(170)] + [(7, i) for i in range(80)] + [(3, 3), (5, 6), (6, 5), (None, 1)]
    adjacent = defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            adjacent[a].add(b)
            adjacent[b].add(a)
    near, sums = {}, {}
    for i, _, _ in nodes:
        hops = bfs(adjacent, i, k)
        for j, c, q in nodes:
            if j in hops and j != i:
                n, charge = sums.get((i, c), (0, 0))
                sums[i, c] = n + 1, charge + q
                if c is not None:
                    near[i, c] = min(near.get((i, c), 99), hops[j])
    t = spark.createDataFrame(nodes, "node int, class string, charge int")
    e = spark.createDataFrame(edges, "a int, b int")
    assert {(r.node, r["class"]): r.distance for r in nb.class_distances(e, t, k).collect()} == near
    assert {(r.node, r["class"]): (r.n, r.charge) for r in nb.class_sums(e, t, k).collect()} == sums
    assert nb.class_distances(e.limit(0), t, k).count() == 0 == nb.class_sums(e, t.limit(0), k).count()


def linear(xs, q):
    xs = sorted(xs)
    at = (len(xs) - 1) * q
    return xs[math.floor(at)] * (math.ceil(at) - at) + xs[math.ceil(at)] * (at - math.floor(at)) if at % 1 else xs[int(at)]


def lightest(pairs, share):
    total, run = sum(w for _, w in pairs), 0
    for x, w in sorted(pairs):
        run += w
        if run >= share * total:
            return x


@pytest.mark.parametrize("large", [100_000, 3])
def test_groups_of_any_size(spark, monkeypatch, large):
    """The same figures whether a group is ranked in one task or over ranges."""
    monkeypatch.setattr(ranks, "LARGE", large)
    rng = random.Random(9)
    rows = [("hot" if i % 3 else f"k{i % 11}", round(rng.gauss(0, 5), 1), float(rng.randrange(-1, 6)), "gold" if i % 2 else "silver", "medium") for i in range(600)]
    rows += [("zero", float(x), 0.0, "gold", "high") for x in (1, 9)] + [("one", 4.0, None, "gold", "high"), ("null", None, 1.0, "gold", "high"), (None, 2.0, 1.0, "gold", "high"), (None, 4.0, 1.0, "gold", "high")]
    df = spark.createDataFrame(rows, "k string, x double, w double, tier string, conf string").repartition(3)
    of = defaultdict(list)
    for k, x, w, *_ in rows:
        if x is not None:
            of[k].append((x, max(w or 0.0, 0.0)))
    same = lambda a, b: a == b or abs(a - b) < 1e-9
    got = {r.k: r for r in ev.mad_sigma(df, ["k"], "x").collect()}
    for k, pairs in of.items():
        xs = [x for x, _ in pairs]
        m = statistics.median(xs)
        assert same(got[k].median, m) and same(got[k].mad, statistics.median(abs(x - m) for x in xs)) and same(got[k].range, max(xs) - min(xs))
    assert got["null"].median is None
    wm = {r.k: r.weighted_median for r in ev.weighted_median(df, ["k"], "x", "w").collect()}
    for k, pairs in of.items():
        assert same(wm[k], lightest(pairs, 0.5) if sum(w for _, w in pairs) else statistics.median(x for x, _ in pairs)), k
    wq = {r.k: r["quantile"] for r in ev.weighted_quantile(df, ["k"], "x", "w", 0.75).collect()}
    assert wq == {k: lightest([p for p in pairs if p[1]], 0.75) for k, pairs in of.items() if sum(w for _, w in pairs)}
    q = {r.k: r for r in ranks.quantiles(df, ["k"], "x", {"a": 0.1, "b": 0.5}).collect()}
    assert set(q) == set(of) and all(same(q[k].a, linear([x for x, _ in p], 0.1)) for k, p in of.items())
    whole = ranks.quantiles(df, [], "x", {"a": 0.9}).collect()
    assert len(whole) == 1 and same(whole[0].a, linear([x for p in of.values() for x, _ in p], 0.9))
    t = {r.k: r for r in ev.replicate_target(df.where("k is not null and x is not null"), "k", "x", "tier", "conf").collect()}
    assert same(t["hot"].target, statistics.median(x for x, _ in of["hot"])) and t["one"].sigma == 0 and t["hot"].tier == "silver"
    s = {r.k: r for r in ev.source_contribution(df, "k", "tier", "x").collect()}
    assert same(s["hot"].median, statistics.median(x for x, _ in of["hot"])) and s["null"].median is None and s[None].median == 3.0
