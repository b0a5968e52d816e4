"""Assignments, overlaps, matches and the ranges of state graphs against plain Python."""

import itertools
import random
from collections import Counter, defaultdict

from calibrant.functions import scalars as s
from calibrant.operators import joins as j
from calibrant.operators import metrics as m
from calibrant.operators import neighbours as nb
from calibrant.operators import review as rv
from calibrant.operators import states
from pyspark.sql import functions as F


def test_alternative_assignment(spark):
    """One group of half the rows lies over all ranges; predictions repeat; groups of one have no sibling."""
    rng = random.Random(1)
    rows = [("hot" if i % 2 else f"g{i % 40}", i, rng.choice([round(rng.uniform(0, 50), 1), 7.0]), rng.choice([round(rng.uniform(0, 50), 1), 7.0, 3.5])) for i in range(700)]
    rows += [("lone", 900, 1.0, 2.0), ("same", 901, 1.0, 2.0), ("same", 902, 1.0, 2.0), (None, 903, 1.0, 2.0), (None, 904, 1.0, 9.0), ("gap", 905, None, 1.0), ("gap", 906, 1.0, None), ("gap", 907, 1.0, 4.0)]
    of = defaultdict(list)
    for r in rows:
        if None not in r[2:]:
            of[r[0]].append(r)
    want = {}
    for g in of.values():
        for r in g:
            others = [(abs(r[2] - o[3]), o[1], o) for o in g if o is not r]
            if others:
                e, i, o = min(others)
                own = abs(r[2] - r[3])
                want[r[1]] = (r[0], i, own - e, e < own and abs(o[2] - r[3]) < abs(o[2] - o[3]))
    got = j.alternative_assignment(spark.createDataFrame(rows, "g string, i int, o double, p double"), "g", "i", "o", "p").collect()
    assert {r.i: (r.g, r.alternative, r.gain, r.swap_improves) for r in got} == want and len(got) == len(want)


def greedy(items, strong):
    kept, out = [], {}
    for i, members, core, family, score in sorted(items, key=lambda x: (-x[4], x[0])):
        against = None
        for k in kept:
            shared = set(members) & set(k[1])
            if not shared or not shared & (set(core) | set(k[2])):
                continue
            a, b = len(shared) / len(set(k[1])), len(shared) / len(set(members))
            if max(a, b) == 1 or max(a, b) >= (0.01 if k[3] == family and family is not None else 0.75) or (k[3] in strong and b >= 0.5):
                against = k[0]
                break
        out[i] = against
        if against is None:
            kept.append((i, members, core, family))
    return out


def test_overlaps_are_resolved_like_the_greedy_choice(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(40):
        items = []
        for i in range(rng.randrange(1, 14)):
            members = [rng.randrange(12) for _ in range(rng.randrange(0, 6))]
            items.append((i, members, [x for x in members if rng.random() < 0.7], rng.choice(["a", "b", "c", None]), rng.randrange(4)))
        rows += [(g, *x) for x in items]
        want |= {(g, i): w for i, w in greedy(items, ("b",)).items()}
    df = spark.createDataFrame(rows, "g int, i int, m array<int>, c array<int>, f string, score int")
    conflicts = j.overlap_conflicts(df, "g", "i", "m", ["score"], family="f", core="c", strong=("b",))
    got = j.independent_items(df, conflicts, "g", "i").collect()
    assert {(r.g, r.i): r.overlap_with for r in got} == want and all(r.kept == (r.overlap_with is None) for r in got)
    chain = spark.createDataFrame([(0, i, [i, i + 1], 100 - i) for i in range(25)], "g int, i int, m array<int>, score int")
    kept = j.independent_items(chain, j.overlap_conflicts(chain, "g", "i", "m", ["score"], least=0.5), "g", "i").where("kept").collect()
    assert sorted(r.i for r in kept) == list(range(0, 25, 2))
    lone = chain.where("i % 5 = 0")
    assert j.independent_items(lone, j.overlap_conflicts(lone, "g", "i", "m", ["score"]), "g", "i").where("kept and overlap_with is null").count() == 5


def test_set_match_reads_the_match_back(spark):
    rng = random.Random(3)
    rows = [(k, [rng.choice([round(rng.uniform(0, 9), 1), 4.0]) for _ in range(rng.randrange(0, 5))], [(round(rng.uniform(0, 9), 1), f"s{i}") for i in range(rng.randrange(0, 7))]) for k in range(120)]
    rows += [(200, [1.0, 1.0000000001, None], [(None, "x"), (2.0, "y")]), (201, None, [(1.0, "a")]), (202, [1.0], None)]
    got = defaultdict(list)
    df = spark.createDataFrame(rows, "k int, o array<double>, l array<struct<value:double,step:string>>")
    for r in m.set_match(df, "k", "o", "l").collect():
        got[r.k].append(r)
    for k, o, ladder in rows[:120]:
        o, ladder = sorted(set(o)), sorted(ladder)
        if len(o) > len(ladder):
            assert [(r.status, r.step) for r in got[k]] == [("set_larger_than_ladder", None)]
            continue
        assert sorted(r.observed for r in got[k]) == o and len({r.step for r in got[k]}) == len(o)
        assert all((r.predicted, r.step) in ladder for r in got[k])
        best = min((sum(abs(a - b[0]) for a, b in zip(o, c)) for c in itertools.combinations(ladder, len(o))), default=0)
        assert abs(sum(abs(r.observed - r.predicted) for r in got[k]) - best) < 1e-9
    assert [(r.observed, r.step) for r in got[200]] == [(1.0, "y")] and 201 not in got and got[202][0].status == "set_larger_than_ladder"


def test_large_graphs_are_unavailable(spark):
    """12 sites have states; 13, 63, 64, 70 and 5000 are unavailable and take nothing with them."""
    sizes = {1: 12, 2: 13, 3: 63, 4: 64, 5: 70, 6: 5000}
    sites = spark.createDataFrame([(g, i, 1.0 + i % 3) for g, n in sizes.items() for i in range(n)], "graph_id int, site_id int, b double")
    pairs = spark.createDataFrame([(g, 0, 1, -0.5) for g in sizes] + [(6, i, i + 1, 0.25) for i in range(1, 4000)], "graph_id int, site_i int, site_j int, j double")
    for g in (states.graphs(sites, coupling=lambda a, b: a["b"] * 0), states.graphs(sites, pairs=pairs)):
        got = {r.graph_id: r for r in states.with_populations(states.with_states(g), 7.4).collect()}
        assert [got[g].available for g in sizes] == [True] + [False] * 5
        assert [got[g].n_states for g in sizes] == [4096, 8192, None, None, None, None]
        assert len(got[1].sites) == 12 and abs(sum(got[1].p) - 1) < 1e-9 and got[5].sites == [] and got[6].p is None and got[6].n_sites == 5000


def test_site_ranges_are_the_extremes_over_all_backgrounds(spark):
    rng = random.Random(4)
    sites = [(g, i, rng.uniform(2, 9)) for g in range(4) for i in range(6)] + [(9, i, 5.0) for i in range(300)]
    pairs = [(g, a, b, rng.uniform(-1, 1)) for g in range(4) for a in range(6) for b in range(a) if rng.random() < 0.7] + [(9, 0, i, -0.1) for i in range(1, 300)] + [(0, 3, 3, 5.0), (0, 3, 99, 5.0), (8, 1, 2, 1.0)]
    t = spark.createDataFrame(sites, "graph_id int, site_id int, b double")
    p = spark.createDataFrame(pairs, "graph_id int, site_i int, site_j int, j double")
    got = {(r.graph_id, r.site_id): r for r in states.site_ranges(t, p).collect()}
    assert len(got) == len(sites) and abs(got[9, 0].low - (5 - 29.9)) < 1e-9 and got[9, 0].high == 5
    g = states.with_populations(states.with_states(states.graphs(t, pairs=p)), 6.0)
    edge = states.edges(g).groupBy("graph_id", "site_id").agg(F.min("value").alias("low"), F.max("value").alias("high")).collect()
    assert len(edge) == 24
    for r in edge:
        assert abs(r.low - got[r.graph_id, r.site_id].low) < 1e-9 and abs(r.high - got[r.graph_id, r.site_id].high) < 1e-9
    top = {r.graph_id: r.dominant for r in g.where("available").collect()}
    of = {(g, min(a, b), max(a, b)): v for g, a, b, v in pairs}
    for r in states.at_dominant(g).collect():
        others = sum(of.get((r.graph_id, min(r.site_id, k), max(r.site_id, k)), 0) for k in range(6) if k != r.site_id and top[r.graph_id] >> k & 1)
        assert abs(r.value - next(b for g, i, b in sites if (g, i) == (r.graph_id, r.site_id)) - others) < 1e-9


def test_expanded_states_stop_at_the_cap(spark):
    df = spark.createDataFrame([(1, [2] * 70), (2, [2, 3]), (3, [2] * 5000), (4, []), (5, [2] * 40 + [0])], "k int, l array<int>")
    got = Counter((r.k, r.truncated) for r in rv.expand_states(df, "k", "l", cap=10).collect())
    assert got == {(1, True): 1, (2, False): 6, (3, True): 1, (4, False): 1, (5, False): 1}


def test_reference_keys_keep_a_plus(spark):
    cases = {"10.1000/a+b": "10.1000/a+b", "10.1000/a%2Bb": "10.1000/a+b", "https://pubmed.ncbi.nlm.nih.gov/123/": "pmid:123", "pubmed:77": "pmid:77", "PMID: 5": "pmid:5", "a + b/": "a + b", "100%": "100%", None: ""}
    t = spark.createDataFrame([(k, v) for k, v in cases.items()], "x string, want string")
    assert t.select(s.reference_key("x").alias("got"), "want").where("got <> want or got is null").collect() == []
    assert spark.createDataFrame([("+12.0",), ("12A",), ("-3.00",)], "x string").select(s.integral_id("x").alias("y")).collect() == [("+12",), ("12A",), ("-3",)]


def test_best_matches_are_exact(spark):
    """Every level has winners; one item is in half of all sets; copies tie; empty sets and lone items match nothing."""
    rng = random.Random(5)
    base = [rng.sample(range(1, 60), 8) for _ in range(12)]
    rows = []
    for i in range(220):
        x = rng.choice(base)[: rng.randrange(1, 9)] + rng.sample(range(1, 200), rng.randrange(0, 5)) + ([0] if i % 2 else [])
        rows.append((i, "a" if i % 3 else "b", x + x[:1]))
    rows += [(300, "a", []), (301, "a", None), (302, "a", [999]), (303, "c", [0, 1]), (304, "a", rows[4][2]), (305, "a", [0])]
    df = spark.createDataFrame(rows, "i int, s string, m array<int>")

    def brute(queries, candidates, scoped):
        out = {}
        for q in queries:
            sims = [(round(len(set(q[2]) & set(c[2])) / len(set(q[2]) | set(c[2])), 9), c[0]) for c in candidates if c[0] != q[0] and q[2] and c[2] and (not scoped or c[1] == q[1]) and set(q[2]) & set(c[2])]
            if sims:
                top = max(s for s, _ in sims)
                out[q[0]] = (top, sum(s == top for s, _ in sims), min(c for s, c in sims if s == top))
        return out

    got = {r.i: (r.jaccard, r.n_best, r.match) for r in nb.best_matches(df, df, "i", "m", same_table=True).collect()}
    assert got == brute(rows, rows, False)
    asks, train = df.where("i % 5 = 0"), df.where("i % 5 <> 0")
    parts = [[r for r in rows if (r[0] % 5 == 0) == want] for want in (True, False)]
    got = {r.i: (r.jaccard, r.n_best, r.match) for r in nb.best_matches(asks, train, "i", "m", scope="s", levels=(0.9, 0.5, 0.0)).collect()}
    assert got == brute(*parts, True)
    best = {r.i: (r.cand, r.status) for r in j.best_overlap(df, df.withColumnRenamed("i", "cand"), "i", "cand", "m", same_table=True).collect()}
    assert best == {i: (c if n == 1 else None, "unique" if n == 1 else "ambiguous") for i, (_, n, c) in brute(rows, rows, False).items()}
    assert nb.best_matches(df.limit(0), df, "i", "m").count() == 0
