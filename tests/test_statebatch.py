"""Graphs of all sizes in one batch against sums over all states."""

import math
import random

import pytest

from calibrant.operators import states as st


def test_one_pass_gives_what_all_states_give(spark):
    rng = random.Random(11)
    sites = [(g, i, None if (g, i) == (3, 1) else rng.uniform(5, 9)) for g in range(40) for i in range(1 + g % 7)] + [(99, i, 1.0) for i in range(9)]
    pairs = [(g, a, b, rng.uniform(-1, 1)) for g in range(40) for a in range(1 + g % 7) for b in range(a) if rng.random() < 0.7]
    g = st.graphs(spark.createDataFrame(sites, "graph_id int, site_id int, b double"), pairs=spark.createDataFrame(pairs, "graph_id int, site_i int, site_j int, j double"), cap=128).coalesce(1)
    b, c = {(g, i): x or 0.0 for g, i, x in sites}, {}
    for k, x, y, v in pairs:
        c[k, x, y] = c[k, y, x] = v

    def shares(k, n, shift, coupled=True):
        w = [sum(b[k, i] + shift - 7.0 for i in range(n) if s >> i & 1) + coupled * sum(c.get((k, i, j), 0) for i in range(n) for j in range(i) if s >> i & s >> j & 1) for s in range(1 << n)]
        z = sum(10**x for x in w)
        return [sum(10**x for s, x in enumerate(w) if s >> i & 1) / z for i in range(n)], [10**x / z for x in w]

    got = {(r.scenario, r.graph_id, r.site_id): r.p_acid for r in st.scenario_marginals(g, 7.0, {"low": -0.5, "mid": 0.0}).collect()}
    change = {r.graph_id: r for r in st.coupling_change(g, 7.0).collect()}
    core = {r.graph_id: r for r in st.with_core(g, 7.0, 3).collect()}
    edge = st.edges(g).collect()
    assert len(got) == 2 * (len(sites) - 9) and 99 not in change and core[99].shares is None and not core[99].available
    assert len(edge) == sum((1 + k % 7) << (k % 7) for k in range(40)) and max(r.cycle_error for r in edge) < 1e-9
    for k in range(40):
        n = 1 + k % 7
        (mid, p), (free, f) = shares(k, n, 0.0), shares(k, n, 0.0, False)
        for i in range(n):
            assert got["mid", k, i] == pytest.approx(mid[i]) and got["low", k, i] == pytest.approx(shares(k, n, -0.5)[0][i])
        assert core[k].shares == pytest.approx(mid) and core[k].dominant == p.index(max(p)) and [t.p for t in core[k].top] == pytest.approx(sorted(p, reverse=True)[:3])
        assert core[k].entropy == pytest.approx(-sum(x * math.log(x) for x in p))
        assert change[k].largest == pytest.approx(max(abs(x - y) for x, y in zip(mid, free))) and change[k].dominant_free == f.index(max(f))
        assert change[k].changed == sum((x >= 0.5) != (y >= 0.5) for x, y in zip(mid, free))
