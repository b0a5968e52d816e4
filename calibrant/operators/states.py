"""Populations over small state graphs.

A graph (one entity with a few two-level sites) is one row: its sites' one-body terms and its pair couplings are
arrays. States are expanded, weighted and normalised in Arrow tasks over rows of graphs (:mod:`statebatch`), so a graph costs one
shuffle (the one that gathers its sites) whatever is asked of it, and rows are multiplied only at the end. What takes the rows of
:func:`graphs` makes the states in the same pass; only :func:`with_states` and :func:`with_populations` write them into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from calibrant.operators import statebatch

CAP = 4096


def let(value: Column, use) -> Column:
    """``use(v)`` with ``value`` computed once: the optimiser may otherwise repeat it for each element of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def log10_sum(xs: Column) -> Column:
    """log10 of the sum of 10^x over an array, without overflow; null for none."""
    total = lambda v: F.aggregate(v["x"], F.lit(0.0), lambda s, x: s + F.pow(F.lit(10.0), x - v["top"]))
    summed = lambda a: let(F.struct(a.alias("x"), F.array_max(a).alias("top")), lambda v: F.when(F.size(v["x"]) > 0, v["top"] + F.log10(total(v))))
    return let(xs, summed)


def log10_sum_by(df: DataFrame, x: str, *keys: str) -> DataFrame:
    """D32 over groups: keys, log10_sum. Two partial aggregates; no group is gathered."""
    top = df.groupBy(*keys).agg(F.max(x).alias("_top"))
    return df.join(top, list(keys)).groupBy(*keys).agg((F.first("_top") + F.log10(F.sum(F.pow(F.lit(10.0), F.col(x) - F.col("_top"))))).alias("log10_sum"))


def graphs(sites: DataFrame, coupling=None, pairs: DataFrame | None = None, cap: int = CAP) -> DataFrame:
    """One row per graph: graph_id, sites (array of site_id, b and what else ``sites`` has, by site_id), pairs
    (array of i, j, v with i < j by place), n_sites, n_states (null from 2^63 on), available.

    ``sites`` has graph_id, site_id, b; couplings come from ``coupling(site_i, site_j)`` (a function of two
    site structs) or the table ``pairs`` (graph_id, site_i, site_j, j; either order; of repeated pairs the
    last by value). A graph whose 2^n states exceed ``cap`` is unavailable, never cut: sites are counted before any is gathered,
    and such a graph has no sites and pairs in its row. Null b counts as 0.
    """
    fits = cap.bit_length() - 1  # the most sites of an available graph
    extra = [c for c in sites.columns if c not in ("graph_id", "site_id", "b")]
    told = F.struct("site_id", F.coalesce(F.col("b"), F.lit(0.0)).alias("b"), *extra)
    sized = sites.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("graph_id")))
    g = sized.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.when(F.col("_n") <= fits, told))).alias("sites"), F.max("_n").alias("n_sites"))
    idx = F.when(F.size("sites") > 0, F.sequence(F.lit(0), F.size("sites") - 1)).otherwise(F.array().cast("array<int>"))
    if pairs is not None:
        small = g.where(F.col("n_sites") <= fits).select("graph_id")
        p = pairs.join(small, "graph_id", "left_semi").select("graph_id", F.least("site_i", "site_j").alias("a"), F.greatest("site_i", "site_j").alias("z"), "j")
        p = p.groupBy("graph_id", "a", "z").agg(F.max("j").alias("v")).groupBy("graph_id").agg(F.collect_list(F.struct("a", "z", "v")).alias("p"))
        g = g.join(p, "graph_id", "left")
        ids = F.transform("sites", lambda s: s["site_id"])
        placed = F.transform(F.coalesce("p", F.array().cast(p.schema["p"].dataType)), lambda x: F.struct((F.array_position(ids, x["a"]) - 1).cast("int").alias("i"), (F.array_position(ids, x["z"]) - 1).cast("int").alias("j"), x["v"].alias("v")))
        g = g.withColumn("pairs", F.array_sort(F.filter(placed, lambda x: (x["i"] >= 0) & (x["j"] > x["i"])))).drop("p")
    elif coupling is not None:
        at = lambda k: F.get(F.col("sites"), k)
        every = F.flatten(F.transform(idx, lambda i: F.transform(F.filter(idx, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j"), coupling(at(i), at(j)).alias("v")))))
        g = g.withColumn("pairs", every)
    else:
        g = g.withColumn("pairs", F.array().cast("array<struct<i:int,j:int,v:double>>"))
    states = F.when(F.col("n_sites") < 63, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n_sites").cast("int")))
    g = g.withColumn("n_states", states).withColumn("available", F.col("n_sites") <= fits)
    return g.select("graph_id", "sites", "pairs", "n_sites", "n_states", "available")


def site_ranges(sites: DataFrame, pairs: DataFrame) -> DataFrame:
    """graph_id, site_id, low, high, spread: the least and largest value that a transition of the site has over all
    backgrounds of the other sites, b plus its couplings' negative or positive parts. Closed form: no states, so that graphs of any
    size have it. ``sites``: graph_id, site_id, b; ``pairs``: graph_id, site_i, site_j, j (of repeated ones the largest j, as in
    :func:`graphs`; with itself or with unknown sites: none)."""
    one = pairs.where("site_i <> site_j").select("graph_id", F.least("site_i", "site_j").alias("a"), F.greatest("site_i", "site_j").alias("z"), "j").groupBy("graph_id", "a", "z").agg(F.max("j").alias("j"))
    known = sites.select("graph_id", "site_id")
    for end in ("a", "z"):
        one = one.join(known.withColumnRenamed("site_id", end), ["graph_id", end], "left_semi")
    ends = one.select("graph_id", F.explode(F.array("a", "z")).alias("site_id"), "j")
    sums = ends.groupBy("graph_id", "site_id").agg(F.sum(F.least("j", F.lit(0.0))).alias("_low"), F.sum(F.greatest("j", F.lit(0.0))).alias("_high"))
    b = F.coalesce(F.col("b"), F.lit(0.0))
    low, high = b + F.coalesce("_low", F.lit(0.0)), b + F.coalesce("_high", F.lit(0.0))
    return sites.join(sums, ["graph_id", "site_id"], "left").select("graph_id", "site_id", low.alias("low"), high.alias("high"), (high - low).alias("spread"))


def at_dominant(g: DataFrame) -> DataFrame:
    """graph_id, site_id, value: the site's transition with every other site as in the dominant state; of
    :func:`with_populations`, available graphs only."""
    couplings = lambda i: F.filter("pairs", lambda p: (p["i"] == i) | (p["j"] == i))
    value = lambda s, i: F.aggregate(couplings(i), s["b"], lambda t, p: t + _bit(F.col("dominant"), p["i"] + p["j"] - i) * p["v"])
    each = F.transform("sites", lambda s, i: F.struct(s["site_id"].alias("site_id"), value(s, i).alias("value")))
    return g.where("available").select("graph_id", F.explode(each).alias("e")).select("graph_id", "e.*")


def _bit(state: Column, i: Column) -> Column:
    """Whether site ``i`` is on the acid side in ``state``."""
    return F.call_function("shiftright", state, i).bitwiseAND(1)


def _pass(g: DataFrame, make, columns: str, level: float | Column | None = None, keep: bool = False, **more) -> DataFrame:
    """One Arrow pass over graphs: ``columns`` (DDL) as ``make`` gives them, with ``keep`` after those of ``g``."""
    made = T.StructType.fromDDL(columns)
    schema = T.StructType([f for f in g.schema if f.name not in made.names] + list(made)) if keep else made
    asked = g.withColumn("_level", level.cast("double")) if isinstance(level, Column) else g
    return asked.mapInArrow(statebatch.task(make, to_arrow_schema(schema), None if isinstance(level, Column) else level, keep, **more), schema)


def _type(g: DataFrame, name: str) -> str:
    return (g.schema["sites"].dataType.elementType if name == "site_id" else g.schema)[name].dataType.simpleString()


def with_states(g: DataFrame) -> DataFrame:
    """Adds states, an array of state, n (sites on the acid side), weight (log10); null if unavailable."""
    return _pass(g, statebatch.with_states, "states array<struct<state:int,n:int,weight:double>>", keep=True)


_SUMMARY = "log10z double, entropy double, effective double, dominant int, second double, gap double"


def with_populations(g: DataFrame, level: float | Column) -> DataFrame:
    """Adds p, the states' populations at ``level`` (base-10 softmax of weight - n * level), log10z, entropy,
    effective (states), dominant (state; of populations equal to 9 places the smaller), second, gap. Weights are those of the
    graph's states where it has them."""
    return _pass(g, statebatch.summary, f"p array<double>, {_SUMMARY}", level, keep=True)


def with_summary(g: DataFrame, level: float | Column) -> DataFrame:
    """As :func:`with_populations`, without the array p."""
    return _pass(g, statebatch.summary, _SUMMARY, level, keep=True)


def with_core(g: DataFrame, level: float | Column, top: int) -> DataFrame:
    """As :func:`with_summary`, with shares (of the acid side by site) and top (the first ``top`` states by population to 9
    places, ties by state: state, p)."""
    return _pass(g, statebatch.core, f"{_SUMMARY}, shares array<double>, top array<struct<state:int,p:double>>", level, keep=True, top=top)


def state_rows(g: DataFrame, level: float | Column | None = None) -> DataFrame:
    """One row per state: graph_id, state, n, weight, population; of :func:`with_populations`, or of :func:`graphs` at ``level``."""
    if level is not None:
        return _pass(g, statebatch.state_rows, f"graph_id {_type(g, 'graph_id')}, state int, n int, weight double, population double", level)
    z = g.where("available").select("graph_id", F.explode(F.arrays_zip("states", "p")).alias("z"))
    return z.select("graph_id", "z.states.state", "z.states.n", "z.states.weight", F.col("z.p").alias("population"))


def shared_populations(rows: DataFrame, graph: str, configuration: str, level: float) -> DataFrame:
    """``rows`` (drawings of configurations, with weight and n) with population, share and duplicates: a configuration has one
    place in the sum however often it is drawn, and its drawings share its population equally. Drawings of one configuration that
    differ in weight or n are two configurations."""
    on = [graph, configuration, "weight", "n"]
    one = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("duplicates")).withColumn("_e", F.col("weight") - F.col("n") * level)
    z = log10_sum_by(one, "_e", graph).withColumnRenamed("log10_sum", "_z")
    population = one.join(z, graph).select(*on, "duplicates", F.pow(F.lit(10.0), F.col("_e") - F.col("_z")).alias("population"))
    return rows.join(population, on).withColumn("share", F.col("population") / F.col("duplicates"))


def coupled_and_free(g: DataFrame, free: DataFrame) -> DataFrame:
    """graph_id, dominant, dominant_free, dominant_changed, changed (sites whose side changes without couplings) and largest (the largest
    change of a site's share) for graphs with populations with and without couplings; unavailable ones are left out."""
    share = lambda r: F.transform(F.col(f"{r}.sites"), lambda s, i: F.aggregate(F.arrays_zip(F.col(f"{r}.states"), F.col(f"{r}.p")), F.lit(0.0), lambda t, z: t + z["p"] * _bit(z["states"]["state"], i)))
    of = lambda df, name: df.where("available").select("graph_id", F.struct("sites", "states", "p", "dominant").alias(name))
    t = of(g, "a").join(of(free, "f"), "graph_id").select("graph_id", F.col("a.dominant").alias("dominant"), F.col("f.dominant").alias("dominant_free"), F.zip_with(share("a"), share("f"), lambda x, y: F.struct(x.alias("x"), y.alias("y"))).alias("_z"))
    flips = F.size(F.filter("_z", lambda z: (F.round(z["x"], 9) >= 0.5) != (F.round(z["y"], 9) >= 0.5)))
    return t.select("graph_id", "dominant", "dominant_free", (F.col("dominant") != F.col("dominant_free")).alias("dominant_changed"), flips.alias("changed"), F.array_max(F.transform("_z", lambda z: F.abs(z["x"] - z["y"]))).alias("largest"))


def coupling_change(g: DataFrame, level: float | Column) -> DataFrame:
    """The columns of :func:`coupled_and_free` from graphs alone, both in one pass."""
    return _pass(g, statebatch.coupled_and_free, f"graph_id {_type(g, 'graph_id')}, dominant int, dominant_free int, dominant_changed boolean, changed int, largest double", level)


def scenario_marginals(g: DataFrame, level: float | Column, shifts: dict[str, float]) -> DataFrame:
    """Scenario, graph_id, site_id, p_acid: marginals of graphs with all terms shifted, every scenario in one pass."""
    return _pass(g, statebatch.marginals, f"scenario string, graph_id {_type(g, 'graph_id')}, site_id {_type(g, 'site_id')}, p_acid double", level, shifts=shifts)


def marginals(g: DataFrame, level: float | Column | None = None) -> DataFrame:
    """graph_id, site_id, p_acid: share of the states with the site on the acid side; of :func:`with_populations`, or of
    :func:`graphs` at ``level``."""
    if level is not None:
        return scenario_marginals(g, level, {"": 0.0}).drop("scenario")
    share = lambda zs, i: F.aggregate(zs, F.lit(0.0), lambda t, z: t + z["p"] * _bit(z["states"]["state"], i))
    each = let(F.arrays_zip("states", "p"), lambda zs: F.transform("sites", lambda s, i: F.struct(s["site_id"].alias("site_id"), share(zs, i).alias("p_acid"))))
    return g.where("available").select("graph_id", F.explode(each).alias("m")).select("graph_id", "m.*")


def ladder(g: DataFrame) -> DataFrame:
    """graph_id, step (sites on the acid side), value: difference of neighbouring log10 partition sums."""
    return _pass(g, statebatch.ladder, f"graph_id {_type(g, 'graph_id')}, step int, value double")


def edges(g: DataFrame) -> DataFrame:
    """Every one-unit transition: graph_id, site_id, base_state, acid_state, value (b and the couplings
    to the sites occupied besides), cycle_error (against the difference of the states' weights)."""
    return _pass(g, statebatch.edges, f"graph_id {_type(g, 'graph_id')}, site_id {_type(g, 'site_id')}, base_state int, acid_state int, value double, cycle_error double")


def layer_sums(bs: Column) -> Column:
    """log10 partition sums of 0, 1, ... sites on the acid side, for terms ``bs`` without couplings: elementary symmetric
    sums as a fold, kept as logarithms; no states are expanded."""
    low = F.lit(-1e300)

    def grow(coefs: Column, b: Column) -> Column:
        longer = F.concat(coefs, F.array(low))
        return F.transform(longer, lambda c, k: F.when(k == 0, c).otherwise(log10_sum(F.array(c, F.get(coefs, k - 1) + b))))

    return F.aggregate(bs, F.array(F.lit(0.0)), grow)


def independent_ladder(sites: DataFrame) -> DataFrame:
    """Ladder of sites that don't interact."""
    rows = sites.groupBy("graph_id").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    steps = let(layer_sums(F.col("bs")), lambda c: F.transform(F.sequence(F.lit(1), F.size("bs")), lambda k: F.get(c, k) - F.get(c, k - 1)))
    return rows.select("graph_id", F.posexplode(steps).alias("step", "value")).select("graph_id", (F.col("step") + 1).alias("step"), "value")


def coupling_scan(targets: DataFrame, low: float = -4.0, high: float = 4.0, steps: int = 81, ridge: float = 0.25) -> DataFrame:
    """graph_id, coupling, loss: the shared pair coupling J on a grid whose ladder is nearest to the graph's target
    ladder, by squared error plus ridge times J^2 (rounded to 6 places; ties: the weaker J, then the lower).

    ``targets``: graph_id, b (terms), target (ladder values for 1, 2, ... sites). The n-th layer's sum is the one without
    couplings plus J n (n - 1) / 2, so that the layers are summed once for the whole grid and any number of sites fits. ``graph_id`` is unique.
    """
    width = (high - low) / (steps - 1)
    grid = F.array(*[F.lit(round(low + k * width, 9)) for k in range(steps)])

    def at(layers: Column, j: Column) -> Column:
        z = F.transform(layers, lambda v, n: v + j * n * (n - 1) / 2)
        err = let(z, lambda v: F.aggregate(F.transform("target", lambda t, i: F.pow(F.get(v, i + 1) - F.get(v, i) - t, 2)), F.lit(0.0), lambda s, x: s + x))
        return F.struct(F.round(err + ridge * j * j, 6).alias("loss"), F.abs(j).alias("size"), j.alias("j"))

    # The grid stays in the graph's row: nothing is exploded, sorted or shuffled.
    best = targets.select("graph_id", let(layer_sums(F.sort_array("b")), lambda layers: F.array_min(F.transform(grid, lambda j: at(layers, j)))).alias("_b"))
    return best.select("graph_id", F.col("_b.j").alias("coupling"), F.col("_b.loss").alias("loss"))


def order_violation(rows: DataFrame, group: str, step: str, value: str) -> DataFrame:
    """Group, violated: does a later step exceed the one before?"""
    w = Window.partitionBy(group).orderBy(step)
    return rows.select(group, (F.col(value) > F.lag(value).over(w)).alias("up")).groupBy(group).agg(F.coalesce(F.max("up"), F.lit(False)).alias("violated"))


def monotone_fit(xs: Column) -> Column:
    """E8 for one array: the least-squares non-increasing fit, by pooling neighbours that rise.

    Fold with a stack of blocks (total, count); a new value joins the block before while the means rise.
    """
    block = "array<struct<t:double,n:int>>"

    def push(stack: Column, x: Column) -> Column:
        # Fold the new block leftwards: struct(kept blocks, current block, still pooling).
        start = F.struct(F.array().cast(block).alias("left"), x.cast("double").alias("t"), F.lit(1).alias("n"), F.lit(True).alias("on"))
        done = F.aggregate(
            F.reverse(stack), start,
            lambda s, b: F.when(s["on"] & (b["t"] / b["n"] < s["t"] / s["n"]), F.struct(s["left"].alias("left"), (s["t"] + b["t"]).alias("t"), (s["n"] + b["n"]).alias("n"), F.lit(True).alias("on")))
            .otherwise(F.struct(F.concat(F.array(F.struct(b["t"].alias("t"), b["n"].alias("n"))), s["left"]).alias("left"), s["t"].alias("t"), s["n"].alias("n"), F.lit(False).alias("on"))),
        )
        return let(done, lambda d: F.concat(d["left"], F.array(F.struct(d["t"].alias("t"), d["n"].alias("n")))))

    blocks = F.aggregate(xs, F.array().cast(block), push)
    return F.flatten(F.transform(blocks, lambda b: F.array_repeat(b["t"] / b["n"], b["n"])))


def monotone_projection(rows: DataFrame, group: str, step: str, value: str) -> DataFrame:
    """Group, step, value, fitted: one row per row, one shuffle by group (a group fits in a row)."""
    g = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(step).alias("s"), F.col(value).cast("double").alias("v")))).alias("r"))
    g = g.withColumn("f", monotone_fit(F.transform("r", lambda x: x["v"])))
    return g.select(group, F.explode(F.arrays_zip("r", "f")).alias("z")).select(group, F.col("z.r.s").alias(step), F.col("z.r.v").alias(value), F.col("z.f").alias("fitted"))


def projection_with_fixed(rows: DataFrame, group: str, step: str, value: str, fixed: str) -> DataFrame:
    """Only runs of adjustable steps are projected, then clipped to the fixed values beside them."""
    w = Window.partitionBy(group).orderBy(step)
    tagged = rows.withColumn("_block", F.sum(F.when(F.col(fixed) | F.coalesce(F.lag(fixed).over(w), F.lit(False)), 1).otherwise(0)).over(w))
    bounds = tagged.withColumn("_hi", F.last(F.when(F.col(fixed), F.col(value)), True).over(w)).withColumn("_lo", F.first(F.when(F.col(fixed), F.col(value)), True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    runs = bounds.groupBy(group, "_block").agg(F.sort_array(F.collect_list(F.struct(F.col(step).alias("s"), F.col(value).cast("double").alias("v"), F.col(fixed).alias("fx"), F.col("_lo").cast("double").alias("lo"), F.col("_hi").cast("double").alias("hi")))).alias("r"))
    runs = runs.withColumn("f", monotone_fit(F.transform("r", lambda x: x["v"])))
    fit = F.when(F.col("z.r.fx"), F.col("z.r.v")).otherwise(F.greatest(F.coalesce("z.r.lo", F.lit(float("-inf"))), F.least(F.coalesce("z.r.hi", F.lit(float("inf"))), F.col("z.f"))))
    return runs.select(group, F.explode(F.arrays_zip("r", "f")).alias("z")).select(group, F.col("z.r.s").alias(step), F.col("z.r.v").alias(value), F.col("z.r.fx").alias(fixed), fit.alias("fitted"))


def softmax_rank(rows: DataFrame, group: str, score: str, item: str, temperature: float = 5.0, cap: int = 16, population: str | None = None) -> DataFrame:
    """Group, item, rank, share, tied, n_items, truncated, effective: the first ``cap`` by score (ties by item),
    softmax at ``temperature``; the rank filter lets Spark drop rows before the sort ends. With ``population``, that of the group's configuration
    (a column alike in its rows), also complete: the share times it, 0 where it is null."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), item)
    every = Window.partitionBy(group)
    top = rows.withColumn("rank", F.row_number().over(w)).withColumn("n_items", F.count(F.lit(1)).over(every)).where(F.col("rank") <= cap)
    raw = top.withColumn("_e", F.exp((F.col(score) - F.max(score).over(every)) / temperature))
    share = raw.withColumn("share", F.col("_e") / F.sum("_e").over(every))
    entropy = -F.sum(F.when(F.col("share") > 0, F.col("share") * F.ln("share")).otherwise(0.0)).over(every)
    tied = F.count(F.lit(1)).over(Window.partitionBy(group, score)) > 1
    complete = [] if population is None else [(F.col("share") * F.coalesce(population, F.lit(0.0))).alias("complete")]
    return share.select(group, item, score, "rank", "share", *complete, tied.alias("tied"), "n_items", (F.col("n_items") > cap).alias("truncated"), F.exp(entropy).alias("effective"))
