"""Joins with stated cardinality, and joins that equality alone can't express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from calibrant.operators.neighbours import best_matches
from calibrant.sources.tables import cut, drop_files


class NotUnique(ValueError):
    """The right side of a many-to-one join repeats a key."""


class GateFailed(ValueError):
    """A fail-closed check found rows that break it."""


#: Rows of a group that are compared in one row.
SMALL_GROUP = 64


def require_unique(df: DataFrame, on: list[str], what: str = "right side") -> None:
    bad = df.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()
    if bad:
        raise NotUnique(f"{what} repeats keys such as {[tuple(r)[:-1] for r in bad]}")


def join_many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Fails before any output where ``right`` would multiply rows."""
    require_unique(right, on)
    return left.join(right, on, how)


def join_one_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The left rows with ``available``: whether the right has the key. Both sides are unique."""
    require_unique(left, on, "left side")
    require_unique(right, on)
    return left.join(right.withColumn("available", F.lit(True)), on, "left").withColumn("available", F.coalesce("available", F.lit(False)))


def composite_match(facts: DataFrame, a: DataFrame, b: DataFrame, on: list[str], x: str, y: str) -> DataFrame:
    """C4: facts with the sorted sets of ``x`` from ``a`` and ``y`` from ``b``; status tells what is missing."""
    ga = a.groupBy(*on).agg(F.sort_array(F.collect_set(x)).alias("xs"))
    gb = b.groupBy(*on).agg(F.sort_array(F.collect_set(y)).alias("ys"))
    j = facts.join(ga, on, "left").join(gb, on, "left")
    none = F.col("xs").isNull(), F.col("ys").isNull()
    return j.withColumn("status", F.when(none[0] & none[1], "unmatched").when(none[0], "no_first").when(none[1], "no_second").otherwise("matched"))


def exclude_known(new: DataFrame, existing: DataFrame, on: list[str], own: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows not known yet, ledger of overlaps). Existing rows for which ``own`` holds don't count."""
    seen = (existing if own is None else existing.where(~own)).select(*on).distinct()
    return new.join(seen, on, "left_anti"), new.join(seen, on, "left_semi")


def overlap_ledger(evaluation: DataFrame, tests: dict[str, tuple[Column, DataFrame]]) -> DataFrame:
    """A flag per test (whether the key expression occurs in that one-column table), reasons, eligible. Null keys
    never overlap."""
    for name, (key, known) in tests.items():
        k = known.select(F.col(known.columns[0]).alias(f"_k_{name}")).where(F.col(f"_k_{name}").isNotNull()).distinct()
        evaluation = evaluation.withColumn("_key", key).join(k, F.col("_key") == F.col(f"_k_{name}"), "left").withColumn(name, F.col(f"_k_{name}").isNotNull()).drop("_key", f"_k_{name}")
    reasons = F.concat_ws(";", *[F.when(F.col(n), n) for n in tests])
    return evaluation.withColumn("reasons", reasons).withColumn("eligible", reasons == "")


def hierarchical_lookup(df: DataFrame, priors: DataFrame, label: str, family: str, value: str, uncertainty: str, spread: float = 2.0) -> DataFrame:
    """Prior by label, else by family where its entries agree within ``spread`` (mean value, largest
    uncertainty), else the median of all. Adds prior, prior_uncertainty, prior_level. The prior table is aggregated; its
    size is the number of labels."""
    by_l = priors.groupBy(F.col(label).alias("_l")).agg(F.max(F.struct(value, uncertainty)).alias("_p"))
    by_f = priors.groupBy(F.col(family).alias("_f")).agg(F.avg(value).alias("_fv"), F.max(uncertainty).alias("_fu"), (F.max(value) - F.min(value)).alias("_s")).where(F.col("_s") <= spread)
    every = priors.agg(F.median(value).alias("_gv"), F.max(uncertainty).alias("_gu"))
    j = df.join(by_l, F.col(label) == F.col("_l"), "left").join(by_f, F.col(family) == F.col("_f"), "left").crossJoin(F.broadcast(every))
    pick = lambda a, b, c: F.coalesce(F.col(a), F.col(b), F.col(c))
    level = F.when(F.col("_p").isNotNull(), "label").when(F.col("_fv").isNotNull(), "family").otherwise("global")
    out = j.withColumn("prior", pick(f"_p.{value}", "_fv", "_gv")).withColumn("prior_uncertainty", pick(f"_p.{uncertainty}", "_fu", "_gu")).withColumn("prior_level", level)
    return out.select(*df.columns, "prior", "prior_uncertainty", "prior_level")


def holdout_safe_union(train: DataFrame, extra: DataFrame, held: DataFrame, group: str) -> DataFrame:
    """C14: ``train`` and the extra rows whose group is not held out."""
    return train.unionByName(extra.join(held.select(group).distinct(), group, "left_anti"), allowMissingColumns=True)


def best_overlap(items: DataFrame, candidates: DataFrame, item: str, candidate: str, ids: str, same_table: bool = False) -> DataFrame:
    """Item, candidate (null when ambiguous), jaccard, status: best Jaccard overlap of id sets, for items that share an
    id with a candidate; of one table (``same_table``) no row meets itself. See :func:`neighbours.best_matches`."""
    best = best_matches(items, candidates.withColumnRenamed(candidate, item), item, ids, same_table=same_table)
    return best.select(item, F.when(F.col("n_best") == 1, F.col("match")).alias(candidate), "jaccard", F.when(F.col("n_best") == 1, "unique").otherwise("ambiguous").alias("status"))


def overlap_resolve(df: DataFrame, group: str, score: str, item: str, start: str, end: str) -> DataFrame:
    """C20: intervals kept greedily by score (ties by item): one is dropped when it overlaps a better kept one. A fold
    over the ranked array of a record, which is small by nature."""
    g = df.groupBy(group).agg(F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("o"), F.col(item).alias("i"), F.col(start).alias("a"), F.col(end).alias("z")))).alias("r"))
    none = F.array().cast(g.schema["r"].dataType)
    kept = F.aggregate("r", none, lambda k, x: F.when(F.exists(k, lambda y: (y["a"] < x["z"]) & (x["a"] < y["z"])), k).otherwise(F.array_append(k, x)))
    return g.select(group, F.explode(kept).alias("k")).select(group, F.col("k.i").alias(item), F.col("k.a").alias(start), F.col("k.z").alias(end))


def overlap_conflicts(items: DataFrame, group: str, item: str, members: str, order: list[str], family: str | None = None, core: str | None = None, strong: tuple = (), least: float = 0.75, least_alike: float = 0.01, least_strong: float = 0.5) -> DataFrame:
    """C20: group, better, worse, rank (of the better): pairs of items of a group that can't both stay. The better one has the larger ``order``
    columns, of equal ones the smaller item.

    Items conflict when one's ``members`` (an array) are all the other's; when the members they share are ``least`` of either
    (``least_alike`` where both have the same ``family``); or when they are ``least_strong`` of the worse one's and the
    better one's family is among ``strong``. Where ``core`` (an array) is given, sharing only members outside both cores is no
    conflict. Pairs meet on a shared member of their group, so that items without any never meet.
    """
    rank = F.struct(*[F.col(c) for c in order])
    rows = items.select(group, F.col(item).alias("i"), rank.alias("k"), (F.lit(None).cast("string") if family is None else F.col(family)).alias("f"), F.array_distinct(members).alias("m"), (F.col(members) if core is None else F.col(core)).alias("c"))
    flat = rows.select(group, "i", "k", "f", F.size("m").alias("n"), F.explode("m").alias("x"), "c").withColumn("c", F.coalesce(F.array_contains("c", F.col("x")), F.lit(False)))
    a, b = (flat.select(group, "x", *[F.col(c).alias(f"{side}{c}") for c in ("i", "k", "f", "n", "c")]) for side in ("a", "b"))
    met = a.join(b, [group, "x"]).where((F.col("ak") > F.col("bk")) | ((F.col("ak") == F.col("bk")) & (F.col("ai") < F.col("bi"))))
    pair = met.groupBy(group, "ai", "bi").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("ac") | F.col("bc")).alias("core"), *[F.first(c).alias(c) for c in ("ak", "af", "bf", "an", "bn")])
    share, most = F.when(F.coalesce(F.col("af") == F.col("bf"), F.lit(False)), least_alike).otherwise(least), F.col("n") / F.least("an", "bn")
    inside = F.col("n") == F.least("an", "bn")
    fragment = F.coalesce(F.col("af").isin(*strong), F.lit(False)) & (F.col("n") / F.col("bn") >= least_strong) if strong else F.lit(False)
    return pair.where(F.col("core") & (inside | (most >= share) | fragment)).select(group, F.col("ai").alias("better"), F.col("bi").alias("worse"), F.col("ak").alias("rank"))


def independent_items(items: DataFrame, conflicts: DataFrame, group: str, item: str) -> DataFrame:
    """C20: ``items`` with kept and overlap_with: an item goes when it conflicts with a better one that stays; overlap_with is the best of those.

    The greedy choice in rounds for all groups at once: whoever has no better live conflict stays, whoever conflicts with one
    that stays goes, until no conflict is live. The best live item of every group is settled in each round. Rounds are written down,
    and each reads the conflicts that are left only.
    """
    conflicts = cut(conflicts, "conflicts")
    live, gone = conflicts, None
    while not live.isEmpty():
        stays = live.select(group, "better").distinct().join(live.select(group, F.col("worse").alias("better")), [group, "better"], "left_anti")
        out = cut(live.join(stays, [group, "better"], "left_semi").select(group, F.col("worse").alias("_x")).distinct(), "overlap-gone")
        gone = out if gone is None else gone.unionByName(out)
        left = live.join(out.withColumnRenamed("_x", "worse"), [group, "worse"], "left_anti").join(out.withColumnRenamed("_x", "better"), [group, "better"], "left_anti")
        left = cut(left, "overlap-live")
        if live is not conflicts:
            drop_files(live)
        live = left
    if gone is None:
        return items.withColumn("kept", F.lit(True)).withColumn("overlap_with", F.lit(None).cast(dict(items.dtypes)[item]))
    against = conflicts.join(gone.withColumnRenamed("_x", "better"), [group, "better"], "left_anti")
    top = against.groupBy(group, "worse").agg(F.max("rank").alias("_top"))
    best = against.join(top, [group, "worse"]).where(F.col("rank") == F.col("_top")).groupBy(group, F.col("worse").alias(item)).agg(F.min("better").alias("overlap_with"))
    return items.join(best, [group, item], "left").withColumn("kept", F.col("overlap_with").isNull())


def left_context_merge(left: DataFrame, context: DataFrame, on: list[str]) -> DataFrame:
    """Own values first, gaps filled from the context; context-only columns added."""
    shared = [c for c in left.columns if c in context.columns and c not in on]
    ctx = context.select(*on, *[F.col(c).alias(f"_c_{c}") if c in shared else F.col(c) for c in context.columns if c not in on])
    j = left.join(ctx, on, "left")
    return j.select(*[F.coalesce(c, f"_c_{c}").alias(c) if c in shared else F.col(c) for c in left.columns], *[c for c in context.columns if c not in left.columns])


def coverage_match(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """Key and status matched, missing or extra; repeated ids in ``got`` count as duplicate."""
    e = expected.select(key).distinct().withColumn("_e", F.lit(1))
    g = got.groupBy(key).agg(F.count(F.lit(1)).alias("_g"))
    status = F.when(F.col("_g").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(F.col("_g") > 1, "duplicate").otherwise("matched")
    return e.join(g, key, "full_outer").select(key, status.alias("status"))


def alternative_assignment(df: DataFrame, group: str, item: str, observed: str, predicted: str) -> DataFrame:
    """Per row the sibling whose prediction fits the observed value best (ties by item), how much better than its own it
    fits, and whether a swap of both improves both. Rows without siblings, or without either value, have no row.

    A nearest-value join: predictions and observations lie on one line in each group, dealt out by ranges of value. Within a
    range each observation carries the two predictions on either side, and the ranges' own ends are handed over, so that
    no group is gathered or paired with itself. Of equal predictions two items are enough, one of which is not oneself.
    Groups of :data:`SMALL_GROUP` rows at most are compared in a row of their own instead.
    """
    rows = df.select(F.struct(group).alias("_g"), F.col(item).alias("i"), F.col(observed).cast("double").alias("o"), F.col(predicted).cast("double").alias("p")).where("o is not null and p is not null")
    sized = cut(rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_g"))), "sized-groups")
    best = _nearest_in_rows(sized.where(F.col("_n") <= SMALL_GROUP))
    large = sized.where(F.col("_n") > SMALL_GROUP).drop("_n")
    if not large.isEmpty():
        best = best.unionByName(_nearest_over_ranges(large))
    own, other = F.abs(F.col("row.o") - F.col("row.p")), F.abs(F.col("b.oj") - F.col("b.pj"))
    swap = (F.col("b.e") < own) & (F.abs(F.col("b.oj") - F.col("row.p")) < other)
    return best.select(F.col(f"_g.{group}").alias(group), F.col("row.i").alias(item), F.col("b.j").alias("alternative"), (own - F.col("b.e")).alias("gain"), swap.alias("swap_improves"))


def _nearest_in_rows(rows: DataFrame) -> DataFrame:
    """_g, row, b of groups that fit in a row."""
    each = rows.groupBy("_g").agg(F.collect_list(F.struct("i", "o", "p")).alias("all")).select("_g", "all", F.explode("all").alias("row"))
    fits = F.transform(F.filter("all", lambda x: x["i"] != F.col("row.i")), lambda x: F.struct(F.abs(F.col("row.o") - x["p"]).alias("e"), x["i"].alias("j"), x["o"].alias("oj"), x["p"].alias("pj")))
    return each.select("_g", "row", F.array_min(fits).alias("b")).where("b is not null")


def _nearest_over_ranges(rows: DataFrame) -> DataFrame:
    """_g, row, b of groups of any size."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    least = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_g", "p").orderBy("i"))).where("_r <= 2")
    told = least.groupBy("_g", "p").agg(F.sort_array(F.collect_list(F.struct("i", "o"))).alias("of"))
    pred = told.select("_g", F.col("p").alias("v"), F.lit(0).alias("kind"), F.struct("p", "of").alias("pred"))
    every = pred.unionByName(rows.select("_g", F.col("o").alias("v"), F.lit(1).alias("kind"), F.struct("i", "o", "p").alias("row")), allowMissingColumns=True)
    placed = cut(every.repartitionByRange(n, "_g", "v", "kind").withColumn("_part", F.spark_partition_id()), "on-a-line")

    passed = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    up, down = Window.partitionBy("_g", "_part").orderBy("v", "kind"), Window.partitionBy("_g", "_part").orderBy(F.col("v").desc(), F.col("kind").desc())
    for w, name in ((up, "low"), (down, "high")):  # a prediction with the one before it, then the last such pair before each row
        placed = placed.withColumn(f"_{name}", F.when(F.col("pred").isNotNull(), F.array("pred", F.last("pred", True).over(passed(w))))).withColumn(name, F.last(f"_{name}", True).over(passed(w)))
    ends = placed.where(F.col("pred").isNotNull()).groupBy("_g", "_part").agg(F.max_by("_low", "v").alias("last"), F.min_by("_high", "v").alias("first"))
    ends = ends.groupBy("_g").agg(F.sort_array(F.collect_list(F.struct("_part", "last", "first"))).alias("ends"))  # an entry per range at most
    near = placed.where(F.col("row").isNotNull()).select("_g", "_part", "row", "low", "high").join(ends, "_g")
    none = F.array().cast(placed.schema["low"].dataType)
    before, after = F.filter("ends", lambda x: x["_part"] < F.col("_part")), F.filter("ends", lambda x: x["_part"] > F.col("_part"))
    carried = F.flatten(F.transform(F.slice(before, F.greatest(F.size(before) - 1, F.lit(1)), F.lit(2)), lambda x: x["last"]))
    coming = F.flatten(F.transform(F.slice(after, 1, 2), lambda x: x["first"]))
    found = F.filter(F.concat(F.coalesce("low", none), F.coalesce("high", none), carried, coming), lambda x: x.isNotNull())
    fits = F.flatten(F.transform(found, lambda c: F.transform(c["of"], lambda x: F.struct(F.abs(F.col("row.o") - c["p"]).alias("e"), x["i"].alias("j"), x["o"].alias("oj"), c["p"].alias("pj")))))
    return near.select("_g", "row", F.array_min(F.filter(fits, lambda x: x["j"] != F.col("row.i"))).alias("b")).where("b is not null")


def require_all(df: DataFrame, **gates: Column) -> DataFrame:
    """Returns ``df`` unchanged if every gate holds in every row (null fails); raises with counts else. One job."""
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in gates.items()]).first()
    if bad := {n: counts[n] for n in gates if counts[n]}:
        raise GateFailed(f"rows that fail: {bad}")
    return df


def feature_guard(df: DataFrame, features: list[str], forbidden: list[str]) -> DataFrame:
    """No target-derived column is a feature, and every feature is finite."""
    if both := sorted(set(features) & set(forbidden)):
        raise GateFailed(f"target-derived features: {both}")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) != float("inf"))
    return require_all(df, **{c: finite(c) for c in features})


def disjoint_check(a: DataFrame, b: DataFrame, key: str) -> None:
    """G3."""
    shared = a.select(key).distinct().join(b.select(key), key, "left_semi").limit(5).collect()
    if shared:
        raise GateFailed(f"shared identities such as {[r[0] for r in shared]}")


def union_cohorts(**cohorts: DataFrame) -> DataFrame:
    """G1: union by name, missing columns null, with cohort."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("cohort", F.lit(n)) for n, df in cohorts.items()])


def reference_transitions(states: DataFrame, group: str, state: str, charge: str, forms: str, is_reference: str, sites: str | None = None) -> DataFrame:
    """Each state against the group's reference: group, state, status, family. ``forms`` is map<family, count> of
    acid-side sites. unambiguous: one reference, charge off by one, exactly one family changed, by one, in the same
    direction as the charge, and, where ``sites`` (map<family, count> of all sites) is given, a single site of that family in the reference."""
    ref = states.where(F.col(is_reference)).groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(F.col(state).alias("s"), F.col(charge).alias("q"), F.map_entries(forms).alias("f"), F.map_entries(sites or forms).alias("u"))).alias("_ref"))
    j = states.where(~F.col(is_reference)).join(ref, group, "left")
    of = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    ref_map = F.map_from_entries(F.col("_ref.f"))
    keys = F.array_sort(F.array_union(F.map_keys(forms), F.map_keys(ref_map)))
    diff = F.filter(F.transform(keys, lambda k: F.struct(k.alias("k"), (of(F.col(forms), k) - of(ref_map, k)).alias("d"))), lambda x: x["d"] != 0)
    step = F.col(charge) - F.col("_ref.q")
    one = F.get(diff, F.lit(0))
    status = (
        F.when(F.col("_n").isNull(), "no_reference").when(F.col("_n") > 1, "several_references").when(F.abs(step) != 1, "charge_not_one").when(F.size(diff) != 1, "families_changed")
        .when(F.abs(one["d"]) != 1, "several_sites").when(one["d"] != step, "wrong_direction")
        .when(F.lit(sites is not None) & (of(F.map_from_entries(F.col("_ref.u")), one["k"]) != 1), "site_not_unique").otherwise("unambiguous")
    )
    return j.select(group, state, status.alias("status"), F.when(status == "unambiguous", one["k"]).alias("family"))


def observed_transitions(observations: DataFrame, transitions: DataFrame, group: str, state: str) -> DataFrame:
    """``observations`` with n_observations and n_unambiguous of their group, families (of the unambiguous transitions, pipe-joined),
    usable and the transition (state) they are assigned to: only where the group has one observation and its unambiguous transitions name one
    family, the first of them by state."""
    clear = transitions.where("status = 'unambiguous'").groupBy(group).agg(F.count(F.lit(1)).alias("n_unambiguous"), F.sort_array(F.collect_set("family")).alias("_f"), F.min(state).alias("_first"))
    n = observations.groupBy(group).agg(F.count(F.lit(1)).alias("n_observations"))
    t = observations.join(n, group).join(clear, group, "left")
    usable = (F.col("n_observations") == 1) & (F.coalesce(F.size("_f"), F.lit(0)) == 1)
    return t.select(*observations.columns, "n_observations", F.coalesce("n_unambiguous", F.lit(0)).alias("n_unambiguous"), F.coalesce(F.array_join("_f", "|"), F.lit("")).alias("families"), usable.alias("usable"), F.when(usable, F.col("_first")).alias(state))
